"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text exactly one token can be the last of that prefix's
encoding. Those last tokens are found from left to right: a token fits at a place if it ends
the prefix and the last token of what is before it stays apart from it, that is, if the two
tokens' bytes encode to just those two tokens. Walking back along the last tokens gives the
encoding of any prefix, so appending is exact, and an edit needs work only from its place on
until the table runs as before.

Null text counts as empty; an empty text has no tokens. Any text is encoded whole; equal
texts give equal ids, repeated rows included. The frame's other columns are left alone, but for
those of a new column's name, which give way to it. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import clean_name, documents, give_back

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Vocabulary:
    """Ranks, and what is known of single tokens and of pairs of them."""

    #: Remembered pairs and pieces; both are emptied when full, so memory stays bounded. A dict of 1,398,101 keys would double.
    MOST_PAIRS, MOST_PIECES, LONG = 1_390_000, 690_000, 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}  # by a << 32 | b, less than half a tuple's size
        self.own: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left. For short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def stands(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        found = self.own.get(token)
        if found is None:
            found = self.own[token] = self.merged(self.bytes[token]) == [token]
        return found

    def apart(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) >= self.MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, as little-endian 32-bit integers."""
        data = text.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else Prefixes(self, data).ids()
        out = np.array(ids, "<u4").tobytes()
        if len(data) <= self.LONG:
            if len(self.pieces) >= self.MOST_PIECES:
                self.pieces.clear()
            self.pieces[text] = out
        return out


class Prefixes:
    """The table of last tokens of one piece; append() and edit() keep it exact."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, end: int) -> int:
        v, data, last = self.v, self.data, self.last
        ranks, pairs = v.ranks, v.pairs
        for begin in range(max(0, end - v.longest), end):
            token = ranks.get(data[begin:end])
            if token is None:
                continue
            if not begin:
                if v.stands(token):
                    return token
                continue
            # a token that is apart from the one before it stands by itself, too
            found = pairs.get(last[begin - 1] << 32 | token)
            if v.apart(last[begin - 1], token) if found is None else found:
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replace bytes begin to end; returns how many last tokens were worked out again."""
        tail, shift = self.last[end:], begin + len(new)
        self.data = self.data[:begin] + new + self.data[end:]
        del self.last[begin:]
        same = 0
        for n in range(begin + 1, len(self.data) + 1):
            token = self._last(n)
            self.last.append(token)
            k = n - shift - 1
            # what follows depends on the last tokens of as many places as the longest token has bytes
            same = same + 1 if k >= 0 and tail[k] == token else 0
            if same >= self.v.longest:
                self.last += tail[k + 1 :]
                return n - begin
        return len(self.data) - begin

    def ids(self, end: int | None = None) -> list[int]:
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes[out[-1]])
        return out[::-1]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(load_ranks(path))
    return _LOADED[path]


def encode(v: Vocabulary, text: str, pattern) -> bytes:
    known, out = v.pieces, []
    for piece in pattern.findall(text):
        out.append(known.get(piece) or v.piece(piece))
    return b"".join(out)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    return b"".join(map(v.bytes.__getitem__, ids.tolist()))


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = "ids", digests: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` if not ``keep_text``, or if no ids are asked for) with the ids of ``text`` (array of int, named ``ids``), and with ``digests`` n_tokens, ids_sha256, decoded_sha256.

    A null text is empty. Columns of ``docs`` that have the name of one of the new ones give way to it; all others come through. Only the text is sent to Python.
    """
    extra = [f"{ids} array<int>"] if ids else []
    extra += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else []
    new = [x.split()[0] for x in extra]
    carried = [c for c in docs.columns if c not in new and (c != text or ids and keep_text)]

    @F.arrow_udf(", ".join(extra))
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v, find = vocabulary(path), regex.compile(pattern)
        for batch in texts:
            rows = [encode(v, x.as_py() or "", find) for x in batch]
            columns = []
            if ids:
                ends = np.cumsum([0, *map(len, rows)]) // 4
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"))))
            if digests:
                columns += [pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows])]
                columns.append(pa.array([hashlib.sha256(decode(v, np.frombuffer(x, "<u4"))).hexdigest() for x in rows]))
            yield pa.StructArray.from_arrays(columns, names=new)
            del rows, columns
            give_back()

    hidden = clean_name(*docs.columns, *new, stem="_tokens")
    found = docs.select(*(F.col(f"`{c}`") for c in carried), tokens(F.col(f"`{text}`")).alias(hidden))
    return found.select(*(F.col(f"`{c}`") for c in carried), *(F.col(f"{hidden}.{c}") for c in new))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_tokens(docs, tokenizers.path(VOCABULARY), tokenizers.PATTERN, ids=None, digests=True)
