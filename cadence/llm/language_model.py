"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 has every training token (as a 64-bit hash), level k all n-grams of k tokens. A token's number is
its place in level 1. In level k, the successors of an n-gram (a place in level k - 1) stand side by side:
pointers, an Elias-Fano sequence, tell where they begin, and the sequence of place * V + number is another one. A query goes down the levels and searches its number only
among its context's successors. With each entry go its count, its discounted probability
(count - D) / count(context), and the mass that it leaves to the shorter context when it is a context
itself, the latter two as logarithms of QUANT bits. So

    p(w | context) = discounted(context w) + rest(context) * p(w | shorter context)

where a context without stored successors leaves everything, and p(w) = (c + 1) / (N + V + 1).

Counts come from all training documents: tasks count their own rows, buckets of hashes (or of contexts)
sum up, and each bucket becomes a shard of its level. Shards are written to the shared folder and mapped
into memory by the workers; nothing is collected but the sizes of shards.

A null text is empty: its only token is the end. A null doc_id counts as the empty text in the fold. With
no training row N and V are 0. Repeated rows count as often as they come. A text of any length is read
whole, in a window of its own if it is longer than WINDOW. Only doc_id and text are read, so other columns
of any name don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import hash_spans, windows
from .eliasfano import U64, EliasFano, pack, unpack
from .shared import documents, fold, shared_dir, write_table

ORDER, DISCOUNT, QUANT = 3, 0.75, 12
#: The end of a text; as a context also what stands before its first token.
END = np.uint64(0x243F6A8885A308D3)
FLUSH, BUCKET = 1_000_000, 1_000_000
#: Bytes of text whose tokens go down the trie together.
WINDOW = 4 << 20
#: The least log10 of what is quantised.
FLOOR = -12.0


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.log10(np.maximum(p, 10.0**FLOOR)) / FLOOR, 0, 1) * ((1 << QUANT) - 1)).astype(U64)


RESTORED = 10.0 ** (np.arange(1 << QUANT) * (FLOOR / ((1 << QUANT) - 1)))


def restored(q: np.ndarray) -> np.ndarray:
    return RESTORED[q.astype(np.int64)]


class Shard:
    """A part of a level: keys from ``start``, places from ``base``.

    words: start, contexts from, contexts to, bits of a count; keys; pointers; counts; discounted; rests.
    """

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, universe: int, context: tuple[int, int, int], discounted: np.ndarray, rests: np.ndarray) -> bytes:
        """keys: sorted, from 0. context: first, behind the last, and V (0: level 1)."""
        lo, hi, v = context
        places = np.searchsorted(keys, np.arange(hi - lo + 1, dtype=U64) * U64(max(v, 1))) if v else np.zeros(1, np.int64)
        # repeated pointers: place + number of the context, so that they increase
        pointers = EliasFano.build(places + np.arange(len(places)), len(keys) + len(places) + 1)
        bits = max(1, int(counts.max(initial=1)).bit_length())
        parts = [np.array([lo, hi, v, bits, len(counts), len(rests)], U64), *EliasFano.build(keys, universe).words(), *pointers.words(), pack(counts, bits), pack(discounted, QUANT), pack(rests, QUANT)]
        return np.concatenate(parts).tobytes()

    def __init__(self, words: np.ndarray, base: int):
        self.base = base
        self.lo, self.hi, self.v, self.bits, self.n, rests = (int(x) for x in words[:6])
        self.keys, at = EliasFano.view(words, 6)
        self.pointers, at = EliasFano.view(words, at)
        sizes = (self.n * self.bits // 64 + 2, self.n * QUANT // 64 + 2, rests * QUANT // 64 + 2)
        self.counts, self.discounted, self.rests = (words[a : a + n] for a, n in zip(np.cumsum([at, *sizes[:2]]), sizes, strict=True))


class Level:
    """The shards of a level, in order of their keys."""

    def __init__(self, blobs: list[tuple[int, np.ndarray]], buckets: int):
        self.shards: list[Shard] = []
        self.starts, base = [], 0
        for bucket, words in blobs:
            s = Shard(words, base)
            self.starts.append(_bucket_start(bucket, buckets) if not s.v else s.lo)
            self.shards.append(s)
            base += s.n
        self.n = base
        self.bases = np.array([s.base for s in self.shards], np.int64)
        self.starts_at = np.array(self.starts, U64)

    def _cuts(self, sorted_keys: np.ndarray) -> Iterator[tuple[Shard, int, int]]:
        cut = np.append(np.searchsorted(sorted_keys, self.starts_at), len(sorted_keys))
        for k, s in enumerate(self.shards):
            if cut[k] < cut[k + 1]:
                yield s, int(cut[k]), int(cut[k + 1])

    def _dealt(self, which: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """Each shard that is asked for, and who asks."""
        order = np.argsort(which.astype(np.int16) if len(self.shards) < 1 << 15 else which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(len(self.shards) + 1))
        for k, s in enumerate(self.shards):
            if cut[k] < cut[k + 1]:
                yield s, order[cut[k] : cut[k + 1]]

    def find_tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for k, (s, a, b) in enumerate(self._cuts(hashes)):
            found = s.keys.find(hashes[a:b] - U64(self.starts[self.shards.index(s)]))
            out[a:b] = np.where(found >= 0, found + s.base, -1)
        return out

    def find(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Places of (context, token) pairs sorted by context: the token is searched among the context's successors."""
        out = np.full(len(contexts), -1, np.int64)
        for s, a, b in self._cuts(contexts.astype(U64)):
            c = contexts[a:b] - s.lo
            ok = np.flatnonzero(c < s.hi - s.lo)
            begin, end = (x.astype(np.int64) - c[ok] for x in s.pointers.get_two(c[ok]))
            end -= 1
            some = end > begin
            ok = ok[some]
            found = s.keys.find(c[ok].astype(U64) * U64(s.v) + tokens[a:b][ok].astype(U64), begin[some], end[some])
            out[a:b][ok] = np.where(found >= 0, found + s.base, -1)
        return out

    def at(self, places: np.ndarray, what: str) -> np.ndarray:
        """counts or discounted of places."""
        out = np.zeros(len(places), U64)
        for s, here in self._dealt(np.searchsorted(self.bases, places, "right") - 1):
            out[here] = unpack(getattr(s, what), s.bits if what == "counts" else QUANT, places[here] - s.base)
        return out

    def rest(self, contexts: np.ndarray) -> np.ndarray:
        """What contexts (sorted or not; -1: unknown) leave to shorter ones."""
        out = np.ones(len(contexts))
        known = np.flatnonzero(contexts >= 0)
        for s, here in self._dealt(np.searchsorted(self.starts_at, contexts[known].astype(U64), "right") - 1):
            here = known[here]
            here = here[contexts[here] < s.hi]
            out[here] = restored(unpack(s.rests, QUANT, contexts[here] - s.lo))
        return out


def _bucket_start(bucket: int, buckets: int) -> int:
    """The least hash of a bucket (buckets cut the range of the upper 24 bits evenly)."""
    return -(-(bucket << 24) // buckets) << 40


_OPEN: dict[str, Trie] = {}


def opened(levels: list[tuple[list[str], int, str]]) -> Trie:
    """The trie of these levels; a worker keeps the last one that it opened."""
    name = repr(levels)
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Trie(levels)
    return _OPEN[name]


class Trie:
    """What a worker has of the levels: mapped files. levels: files of tables, their numbers of buckets, and folders of raw words."""

    def __init__(self, levels: list[tuple[list[str], int, str]]):
        self.levels = [Level(_mapped(paths, raw), buckets) for paths, buckets, raw in levels]
        self.v = self.levels[0].n

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(hashes, return_inverse=True)
        return self.levels[0].find_tokens(distinct)[at]

    def places(self, numbers: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
        """For each level up to ``order``, the place of the n-gram that ends at each token, -1 if it isn't stored.

        begins: places of the starts, which have END's number and end no n-gram.
        """
        out = [numbers]
        for k in range(1, order):
            c, ok = self.contexts(out[-1], begins, k)
            at = np.full(len(numbers), -1, np.int64)
            ok &= numbers >= 0
            if ok.any() and len(self.levels) > k:
                pair, back = np.unique(c[ok].astype(U64) * U64(self.v) + numbers[ok].astype(U64), return_inverse=True)
                at[ok] = self.levels[k].find((pair // U64(self.v)).astype(np.int64), (pair % U64(self.v)).astype(np.int64))[back]
            out.append(at)
        return out

    @staticmethod
    def contexts(places: np.ndarray, begins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of the n-gram of ``level`` tokens before each token, and where there is one."""
        c = np.concatenate([np.full(1, -1), places[:-1]])
        ok = c >= 0
        ok[begins] = False
        if level > 1:  # n-grams that would reach over the start
            late = begins + 1
            ok[late[late < len(ok)]] = False
        return c, ok


def raw_folder(spark: SparkSession, name: str) -> str:
    """Where tasks put a level's raw words, a file a bucket; empty if the shared folder is none that files can be mapped from."""
    shared = shared_dir(spark)
    return f"{shared.removeprefix('file:').replace('//', '/')}/{name}-words-{uuid.uuid4().hex}" if shared.startswith(("file:", "/")) else ""


def put(folder: str, bucket: int, words: bytes) -> None:
    """In place whole or not at all; a task that runs again puts the same."""
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f"{bucket}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(words)
    os.replace(part, os.path.join(folder, str(bucket)))


def _mapped(paths: list[str], raw: str) -> list[tuple[int, np.ndarray]]:
    """Shards (bucket, words) of a table's files, each mapped into memory."""
    out = []
    for path in paths:
        if raw:
            buckets = pq.read_table(path, columns=["bucket"]).column("bucket").to_pylist()
            out += [(b, np.asarray(np.memmap(os.path.join(raw, str(b)), U64, "r"))) for b in buckets]
            continue
        # a copy of this worker's own that goes when the worker does
        table = pq.read_table(SparkFiles.get(os.path.basename(path)), columns=["bucket", "size", "words"])
        sizes = table.column("size").to_pylist()
        with tempfile.TemporaryFile() as f:
            for x in table.column("words"):
                f.write(x.as_buffer())
            f.flush()
            words = np.asarray(np.memmap(f, U64, "r")) if sum(sizes) else np.zeros(0, U64)
        ends = np.cumsum([0, *sizes])
        out += [(b, words[i:j]) for b, i, j in zip(table.column("bucket").to_pylist(), ends, ends[1:], strict=False)]
    return sorted(out, key=lambda x: x[0])


SHARDS = "bucket int, size long, n long, total long, words binary"


def publish(shards: DataFrame, name: str, raw: str) -> tuple[list[str], int, int]:
    """Write a level; its files for the workers, entries, sum of counts."""
    spark = shards.sparkSession
    path = write_table(shards, name)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted(str(f.getPath().toString()) for f in found if f.getPath().getName().startswith("part-"))
    if raw:
        files = [f.removeprefix("file:").replace("//", "/") for f in files]
    else:
        for f in files:
            spark.sparkContext.addFile(f)
    sums = spark.read.parquet(path).agg(F.sum("n"), F.sum("total")).first() if files else (0, 0)
    return files, sums[0] or 0, sums[1] or 0


def tokens_of(column: pa.Array) -> Iterator[tuple]:
    """Of each window: hashes of [start, words, end] of all rows, where the starts are, the row of each token, the window."""
    for w in windows(column, WINDOW):
        at, length, row = w.words()
        h = hash_spans(w.data, at, length)
        per = np.bincount(row, minlength=w.n) if len(row) else np.zeros(w.n, np.int64)
        begins = np.cumsum(per + 2) - per - 2
        out = np.full(len(h) + 2 * w.n, END, U64)
        out[np.arange(len(h)) + 2 * row + 1] = h
        yield out, begins, np.repeat(np.arange(w.n), per + 2), w


def _width(span: int) -> int:
    return max(1, (max(span - 1, 1).bit_length() + 7) // 8)


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def counted(docs: DataFrame, level: int, levels: list, buckets: int, contexts: int, v: int, raw: str) -> DataFrame:
    """The shards of a level; their words go to the folder ``raw`` if there is one. In between: bucket, keys, counts of n-grams of ``level`` tokens. Keys, less the bucket's first: the hash, or context * V + number."""
    if level > 1 and contexts * v >= 1 << 63:
        raise OverflowError(f"{contexts} contexts times {v} tokens are beyond 63 bits; a lower order has fewer contexts")
    span = contexts * v // buckets + 2 * v + 2 if level > 1 else 1 << 64
    width = _width(span)

    def first_key(b: np.ndarray | int):
        return -(-(b * contexts) // buckets)

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        if level == 1:
            cut = np.searchsorted(keys, np.array([_bucket_start(b, buckets) for b in range(buckets)], U64))
            starts = [_bucket_start(b, buckets) for b in range(buckets)]
        else:
            starts = [first_key(b) * v for b in range(buckets)]
            cut = np.searchsorted(keys, np.array(starts, U64))
        cut = np.append(cut, len(keys))
        have = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([_narrow(keys[cut[b] : cut[b + 1]] - U64(starts[b]), width) for b in have], pa.binary()), pa.array([n[cut[b] : cut[b + 1]].astype("<u4").tobytes() for b in have], pa.binary())], names=["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(levels) if level > 1 else None
        waiting, total = [], 0
        for batch in batches:
            for h, begins, _, _ in tokens_of(batch.column(0)):
                if level == 1:
                    keys = np.delete(h, begins)
                else:
                    numbers = trie.numbers(h)
                    c, ok = trie.contexts(trie.places(numbers, begins, level - 1)[-1], begins, level - 1)
                    ok &= numbers >= 0
                    keys = c[ok].astype(U64) * U64(v) + numbers[ok].astype(U64)
                waiting.append(keys)
                total += len(keys)
                if total >= FLUSH:
                    yield from flush(waiting)
                    waiting, total = [], 0
        if total:
            yield from flush(waiting)

    def shard(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys = np.concatenate([_wide(x, width) for x in table.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        if level == 1:
            universe, context = (_bucket_start(b + 1, buckets) if b + 1 < buckets else 1 << 64) - _bucket_start(b, buckets), (0, 0, 0)
            discounted, rests = np.zeros(len(keys), U64), np.zeros(0, U64)
        else:
            lo, hi = first_key(b), first_key(b + 1)
            c = (keys // U64(v)).astype(np.int64)
            of, at = np.unique(c, return_inverse=True)
            whole = opened(levels).levels[level - 2].at(of + lo, "counts").astype(np.float64) if len(of) else np.zeros(0)
            p = (n - DISCOUNT) / whole[at]
            rest = np.ones(hi - lo)
            rest[of] = np.clip(1 - np.bincount(at, p, len(of)), 10.0**FLOOR, 1)
            universe, context, discounted, rests = (hi - lo) * v, (lo, hi, v), quantise(p), quantise(rest)
        words = Shard.build(keys, n, universe, context, discounted, rests)
        if raw:
            put(raw, b, words)
        return pa.table({"bucket": pa.array([b], pa.int32()), "size": pa.array([len(words) // 8]), "n": pa.array([len(keys)]), "total": pa.array([int(n.sum())]), "words": pa.array([None if raw else words], pa.binary())})

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(shard, SHARDS)


def train(docs: DataFrame, order: int = ORDER) -> tuple[list, int, int]:
    """The levels for Trie(), N and V."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // 6 // BUCKET)
    raw = raw_folder(docs.sparkSession, "level1")
    files, v, n = publish(counted(docs, 1, [], buckets, 0, 0, raw), "level1", raw)
    levels = [(files, buckets, raw)]
    contexts = v
    for level in range(2, order + 1):
        if not contexts:
            break
        raw = raw_folder(docs.sparkSession, f"level{level}")
        files, contexts, _ = publish(counted(docs, level, levels, buckets, contexts, v, raw), f"level{level}", raw)
        levels.append((files, buckets, raw))
    return levels, n, v


def scores(docs: DataFrame, levels: list, n: int, v: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, base_score, score of ``text``."""
    out = "n_tokens long, n_known long, base_score double, score double"
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("_scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(levels)
        for batch in batches:
            for h, begins, row, w in tokens_of(batch.column(batch.num_columns - 1)):
                numbers = trie.numbers(h) if v else np.full(len(h), -1, np.int64)
                real = np.ones(len(h), bool)
                real[begins] = False
                known = numbers >= 0
                c = np.zeros(len(h))
                if known.any():
                    each, at = np.unique(numbers[known], return_inverse=True)
                    c[known] = trie.levels[0].at(each, "counts")[at]
                p = (c + 1) / (n + v + 1)
                base = np.log10(p)
                places = trie.places(numbers, begins, len(levels))
                for k in range(1, len(levels)):
                    before, ok = trie.contexts(places[k - 1], begins, k)
                    rest = trie.levels[k].rest(np.where(ok, before, -1))
                    hit = places[k] >= 0
                    p = p * rest
                    p[hit] += restored(trie.levels[k].at(places[k][hit], "discounted"))
                score = np.log10(p)
                sums = [np.bincount(row[real], x[real].astype(np.float64), w.n) for x in (real, known, base, score)]
                columns = [pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])]
                yield pa.RecordBatch.from_arrays([*(x.slice(w.first, w.n) for x in batch.columns[:-1]), *columns], names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), out]))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold(7) == 2).alias("held_out"))
    levels, n, v = train(docs.where("not held_out"))
    return scores(docs, levels, n, v, ["doc_id", "held_out"]).withColumn("train_tokens", F.lit(n).cast("long"))
