"""N-gram Jaccard join by a prefix tree, and its components.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two documents link
when 100 * intersection >= 80 * union. The steps:

1. Equal sets become one class (groupBy on a digest of the set), so copies cost one row each.
2. Classes that can't have a partner go. A partner has at least 80% of a class's shingles, so few
   of them may be found nowhere else. Shingles go to buckets by hash, each with a reference to
   its class; a shingle that one task has met twice goes on as one mark. Large sets
   send only the shingles of low hash; what may be missing among those is bounded alike.
3. The sets of the remaining classes are written, and their shingles counted exactly, so that
   each set has a global order: rare shingles first. Linked sets share one of the first
   n - ceil(0.8 n) + 1 shingles in that order. Sets that share one are joined to the least of
   them, which gives candidate groups as components.
4. Each candidate group is joined by a prefix tree (frequent shingles first, so that near copies
   share long paths). Sets walk the tree together, each with its overlap so far; a set leaves a subtree when
   what remains of either side can't reach the needed overlap. Large groups are cut into
   blocks of BLOCK sets, and each pair of blocks, and each block with itself, is joined by itself.
   Every link is counted for both of its classes; those that join two parts go on as pairs.
5. Components of the links, then the least doc_id of each. A document's links are those of its
   class to other classes, each as often as that class has documents, and its copies.

Words are split at [\\x20\\x09-\\x0D], A-Z lower-cased. Fewer than five words: the whole row of
words is the one shingle. No words, or null text: an empty set, linked with nothing, so the component is
the row's own doc_id. A null doc_id counts for no minimum; a component of such rows alone is null.
Repeated rows are copies. Two different shingles share a hash with probability about n * n / 2**65 among n.
Sets are told apart by 128 bits: where two share the first 64 (their name), both get the other 64 as their name.
Rows are found again by 128 bits of doc_id and text. Texts are read whole, a longer one in a window of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Window, hash_rows, hash_spans, windows
from .graph import connected_components
from .shared import brought_back, documents, drop_table, give_back, join_uneven, set_aside, tidied, write_table

WIDTH, PERCENT = 5, 80
#: Sets of this size or more send only shingles with a hash under LOW of the range.
LARGE, LOW = 256, 0.4
#: Shingles that a task sorts at once; shingles of a bucket; sets of a block.
FLUSH, BUCKET, BLOCK = 1_500_000, 1_500_000, 128
#: Ids up to which a list of them is broadcast (8 bytes each); a shuffled join beyond.
BROADCAST_IDS = 1_000_000
MARK = 0x7FFF
#: Sets that walk a tree together times distinct shingles: 5 bytes each.
CELLS = 4_000_000
TOP = np.uint64(int(LOW * 2**64))


def shingle_sets(w: Window, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    at, length, row = w.words()
    h = hash_spans(w.data, at, length)
    rolled = hash_rows(h, width)
    first = np.searchsorted(row, np.arange(w.n + 1))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(hash_rows(h[a:b], b - a) if b > a else h[:0])
    return out


def digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in two halves."""
    return divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)[::-1]


def digest(s: np.ndarray, apart: frozenset[int] = frozenset()) -> int:
    """A set's name; apart: first halves that several sets share."""
    first, other = digests(s)
    return other if first in apart else first


def missing(n: int) -> int:
    """How many of n shingles a partner may lack."""
    return n - (PERCENT * n + 99) // 100


def counted(n: int) -> bool:
    """Whether a set of n counts on its shingles of low hash only."""
    return n >= LARGE


def sent(n: int) -> bool:
    """Whether it sends those only: no partner (of at least 80% its size) counts on all."""
    return PERCENT * n >= 100 * LARGE


def row_key() -> Column:
    """What finds a row of ``documents`` again: 128 bits of doc_id and text, so equal for repeated rows alone."""
    return F.concat(F.hex(F.xxhash64("doc_id", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "text", "doc_id")))


SIZES = "digest long, other long, n_shingles long, n_counted long"


def sizes_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SIZES of each text (digest, other: null if the set is empty)."""
    for batch in texts:
        out: list[list] = [[], [], [], []]
        for w in windows(batch):
            for s in shingle_sets(w):
                first, other = digests(s) if len(s) else (None, None)
                row = (first, other, len(s), int(np.searchsorted(s, TOP)) if counted(len(s)) else len(s))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        arrays = [pa.array(np.array([x or 0 for x in c], np.uint64).view(np.int64), mask=np.array([x is None for x in c], bool)) for c in out[:2]]
        yield pa.StructArray.from_arrays([*arrays, pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["digest", "other", "n_shingles", "n_counted"])
        give_back()


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key, SIZES. Only the text is sent to Python."""
    return docs.select("doc_id", row_key().alias("key"), F.arrow_udf(sizes_of, SIZES)("text").alias("found")).select("doc_id", "key", "found.*")


def _six(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash; as an order of magnitude, one in 2**48 / n coincides."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _slices(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted tokens."""
    return np.searchsorted((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1, dtype=np.uint64))


PACK = "bucket int, tokens binary, refs binary, names binary"


def _pack(tokens: np.ndarray, refs: np.ndarray, names: np.ndarray, buckets: int, marks: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of PACK, a bucket each; tokens sorted; refs (lower 15 bits) into names, of which a row has those it needs."""
    cut = _slices(tokens, buckets)
    rows = []
    for k in range(buckets):
        a, b = int(cut[k]), int(cut[k + 1])
        if a == b:
            continue
        used, short = np.unique(refs[a:b] & MARK, return_inverse=True)
        flag = refs[a:b] & ~np.uint16(MARK)
        known = used if marks is None else used[used != MARK]
        short = np.where((refs[a:b] & MARK) == MARK, MARK, short) if marks is not None else short
        rows.append((k, _six(tokens[a:b]), (short.astype(np.uint16) | flag).tobytes(), names[known].tobytes()))
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), *(pa.array([r[j] for r in part], pa.binary()) for j in (1, 2, 3))], names=["bucket", "tokens", "refs", "names"])


def send_shingles(docs: DataFrame, buckets: int, apart: frozenset[int] = frozenset()) -> DataFrame:
    """Step 2, map: rows of PACK, and rows without tokens whose names and refs are classes and what they may count already."""

    def flush(sets: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for _, s in sets])
        parts = [s[: np.searchsorted(s, TOP)] if sent(len(s)) else s for _, s in sets]
        refs = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(p) for p in parts])
        tokens = np.concatenate(parts)
        counts = ~(np.array([counted(n) for n in sizes])[refs]) | (tokens < TOP)
        names = np.array([d for d, _ in sets], np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, refs, counts = tokens[order], refs[order], counts[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        group = np.cumsum(new) - 1
        often = np.bincount(group) > 1
        shared = often[group]
        credit = np.bincount(refs[shared & counts], minlength=len(sets))
        keep = ~shared | new
        refs = np.where(shared, np.uint16(MARK), refs | (counts.astype(np.uint16) << np.uint16(15)))[keep]
        yield from _pack(tokens[keep], refs, names, buckets, MARK)
        have = np.flatnonzero(credit)
        yield pa.RecordBatch.from_arrays([pa.array([int(names[0] % np.uint64(buckets))], pa.int32()), pa.array([None], pa.binary()), pa.array([credit[have].astype("<i8").tobytes()], pa.binary()), pa.array([names[have].tobytes()], pa.binary())], names=["bucket", "tokens", "refs", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total = {}, 0
        for batch in batches:
            for w in windows(batch.column(0)):
                for s in shingle_sets(w):
                    if len(s) and (d := digest(s, apart)) not in waiting:
                        waiting[d] = s
                        total += len(s)
                        if total >= FLUSH or len(waiting) >= MARK - 1:
                            yield from flush(list(waiting.items()))
                            waiting, total = {}, 0
        if waiting:
            yield from flush(list(waiting.items()))

    return docs.select("text").mapInArrow(tidied(run), PACK)


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens, class names, flags and marks of PACK rows with tokens."""
    out = [[], [], []]
    for t, r, n in zip(*(table.column(c).to_pylist() for c in ("tokens", "refs", "names")), strict=True):
        if t is not None:
            refs, names = np.frombuffer(r, np.uint16), np.concatenate([np.frombuffer(n, np.uint64), np.zeros(1, np.uint64)])
            low = (refs & MARK).astype(np.int64)
            out[0].append(_eight(t))
            out[1].append(names[np.where(low == MARK, len(names) - 1, low)])
            out[2].append(refs)
    if not out[0]:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),) * 2
    refs = np.concatenate(out[2])
    return np.concatenate(out[0]), np.concatenate(out[1]), refs >> 15 > 0, (refs & MARK) == MARK


def credits(packed: DataFrame) -> DataFrame:
    """Step 2, reduce: digest, credit (how many of its counted shingles some other class has)."""

    def run(table: pa.Table) -> pa.Table:
        tokens, names, counts, marks = _read(table)
        found = []
        if len(tokens):
            order = np.lexsort((names, tokens))
            tokens, names, counts, marks = tokens[order], names[order], counts[order], marks[order]
            new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            # marks stand for two classes or more; otherwise two different names do
            last = np.append(at[1:], len(tokens)) - 1
            shared = np.logical_or.reduceat(marks, at) | (names[at] != names[last])
            once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1])])
            found.append(np.unique(names[shared[group] & once & counts & ~marks], return_counts=True))
        for t, r, n in zip(*(table.column(c).to_pylist() for c in ("tokens", "refs", "names")), strict=True):
            if t is None:
                found.append((np.frombuffer(n, np.uint64), np.frombuffer(r, "<i8")))
        names = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        n = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.table({"digest": pa.array(names.view(np.int64)), "credit": pa.array(n.astype(np.int64))})

    return packed.groupBy("bucket").applyInArrow(run, "digest long, credit long")


SETS = "chunk long, names binary, sizes binary, shingles binary"


def packed_sets(docs: DataFrame, apart: frozenset[int] = frozenset()) -> DataFrame:
    """Step 3: the sets of rows (text, digest), many to a row, about FLUSH shingles each."""

    def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        names = np.array(list(sets), np.uint64).tobytes()
        sizes = np.array([len(s) for s in sets.values()], "<i8").tobytes()
        chunk = xxhash.xxh3_64_intdigest(names) - (1 << 63)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (names, sizes, np.concatenate(list(sets.values())).tobytes()))], names=["chunk", "names", "sizes", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total = {}, 0
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for w in windows(batch.column(0)):
                for s, d in zip(shingle_sets(w), wanted[w.first : w.first + w.n], strict=True):
                    if len(s) and digest(s, apart) == int(d) and int(d) not in waiting:
                        waiting[int(d)] = s
                        total += len(s)
                        if total >= FLUSH // 2 or len(waiting) >= MARK - 1:
                            yield flush(waiting)
                            waiting, total = {}, 0
        if waiting:
            yield flush(waiting)

    return docs.select("text", "digest").mapInArrow(tidied(run), SETS)


def _sets_of(names: bytes, sizes: bytes, shingles: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(names, np.uint64), np.frombuffer(sizes, "<i8"), np.frombuffer(shingles, np.uint64)


def _cut6(h: np.ndarray) -> np.ndarray:
    return h & ~np.uint64(0xFFFF)


def frequencies(sets: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, df: in how many sets each of the chunk's distinct shingles of that bucket is, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, n = np.unique(_cut6(_sets_of(row["names"], row["sizes"], row["shingles"])[2]), return_counts=True)
                cut = _slices(tokens, buckets)
                have = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                columns = [[row["chunk"]] * len(have), have, [_six(tokens[cut[k] : cut[k + 1]]) for k in have], [n[cut[k] : cut[k + 1]].astype("<u2").tobytes() for k in have]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "tokens", "n"])

    def total(table: pa.Table) -> pa.Table:
        parts = [_eight(t) for t in table.column("tokens").to_pylist()]
        n = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("n").to_pylist()])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.minimum(np.bincount(at, n)[at], 2**32 - 1).astype("<u4")
        ends = np.cumsum([0, *map(len, parts)])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "df": pa.array([df[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

    return sets.mapInArrow(tidied(count), "chunk long, bucket int, tokens binary, n binary").groupBy("bucket").applyInArrow(total, "chunk long, bucket int, df binary")


def candidate_links(sets: DataFrame, buckets: int) -> DataFrame:
    """Step 3: a, b (digests): each set that shares a shingle of its first ones, with the least set that does."""
    df = frequencies(sets, buckets).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "df")).alias("df"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, sizes, shingles = _sets_of(row["names"], row["sizes"], row["shingles"])
                tokens = _cut6(shingles)
                distinct, at = np.unique(tokens, return_inverse=True)
                by = {x["bucket"]: np.frombuffer(x["df"], "<u4") for x in row["df"]}
                often = np.concatenate([by[k] for k in sorted(by)])[at]
                which = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((tokens, often, which))
                place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = np.array([missing(int(n)) + 1 for n in sizes])[which]  # rows stay together, so ``which`` holds after ordering
                keep = order[(place < first) & (often[order] > 1)]
                keep = keep[np.argsort(tokens[keep], kind="stable")]
                yield from _pack(tokens[keep], which[keep].astype(np.uint16), names, buckets)

    def stars(table: pa.Table) -> pa.Table:
        tokens, names, *_ = _read(table)
        order = np.lexsort((names, tokens))
        tokens, names = tokens[order], names[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
        least = names[np.flatnonzero(new)][np.cumsum(new) - 1] if len(tokens) else names
        pair = np.unique(np.stack([least, names], 1)[least != names], axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(pair[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))})

    return sets.join(df, "chunk").mapInArrow(tidied(firsts), PACK).groupBy("bucket").applyInArrow(stars, "a long, b long").distinct()


class Trie:
    """Sets (rows of ranks, ascending) by common beginnings; a node has a run of ranks, the overlap's bounds and its sets."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows, self.sizes = rows, [len(r) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
        self.nodes: list[tuple] = []  # run, first child..., see _build
        self.root = self._build(order)

    def _build(self, order: list[int]) -> int:
        """Iterative: (sets, depth, slot of the parent's list of children)."""
        top: list[int] = []
        todo = [(order, 0, top)]
        while todo:
            sets, depth, slot = todo.pop()
            a, b = self.rows[sets[0]], self.rows[sets[-1]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:n] != b[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
            here = [i for i in sets if self.sizes[i] == end]
            rest = [i for i in sets if self.sizes[i] > end]
            sizes = [self.sizes[i] for i in sets]
            kids: list[int] = []
            slot.append(len(self.nodes))
            self.nodes.append((a[depth:end], int(a[end - 1]) if end else -1, max(sizes) - end, min(sizes), max(sizes), here, kids))
            i = 0
            while i < len(rest):
                mark, j = self.rows[rest[i]][end], i
                while j < len(rest) and self.rows[rest[j]][end] == mark:
                    j += 1
                todo.append((rest[i:j], end, kids))
                i = j
        return top[0]

    def walk(self, queries: list[np.ndarray], ranks: int) -> Iterator[tuple[int, int]]:
        """(query, set) of all links; the queries go down together, each as far as it can still reach what it needs."""
        sizes = np.array([len(q) for q in queries], np.int64)
        member = np.zeros((len(queries), ranks), bool)
        for i, q in enumerate(queries):
            member[i, q] = True
        upto = np.cumsum(member, axis=1, dtype=np.int32)
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while todo:
            node, live, overlap = todo.pop()
            run, last, more, least, most, here, kids = self.nodes[node]
            fits = (100 * most >= PERCENT * sizes[live]) & (PERCENT * least <= 100 * sizes[live])
            live, overlap = live[fits], overlap[fits]
            if len(run):
                overlap = overlap + member[np.ix_(live, run)].sum(1)
            n = sizes[live]
            rest = n - (upto[live, last] if last >= 0 else 0)
            on = (100 + PERCENT) * (overlap + np.minimum(rest, more)) >= PERCENT * (n + least)
            live, overlap, n = live[on], overlap[on], n[on]
            if not len(live):
                continue
            for y in here:
                for x in live[(100 + PERCENT) * overlap >= PERCENT * (n + self.sizes[y])].tolist():
                    yield x, y
            todo += [(k, live, overlap) for k in kids]


def find(parts: list[int], i: int) -> int:
    while parts[i] != i:
        parts[i] = parts[parts[i]]
        i = parts[i]
    return i


def links_of(sets: list[np.ndarray], left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
    """All links (x, y): of a set of ``left`` with one of ``right``, or, if ``right`` is empty, of two of ``left``, each once."""
    held = right or left
    distinct, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.uint32)
    rank[np.lexsort((distinct, -n))] = np.arange(len(distinct), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, sets)])
    rows = [np.sort(rank[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
    trie = Trie([rows[y] for y in held])
    together = max(1, CELLS // max(len(distinct), 1))
    for a in range(0, len(left), together):
        part = left[a : a + together]
        for x, y in trie.walk([rows[x] for x in part], len(distinct)):
            if right or part[x] < held[y]:
                yield part[x], held[y]


def verified_links(sets: DataFrame, groups: DataFrame, tasks: int) -> DataFrame:
    """Step 4, from SETS rows and the candidate groups (id, component, times: documents of the class).

    a, b (digests; no link that the others don't imply), and rows without b whose n is how many documents of other classes a links with.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, sizes, shingles = _sets_of(row["names"], row["sizes"], row["shingles"])
                ends = np.cumsum(sizes)
                for a in range(0, len(names), 512):
                    own = [shingles[e - n : e].tobytes() for n, e in zip(sizes[a : a + 512], ends[a : a + 512], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 512].view(np.int64)), pa.array(own, pa.binary())], names=["digest", "shingles"])

    size = groups.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks").cast("long")).cast("int")
    placed = groups.join(size, "component").select(F.col("id").alias("digest"), F.col("component").alias("group"), "times", blocks.alias("blocks"))
    placed = placed.withColumn("own", own)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"))))
    rows = sets.mapInArrow(tidied(unpack), "digest long, shingles binary").join(placed, "digest").withColumn("pair", pair)
    rows = rows.select("group", "pair.i", "pair.j", "own", "times", "digest", "shingles")
    rows = rows.repartition(tasks, "group", "i", "j").sortWithinPartitions("group", "i", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, times, sides, sets = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            _, i, j = key
            left = [k for k, side in enumerate(sides) if side == i]
            right = [k for k, side in enumerate(sides) if side == j] if i != j else []
            if not left or (i != j and not right) or len(sets) < 2:
                return
            parts, kept, n = list(range(len(sets))), [], [0] * len(sets)
            for x, y in links_of(sets, left, right):
                n[x] += times[y]
                n[y] += times[x]
                a, b = find(parts, x), find(parts, y)
                if a != b:
                    parts[a] = b
                    kept.append((names[x], names[y], None))
            kept += [(names[x], None, m) for x, m in enumerate(n) if m]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], pa.int64()) for k in range(3)], names=["a", "b", "n"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("digest", "times", "own")), batch.column("shingles"), strict=True)
            for k, (name, time, side, s) in zip(keys, rest, strict=True):
                if k != key:
                    if key:
                        yield from close()
                    key, names, times, sides, sets = k, [], [], [], []
                names.append(name)
                times.append(time)
                sides.append(side)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
        if key:
            yield from close()

    return rows.mapInArrow(tidied(join), "a long, b long, n long")


def _by_size(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, digest, key (row_key()) and group (names the component, null ids or not), for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = spark.read.parquet(write_table(set_sizes(docs), "sizes"))
    # names that two sets share: one in 2**65 / n / n of all
    shared = rows.where("digest is not null").groupBy("digest").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
    apart = [r["digest"] for r in shared.collect()]
    if apart:
        rows = rows.withColumn("digest", F.when(F.col("digest").isin(apart), F.col("other")).otherwise(F.col("digest")))
    names = frozenset(d % (1 << 64) for d in apart)
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "key")).alias("key"), F.max("n_shingles").alias("n"), F.max("n_counted").alias("n_counted"), F.count("*").alias("times")
    )
    classes = spark.read.parquet(write_table(classes, "classes"))
    sums = rows.agg(F.sum(F.when(F.col("n_shingles") * PERCENT >= 100 * LARGE, F.col("n_shingles") * LOW).otherwise(F.col("n_shingles"))), F.count("*")).first()
    total, n_rows = sums[0] or 0, sums[1]
    buckets = max(64, math.ceil(total / BUCKET))
    credit = credits(send_shingles(docs, buckets, names)).groupBy("digest").agg(F.sum("credit").alias("credit"))
    need = F.col("n_counted") - (F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100))
    left = classes.join(credit, "digest", "left").where(F.coalesce("credit", F.lit(0)) >= need)
    left_at = write_table(left.select("digest", "key", "times"), "left")
    left = spark.read.parquet(left_at)
    kept = docs.select(row_key().alias("key"), "text").join(_by_size(left.select("key", "digest"), left.count()), "key")
    sets_at = write_table(packed_sets(kept, names), "sets")
    sets = spark.read.parquet(sets_at)
    groups = connected_components(candidate_links(sets, buckets)).join(left.select(F.col("digest").alias("id"), "times"), "id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET))
    found = spark.read.schema("a long, b long, n long").parquet(write_table(verified_links(sets, groups, tasks), "links"))
    links = connected_components(found.where("b is not null").select("a", "b"))
    drop_table(spark, sets_at)
    drop_table(spark, left_at)
    others = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"))
    named = links.withColumnRenamed("id", "digest").join(classes.select("digest", "rep"), "digest")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").join(others, "digest").select("digest", "least", "component", "others")
    every = classes.select("digest", "rep", "times").join(named, "digest", "left")
    every = every.select("digest", F.coalesce("least", "rep").alias("least"), F.coalesce("component", "digest").alias("group"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.col("times").alias("_n"))
    out = join_uneven(rows.select("doc_id", "n_shingles", "digest", "key"), every, "digest", n_rows, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "digest", "key", "group")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones: the one of the least doc_id, and of several rows with that doc_id the one of the least key.

    Documents without words stay, but for repeated rows (equal doc_id and text). A null doc_id
    comes after all others. Texts that aren't linked stay, even if they have one doc_id. Extra
    columns of any name come through.
    """
    spark = docs.sparkSession
    docs, names = set_aside(docs, "doc_id", "text")
    found = spark.read.parquet(write_table(components(docs.select("doc_id", "text")), "components"))
    first = found.groupBy("key").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("component_id").alias("component_id"), F.first("group").alias("group"))
    linked = first.where(F.col("group").isNotNull()).withColumn("head", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # a group's heads are the texts of its least doc_id; more than one of them is rare
    rival = linked.where("head").groupBy("group").agg(F.min("key").alias("_least"), F.count("*").alias("_keys")).where("_keys > 1")
    lost = linked.where("head").join(rival, "group").where("key <> _least")
    gone = linked.where("not head").select("key").unionByName(lost.select("key"))
    gone = spark.read.parquet(write_table(gone.select(F.col("key").alias("_gone")), "gone"))
    again = spark.read.parquet(write_table(first.where("n > 1").select(F.col("key").alias("_again")), "again"))
    kept = docs.withColumn("_key", row_key()).join(_by_size(gone, gone.count()), F.col("_key") == F.col("_gone"), "left_anti")
    n = again.count()
    repeated = kept.join(_by_size(again, n), F.col("_key") == F.col("_again"), "left_semi").dropDuplicates(["_key"])
    kept = kept.join(_by_size(again, n), F.col("_key") == F.col("_again"), "left_anti")
    return brought_back(kept.unionByName(repeated), names)
