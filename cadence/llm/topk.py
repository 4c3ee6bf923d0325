"""Exact top-k inner products by KD-trees, one for each shard of the candidates.

A tree splits at the median of its widest axis and keeps the tight bounding box of every node.
A query walks a tree best node first: a box bounds the inner product of all it holds by the sum of
each axis's better end, so nodes that can't reach the query's kth score so far are passed over. That
kth score goes on from tree to tree within a task, and begins with the kth over a small set of
candidates that every task gets. Queries come in blocks of bounded size, each of which meets
all candidates; only k rows for each query and task are shuffled.

Vectors: component x counts as floor(256 * x). Rows with a null id, a null vector, or null or
non-finite components take no part; vectors are held only against vectors of equal length. Ties go
to the smaller id. A query's own id is no candidate. A query is an id: if one comes more than once, the
lowest of its vectors of a length (by first component, then the next) is the one asked with, while all its rows
are candidates for others. Fewer candidates than k: all of them. Scores are exact below 2**53, which
components below 8192 can't pass on 2048 axes; beyond, they are the nearest double, cut at a long's range.
Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Candidates of a tree, of a leaf, and queries of a block (64 axes of 8 bytes: 16 MB at most).
SHARD, LEAF, BLOCK, SEEDS = 16_384, 128, 32_768, 2_000
SCALE = 256
#: A long's largest value.
LONG = (1 << 63) - 1


class Tree:
    """Nodes are numbered from the root, 0; a leaf has no children (-1)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        spans, kids, low, high, least = [(0, len(ids))], [], [], [], []
        for a, b in spans:  # grows as it goes
            rows = order[a:b]
            part = points[rows]
            low.append(part.min(0))
            high.append(part.max(0))
            least.append(int(ids[rows].min()))
            width = high[-1] - low[-1]
            if b - a <= leaf or not width.any():
                kids.append(-1)
                continue
            mid = (b - a) // 2
            order[a:b] = rows[np.argpartition(part[:, int(width.argmax())], mid, kind="introselect")]
            kids.append(len(spans))
            spans += [(a, a + mid), (a + mid, b)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.least = np.array(low), np.array(high), least
        self.spans, self.kids = spans, kids

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best inner product that each query can have in each node."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, best: list[tuple[int, int]], floor: float) -> list[tuple[int, int]]:
        """Puts this tree's candidates into ``best``: (score, -id), a heap of at most k. floor: k candidates elsewhere reach it."""
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            reach = -reach
            if reach < floor or len(best) == k and (reach, -self.least[node]) <= best[0]:
                if reach < floor or reach < best[0][0]:
                    break
                continue
            kid = self.kids[node]
            if kid >= 0:
                for x in (kid, kid + 1):
                    heapq.heappush(heap, (-bound[x], x))
                continue
            a, b = self.spans[node]
            scores = self.points[a:b] @ query
            worst = max(floor, best[0][0] if len(best) == k else -np.inf)
            keep = np.flatnonzero(scores >= worst)
            if len(keep) > k + 1:  # among ties, the smaller ids; one more, as its own id may be there
                keep = keep[np.lexsort((self.ids[a:b][keep], -scores[keep]))]
                keep = _cut(keep, self.ids[a:b][keep], own, k)
            for i in keep:
                vec = int(self.ids[a + i])
                if vec == own:
                    continue
                item = (max(-LONG, min(LONG, int(scores[i]))), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _cut(order: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    return order[ids != own][:k]


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and integer vectors (as float64, which holds all sums here exactly) of the rows that take part."""
    ids, vectors = [], []
    for vec, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if vec is None or not x.is_valid:
            continue
        flat = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
        if np.isfinite(flat).all():  # nulls come as nan
            ids.append(vec)
            vectors.append(np.floor(flat * SCALE))
    return np.array(ids, np.int64), vectors


def by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), ids[at], np.array([vectors[i] for i in at]).reshape(len(at), int(n))


class Block:
    """Queries of one length, with a floor under each one's kth score."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int):
        self.ids, self.points = ids, points
        self.floor = np.full(len(ids), -np.inf)
        if len(seeds) > k:
            for a in range(0, len(ids), 1024):
                scores = points[a : a + 1024] @ seeds.T
                scores[ids[a : a + 1024, None] == seed_ids[None]] = -np.inf
                self.floor[a : a + 1024] = np.partition(scores, -k, axis=1)[:, -k]


def search_block(candidates: DataFrame, sent: Broadcast[dict[int, Block]], k: int) -> DataFrame:
    """query_id, vec_id, score: of each task's candidates the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: [[] for _ in b.ids] for n, b in sent.value.items()}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def visit(n: int) -> None:
            parts, block = waiting.pop(n), sent.value[n]
            tree = Tree(np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts]))
            for a in range(0, len(block.ids), 512):
                bound = tree.bounds(block.points[a : a + 512])
                for i in range(a, min(a + 512, len(block.ids))):
                    tree.search(block.points[i], int(block.ids[i]), bound[i - a], k, found[n][i], block.floor[i])

        for batch in batches:
            for n, ids, points in by_length(*whole(batch)):
                if n in sent.value:
                    for a in range(0, len(ids), SHARD):
                        waiting.setdefault(n, []).append((ids[a : a + SHARD], points[a : a + SHARD]))
                        if sum(len(i) for i, _ in waiting[n]) >= SHARD:
                            visit(n)
        for n in list(waiting):
            visit(n)
        rows = [(int(q), -v, s) for n, b in sent.value.items() for q, best in zip(b.ids, found[n], strict=True) for s, v in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """vectors, queries: vec_id long, embedding array of numbers. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    if shards:
        vectors = vectors.repartition(shards)
    few = _numpy(vectors.where("vec_id is not null").withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id").limit(SEEDS))
    seeds = {n: (i, p) for n, i, p in by_length(*few)}
    n_blocks = -(-queries.count() // block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = None
    for b in range(n_blocks):
        # a block is queries of one hash class: about ``block`` of them, the only ones that the driver holds
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)
        blocks = {}
        for n, ids, points in by_length(*_numpy(part)):
            place = np.lexsort((*points.T[::-1], ids))
            ids, points = ids[place], points[place]
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            blocks[n] = Block(ids[first], points[first], *seeds.get(n, (np.zeros(0, np.int64), np.zeros((0, n)))), k)
        if blocks:
            sent = spark.sparkContext.broadcast(blocks)
            rows = search_block(vectors, sent, k)
            rows = rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if n_blocks > 1:  # a block's rows are written before the next one begins
                rows = written(rows, "topk")
                sent.unpersist()
            merged = rows if merged is None else merged.unionByName(rows)
    if merged is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return merged


def _numpy(df: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """A bounded frame on the driver."""
    ids, vectors = [], []
    for batch in df.select("vec_id", "embedding").toArrow().to_batches():
        i, v = whole(batch)
        ids.append(i)
        vectors += v
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), vectors


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT vec_id, len(e) AS n, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY ALL) q JOIN v c ON q.vec_id <> c.vec_id AND q.n = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
