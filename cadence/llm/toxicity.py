"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's score is the logistic of a bias and the weights of
its distinct words and of their stems (first ``STEMS`` bytes, as languages inflect); a document's score is the noisy-or of its sentences' scores. The weights are
trained from document labels alone, by gradient descent on the documents' log loss, and then tell
which sentences offend.

The model is fitted on at most ``SAMPLE`` labelled rows of each class (those of the lowest hashes; a
documented bound). Words and stems are counted in them first; those count that ``SUPPORT`` of the toxic
rows share, or ``FEW`` of them if their share of the toxic rows is ``PURE`` times that of the clean ones,
so that the words of a language with few rows count too. What is then collected are the hashes of those
by sentence. Scoring reads every text whole. Words and stems stand as
31-bit hashes.

Null or empty text: no sentence, so the score is the bias's. No label at all, or one class only:
score 0 for every text. Labels of unknown documents and null labels don't count; if one document
has several, the highest counts. Repeated rows score alike. Texts are read whole, a longer one in a window
of its own; columns other than doc_id and text are not read, so their names don't matter. The query returns
the offending sentences too, as begin and end in the text's UTF-8 bytes and their score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Window, hash_spans, row_sums, windows
from .shared import documents, fold, id_text

SAMPLE, BUCKETS, EPOCHS, RATE, DECAY = 3_000, 1 << 31, 120, 0.2, 2e-4
START = -6.0
#: A stem is so many first bytes of a longer word.
STEMS = (7, 8)
#: A word or stem counts if this share of the toxic rows has it,
SUPPORT = 0.02
#: or so many of them, and so many times the share of the clean rows that have it.
FEW, PURE = 4, 20
#: A sentence ends at one of these bytes.
ENDS = np.zeros(256, bool)
ENDS[[10, 13, 33, 46, 59, 63]] = True
#: A word is a run of ASCII letters and digits and of bytes of other characters.
INNER = np.array([(48 <= b < 58) or (97 <= b < 123) or b >= 128 for b in range(256)])


def sentences(w: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words and stems, sentence of each; row, begin and end of each sentence)."""
    data = w.data[: w.offsets[-1]]
    s_at, s_len, s_row = w.runs(~ENDS[data])
    at, length, _ = w.runs(INNER[data])
    where = np.searchsorted(s_at, at, "right") - 1
    spans = [(at, length, where, 0)]
    for n in STEMS:
        longer = length > n
        spans.append((at[longer], np.full(int(longer.sum()), n), where[longer], n))
    # a stem is another feature than the word of the same bytes
    hashes = [hash_spans(w.data, a, k) * np.uint64(2 * n + 1) for a, k, _, n in spans]
    bucket = (np.concatenate(hashes) >> np.uint64(33)).astype(np.int64)
    where = np.concatenate([x for _, _, x, _ in spans])
    return bucket, where, s_row, s_at, s_at + s_len


def distinct_words(bucket: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a sentence once."""
    key = np.unique(where * BUCKETS + bucket)
    return key % BUCKETS, key // BUCKETS


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def among(table: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket stands in the sorted ``table``, and whether it does."""
    if not len(table):
        return np.zeros(len(bucket), np.int64), np.zeros(len(bucket), bool)
    at = np.minimum(np.searchsorted(table, bucket), len(table) - 1)
    return at, table[at] == bucket


def noisy_or(logits: np.ndarray, rows: np.ndarray, n: int, bias: float) -> np.ndarray:
    """1 - the product of (1 - p) over a row's sentences; an empty row has one sentence without words."""
    dark = row_sums(softplus(logits), rows, n)
    dark[np.bincount(rows, minlength=n) == 0] = np.logaddexp(0.0, bias)
    return -np.expm1(-dark)


class Model:
    """used: sorted hashes, None if nothing was learned; weights: theirs."""

    def __init__(self, used: np.ndarray | None, weights: np.ndarray | None, bias: float):
        self.used, self.weights, self.bias = used, weights, bias


def counts(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Whether words or stems count that so many toxic and clean rows have."""
    return (toxic >= max(3, SUPPORT * n_toxic)) | ((toxic >= FEW) & (toxic * n_clean >= PURE * clean * n_toxic))


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray) -> Model:
    """bags: for each document its word buckets, their sentences (from 0), the number of sentences."""
    if not len(labels) or labels.min() == labels.max():
        return Model(None, None, START)
    first = np.cumsum([0, *(max(n, 1) for *_, n in bags)])
    bucket = np.concatenate([b for b, *_ in bags])
    where = np.concatenate([s + f for (_, s, _), f in zip(bags, first, strict=False)])
    doc = np.repeat(np.arange(len(bags)), np.diff(first))
    used, bucket = np.unique(bucket, return_inverse=True)
    n_s, n_d, y = int(first[-1]), len(bags), labels.astype(np.float64)
    pair = np.unique(doc[where] * np.int64(len(used)) + bucket)
    bad = y[pair // max(len(used), 1)] > 0
    toxic, clean = (np.bincount(pair[x] % max(len(used), 1), minlength=len(used)) for x in (bad, ~bad))
    often = counts(toxic, clean, int((y > 0).sum()), int((y <= 0).sum()))
    bucket, where = bucket[often[bucket]], where[often[bucket]]
    w, bias = np.zeros(len(used)), START
    m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = bias + np.bincount(where, w[bucket], n_s)
        dark = np.maximum(np.bincount(doc, softplus(z), n_d), 1e-9)
        p = -np.expm1(-dark)
        # d loss / d dark: 1 for clean documents, -(1 - p) / p for toxic ones; d dark / d z = logistic(z)
        slope = np.where(y > 0, -(1 - p) / p, 1.0) / n_d
        g = slope[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        gw, gb = np.bincount(bucket, g[where], len(used)) + DECAY * w, g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        rate = RATE * (1 - step / (EPOCHS + 1))
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        bias = min(bias - 0.3 * rate * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-9), -3.0)
    return Model(used[often], w[often], float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_h", F.xxhash64(id_text()))
    picked = None
    for kind in (1, 0):
        # ids of documents that there are, lowest hashes first
        part = known.where(F.col("toxic") > 0 if kind else F.col("toxic") <= 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        part = part.orderBy("_h").limit(sample).select("doc_id", F.lit(kind).alias("_y"))
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "_y")  # 2 * sample ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in windows(batch.column(0)):
                toxic = batch.column(1).slice(w.first, w.n).to_numpy() > 0
                bucket, where, s_row, *_ = sentences(w)
                x, row = distinct_words(bucket, s_row[where] if len(where) else where)
                x, at = np.unique(x, return_inverse=True)
                n = np.bincount(at[toxic[row]], minlength=len(x))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n), pa.array(np.bincount(at, minlength=len(x)) - n)], names=["x", "toxic", "clean"])

    sizes = {r["_y"]: r["n"] for r in picked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    found = rows.select("text", "_y").mapInArrow(count, "x long, toxic long, clean long").groupBy("x").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # at most as many as the toxic rows have words and stems, over 3
    found = found.where(F.col("toxic") >= 3).toArrow()
    x, toxic, clean = (found.column(k).to_numpy() for k in range(3))
    often = np.sort(x[counts(toxic, clean, sizes.get(1, 0), sizes.get(0, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in windows(batch.column(1)):
                bucket, where, s_row, *_ = sentences(w)
                _, kept = among(often, bucket)
                bucket, where = distinct_words(bucket[kept], where[kept])
                row = s_row[where] if len(where) else where
                cut, s_cut = np.searchsorted(row, np.arange(w.n + 1)), np.searchsorted(s_row, np.arange(w.n + 1))
                a = [bucket[i:j].astype("<i4").tobytes() for i, j in zip(cut, cut[1:], strict=False)]
                b = [(where[i:j] - f).astype("<i4").tobytes() for i, j, f in zip(cut, cut[1:], s_cut, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n), batch.column(2).slice(w.first, w.n), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(np.diff(s_cut))], names=["doc_id", "y", "words", "places", "n"])

    found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, words binary, places binary, n long")
    # one bag a document; the order of training sums is fixed, so that reruns agree
    found = sorted(found.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(r["words"], "<i4").astype(np.int64), np.frombuffer(r["places"], "<i4").astype(np.int64), r["n"]) for r in found]
    return train(bags, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score; with ``spans`` also offending: begin and end (bytes) and score of the sentences at 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for w in windows(batch.column(2)):
                p, hits = np.zeros(w.n), [[] for _ in range(w.n)]
                if m.weights is not None:
                    bucket, where, s_row, s_at, s_end = sentences(w)
                    _, hot = among(m.used, bucket)
                    bucket, where = distinct_words(bucket[hot], where[hot])
                    z = m.bias + row_sums(m.weights[among(m.used, bucket)[0]], where, len(s_row))
                    p = noisy_or(z, s_row, w.n, m.bias)
                    for i in np.flatnonzero(z >= 0) if spans else ():
                        a = w.offsets[s_row[i]]
                        hits[s_row[i]].append({"begin": int(s_at[i] - a), "end": int(s_end[i] - a), "score": float(1 / (1 + np.exp(-z[i])))})
                columns = [batch.column(0).slice(w.first, w.n), batch.column(1).slice(w.first, w.n), pa.array(p)]
                if spans:
                    columns.append(pa.array(hits, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "offending"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double" + ", offending array<struct<begin:int,end:int,score:double>>" * spans)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold(5) == 0)
    model = fit(docs.where("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, spans=True).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
