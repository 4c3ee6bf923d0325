"""Language identification by word-first backoff.

A word that some language's learned list has is scored in every language by its log frequency
there (a fixed penalty where it is missing); any other word falls back to its character n-grams
of the longest order of which one is known, down to single letters. A text's score in a language
is the mean over its words, and the highest wins.

What is learned: all words and n-grams, counted by language, of a sample of at most ``SAMPLE``
labelled rows (those of the lowest hashes of all columns used; a documented bound, which bounds
the model too). A word or n-gram stands as a 64-bit hash of its bytes, so the model is a sorted
array of hashes and a matrix of float32 for each order, and it is broadcast.

Null text, or one without a letter: ``und``, score 0. No labelled row at all: every text is ``und``.
Whole texts are read, however long; rows that repeat count as often as they come; ties go to the
language that is first by code point. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import hash_spans
from .shared import clean_name, documents, fold, give_back, id_text

SAMPLE, ORDER = 12_000, 5
UND = "und"
WORDS = re.compile(r"[^\W\d_]+")
SPREAD = 3.0
#: Words that a worker remembers between batches.
MOST_KNOWN = 60_000


class Spans:
    """The n-grams of many words at once: words side by side in UTF-8, each between two spaces."""

    def __init__(self, words: list[str]):
        raw = [f" {w} ".encode() for w in words]
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        self.data, self.n = data, len(raw)
        starts = np.flatnonzero((data[: len(data) - 8] & 0xC0) != 0x80)
        self.starts = np.append(starts, len(data) - 8)
        self.word = np.searchsorted(ends, starts, "right")
        per = np.bincount(self.word, minlength=self.n)
        first = np.cumsum(per) - per
        self.place = np.arange(len(starts)) - first[self.word]
        self.left = per[self.word] - self.place
        self.begin, self.size = ends - size + 1, size - 2

    def words(self) -> np.ndarray:
        """A hash of each word."""
        return hash_spans(self.data, self.begin, self.size)

    def grams(self, order: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams, and the word of each. Single letters come without the spaces. of: which words (all)."""
        ok = (self.left >= order) if order > 1 else (self.place > 0) & (self.left > 1)
        if of is not None:
            ok &= of[self.word]
        at = np.flatnonzero(ok)
        begin = self.starts[at]
        return hash_spans(self.data, begin, self.starts[at + order] - begin), self.word[at]


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


class Table:
    """Sorted hashes, and their log10 frequencies in each language."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        self.hashes, self.logs = hashes, logs

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash, and whether it is known."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


class Model:
    """tables: of words (0) and of n-grams by order."""

    def __init__(self, languages: list[str], tables: list[Table]):
        self.languages, self.tables = languages, tables

    def rows(self, words: list[str]) -> np.ndarray:
        """A row of log10 frequencies for each word."""
        out = np.zeros((len(words), len(self.languages)))
        spans = Spans(words)
        at, known = self.tables[0].find(spans.words())
        out[known] = self.tables[0].logs[at[known]]
        open_ = ~known
        for order in range(ORDER, 0, -1):
            if not open_.any():
                break
            h, word = spans.grams(order, open_)
            at, known = self.tables[order].find(h)
            at, word = at[known], word[known]
            n = np.bincount(word, minlength=len(words))
            have = np.flatnonzero(n)
            for k in range(len(self.languages)):
                out[have, k] = np.bincount(word, self.tables[order].logs[at, k], len(words))[have] / n[have]
            open_ &= n == 0
        return out

    def start(self) -> None:
        """A reader of its own, for single texts."""
        self.reader = Reader(self)

    def score(self, text: str | None) -> tuple[str, float]:
        names, best = self.reader.score([text])
        return names[0], float(best[0])


class Reader:
    """What a task keeps while it reads texts: a row for each word met, emptied when there are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros((0, len(self.model.languages)))
        self.at: dict[str, int] = {}

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        m = self.model
        if not m.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        if len(self.at) > MOST_KNOWN:
            self.clear()
        counts = [Counter(WORDS.findall((t or "").lower())) for t in texts]
        new = list({w: None for c in counts for w in c if w not in self.at})
        if new:
            letters = np.fromiter(map(has_letter, new), bool, len(new))
            have = [w for w, ok in zip(new, letters, strict=True) if ok]
            first = len(self.table)
            self.table = np.concatenate([self.table, m.rows(have)])
            self.at.update({w: -1 for w, ok in zip(new, letters, strict=True) if not ok})
            self.at.update(zip(have, range(first, first + len(have)), strict=True))
        names, best = [], np.zeros(len(texts))
        for i, c in enumerate(counts):
            which = np.fromiter(map(self.at.__getitem__, c), np.int64, len(c))
            n = np.fromiter(c.values(), np.float64, len(c)) * (which >= 0)
            seen = n.sum()
            if not seen:
                names.append(UND)
                continue
            mean = n @ self.table[which] / seen * SPREAD * min(seen, 20) ** 0.5
            p = np.exp((mean - mean.max()) * math.log(10))
            k = int(p.argmax())
            names.append(m.languages[k])
            best[i] = p[k] / p.sum()
        return names, best


def counted(sample: DataFrame) -> DataFrame:
    """lang, order (0: words), x (hash), n: what each task counts in its rows; the engine sums it up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words[lang].update(WORDS.findall((text.as_py() or "").lower()))
            for lang, found in words.items():
                have = [w for w in found if has_letter(w)]
                if not have:
                    continue
                n = np.fromiter(map(found.__getitem__, have), np.int64, len(have))
                spans = Spans(have)
                for order in range(ORDER + 1):
                    h, word = spans.grams(order) if order else (spans.words(), np.arange(len(have)))
                    x, at = np.unique(h, return_inverse=True)
                    sums = np.bincount(at, n[word], len(x)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(np.full(len(x), order, np.int32)), pa.array(x.view(np.int64)), pa.array(sums)], names=["lang", "order", "x", "n"])
        give_back()

    return sample.select("lang", "text").mapInArrow(run, "lang string, order int, x long, n long")


def _table(x: np.ndarray, lang: np.ndarray, n: np.ndarray, size: int) -> Table:
    """Log10 frequencies; the penalty of a language that lacks x is under its rarest."""
    sums = np.bincount(lang, n, size)
    logs = np.where(sums > 0, -np.log10(sums + 1) - 0.5, -7.0)
    hashes, at = np.unique(x, return_inverse=True)
    out = np.repeat(logs[None].astype(np.float32), len(hashes), axis=0)
    out[at, lang] = np.log10(n / sums[lang])
    return Table(hashes, out)


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """``sample`` rows (text, lang) of the lowest hashes; of rows that repeat at the edge as many as it takes."""
    rows = labelled.where("lang is not null and text is not null")
    rows = rows.select("text", "lang", F.xxhash64(id_text(), "lang", "text").alias("_h"))
    last = rows.select("_h").orderBy("_h").limit(sample).groupBy("_h").agg(F.count("*").alias("n")).orderBy(F.desc("_h")).first()
    if last is None:
        return rows.limit(0)
    return rows.where(F.col("_h") < last["_h"]).unionByName(rows.where(F.col("_h") == last["_h"]).limit(last["n"]))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, lang. Rows of null lang or text don't count."""
    # rows of a sample's words and n-grams: bounded as the sample is
    found = counted(sampled(labelled, sample)).groupBy("lang", "order", "x").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    have = names.dictionary.to_pylist()
    languages = sorted(have)
    rank = np.array([languages.index(k) for k in have], np.int64)
    lang = rank[names.indices.to_numpy()] if have else np.zeros(0, np.int64)
    order, x, n = (found.column(c).to_numpy() for c in ("order", "x", "n"))
    tables = []
    for k in range(ORDER + 1):
        here = order == k
        tables.append(_table(x[here].astype(np.int64).view(np.uint64), lang[here], n[here].astype(np.float64), len(languages)))
    return Model(languages, tables)


def prediction(spark: SparkSession, model: Model, text: str) -> Column:
    """struct<lang_pred, score> of a text column. Only the text is sent to Python."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(sent.value)
        for batch in texts:
            names, scores = [], []
            for first in range(0, len(batch), 512):
                a, b = reader.score([x.as_py() for x in batch.slice(first, 512)])
                names += a
                scores.append(b)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang_pred", "score"])
            give_back()

    return predicted(F.col(f"`{text}`"))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score."""
    hidden = clean_name(*keep, stem="_p")
    found = docs.select(*(F.col(f"`{c}`") for c in keep), prediction(docs.sparkSession, model, text).alias(hidden))
    return found.select(*(F.col(f"`{c}`") for c in keep), F.col(f"{hidden}.lang_pred"), F.col(f"{hidden}.score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold(5) == 0)
    model = fit(docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is told: not ``und``, and with a score of ``least`` or more."""
    names = docs.columns
    model = fit(docs.where(fold(5) != 0).select("doc_id", "text", "lang"))
    hidden = clean_name(*names, stem="_p")
    found = docs.withColumn(hidden, prediction(docs.sparkSession, model, "text"))
    return found.where((F.col(f"{hidden}.lang_pred") != UND) & (F.col(f"{hidden}.score") >= least)).select(*(F.col(f"`{c}`") for c in names))
