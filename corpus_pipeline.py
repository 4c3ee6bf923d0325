"""A corpus pipeline of five stages over ``documents``.

Each stage gets what its predecessor kept, as a table that was written and read again. All but the last
return the columns of ``documents``.

1. language ID: rejects documents without a letter and those whose language can't be told.
2. n-gram Jaccard join: of each group of linked documents the one of the least doc_id stays.
3. secret scans: every document stays; base and owner-specific secrets in its text are masked.
4. mixing sources: documents are taken as often as the targets ask, none or up to twice.
5. byte-level BPE: doc_id, source, n_tokens, ids and their digests for each document taken.

Stages that run Python bound the bytes of the session's Arrow batches (shared.BATCH_BYTES).

Stages 1, 2 and 5 can't be said in SQL, so ORACLE_SQL is None; tests/llm/test_pipeline.py holds every stage against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from cadence.llm import bpe, jaccard, language, mixing, secrets
from cadence.llm.shared import documents, small_batches, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = public_tokenizers.path(bpe.VOCABULARY)
    return bpe.with_tokens(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN, digests=True, keep_text=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
