"""Mixing sources to target weights, with DataFrame operations only.

Each source gets a target number of words; a document's words are taken whole. What a
source's target holds beyond whole passes over the source is taken from the documents
whose hash is under a threshold. The threshold comes from histograms: words by source and
hash bucket give the bucket in which the budget ends, and only that bucket is split again,
LEVELS times, by three more hexadecimal digits of the hash. Thresholds of larger budgets lie
above those of smaller ones, so mixes are nested; nothing is sorted, and no step holds more
than 4096 rows a source.

Null text: size 0. Null source: a source of its own, last in order. Rows of one doc_id share
a hash, so they are taken or left together (a null id counts as the empty text). An empty
table gives an empty mix. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, brought_back, documents, id_text, set_aside, written

DIGITS, LEVELS = 3, 4
#: Sources up to which their thresholds are broadcast (one short row each); beyond it the join is left to Spark.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash_hex(doc_id: str = "doc_id") -> Column:
    return F.substring(F.md5(id_text(doc_id).cast("binary")), 1, DIGITS * LEVELS)


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each source: source, source_size, target.

    Targets are in proportion to the weights, dealt to the sources in order, sum to ``share``
    of all sizes, and stop at ``cap`` times the source; the excess goes to the others by weight.
    In order of cap over weight, the capped sources come first, so one running sum finds them.
    """
    one = Window.partitionBy()
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") - 1) % len(weights) + 1).cast("double")
    by_ratio = one.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda total, part: F.col(total) - F.coalesce(F.sum(part).over(before), F.lit(0.0))
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("_all", F.sum("source_size").over(one) * F.lit(float(share))).withColumn("_all_w", F.sum("_w").over(one))
    t = t.withColumn("_level", rest("_all", "_cap") / rest("_all_w", "_w")).withColumn("_rank", F.row_number().over(by_ratio))
    free = F.col("_cap") > F.col("_level") * F.col("_w")
    level = F.min(F.when(free, F.struct("_rank", "_level"))).over(one)["_level"]
    t = t.withColumn("_free", level)
    return t.select("source", "source_size", F.when(F.col("_free").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_free") * F.col("_w"))).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame, small: bool) -> DataFrame:
    """source, source_size, target, passes (whole ones), below (a document is taken once more if its hash is under it).

    sized: source, size, hash. goal: targets().
    """
    hint = F.broadcast if small else (lambda x: x)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("_rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = goal.where("_rest > 0").select(F.col("source").alias("_s"), "_rest", F.lit("").alias("_prefix"))
    for level in range(LEVELS):
        digits = F.substring("hash", level * DIGITS + 1, DIGITS)
        rows = sized.join(hint(state), F.col("source").eqNullSafe(F.col("_s")))
        if level:
            rows = rows.where(F.substring("hash", 1, level * DIGITS) == F.col("_prefix"))
        sums = rows.groupBy("_s", "_rest", "_prefix", digits.alias("_b")).agg(F.sum("size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_b"))
        state = sums.withColumn("_upto", upto).where("_rest > _upto - _sum and _rest <= _upto")
        state = state.select("_s", (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_rest"), F.concat("_prefix", "_b").alias("_prefix"), "_sum")
        state = state if level == LEVELS - 1 else state.drop("_sum")
    # documents of one full hash: all or none, whichever ends nearer to the target
    below = F.when(F.col("_sum") - F.col("_rest") < F.col("_rest"), F.concat("_prefix", F.lit("g"))).otherwise(F.col("_prefix"))
    ends = state.select("_s", below.alias("below"))
    return goal.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "passes", "below")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame, bool]:
    """The sized rows (doc_id, source, size, hash), thresholds() over them, and whether those are few."""
    sized = written(docs.select("doc_id", "source", word_count().alias("size"), hash_hex().alias("hash")), "sized")
    goal = written(targets(sized, weights, share, cap), "targets")
    small = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return sized, thresholds(sized, goal, small), small


def copies(hash_: Column) -> Column:
    """How often the mix takes a document of this hash, beside the columns of thresholds()."""
    return F.col("passes") + F.coalesce((hash_ < F.col("below")).cast("long"), F.lit(0))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, ends, small = mix(documents(spark, sf_dir))
    ends = ends.withColumnRenamed("source", "_source")
    rows = sized.join(F.broadcast(ends) if small else ends, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"))).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, a row for each time one is taken. Extra columns of any name come through."""
    docs, names = set_aside(docs, "doc_id", "source", "text")
    _, ends, small = mix(docs, **how)
    ends = ends.select(F.col("source").alias("_source"), "passes", "below")
    rows = docs.join(F.broadcast(ends) if small else ends, F.col("source").eqNullSafe(F.col("_source")))
    times = F.explode(F.sequence(F.lit(1).cast("long"), copies(hash_hex())))
    return brought_back(rows.where(copies(hash_hex()) > 0).select(*docs.columns, times.alias("_time")), names)


#: The same mix by sorting: DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12) AS h FROM {docs}),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM t),
w AS (SELECT *, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, n) AS k,
        (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lam
      FROM w WINDOW p AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lam, k) AS lam FROM l WHERE cap > lam * w),
g AS (SELECT source, source_size, CASE WHEN f.lam IS NULL THEN cap ELSE least(cap, f.lam * w) END AS target FROM l CROSS JOIN f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
s AS (SELECT source, h, sum(size)::BIGINT AS z FROM d GROUP BY ALL),
c AS (SELECT *, sum(z) OVER (PARTITION BY source ORDER BY h) AS upto FROM s),
e AS (SELECT c.source, CASE WHEN upto - (target - passes * source_size) < (target - passes * source_size) - (upto - z) THEN h || 'g' ELSE h END AS below
      FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
      WHERE target - passes * source_size > upto - z AND target - passes * source_size <= upto)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (d.size * (q.passes + CASE WHEN d.h < e.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
""".replace("{docs}", "documents")
