"""Connected components of a graph of long ids, by alternating large and small stars.

Each round is two grouped aggregations over the edges; the edges go to the shared folder between
rounds, and nothing but their checksum comes to the driver. Hubs are split: a neighbourhood is
never gathered, only its minimum is, which aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, write_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each u's neighbours (only larger ones, or u and its smaller ones) go to the least of u's closed neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if not larger:
        pairs = pairs.unionAll(pairs.select("u", F.col("u").alias("v")))
    rows = pairs.where("v > u") if larger else pairs
    return rows.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns id, component (the least id it is joined to), for every id of an edge of two ids."""
    spark = edges.sparkSession
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        rows = spark.read.parquet(now)
        state = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if state == before or not state["n"]:
            return rows.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(rows.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
        done = _star(_star(_both(rows), True), False)
        following = write_table(done, "edges")
        drop_table(spark, now)
        now = following
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
