"""Queries as SQL over named subqueries, for Spark, with the other dialect for the checks.

A query is a pair: the carriers it stands on, and a SELECT. ``carriers`` are named subqueries that
turn a driver table into frame-like rows. Where the engines differ, ``@name(...)`` stands for the
function of either: see DIALECTS.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "events embeddings lineitem orders customer documents labels conversations pages".split()

#: name: (Spark, DuckDB)
DIALECTS = {
    "@quantile": ("percentile", "quantile_cont"),
    "@xor": ("cadence_xor", "xor"),
    "@pixels": (
        "SELECT shot, f, g, p, 127.5e0 + 127.5e0 * CAST(x AS DOUBLE) AS v FROM (SELECT shot, f, CAST(floor(f / 5e0) AS BIGINT) AS g, embedding FROM vectors) LATERAL VIEW posexplode(embedding) AS p, x",
        "SELECT shot, f, CAST(floor(f / 5e0) AS BIGINT) AS g, i - 1 AS p, 127.5e0 + 127.5e0 * CAST(embedding[i] AS DOUBLE) AS v FROM vectors, unnest(range(1, 65)) AS t(i)",
    ),
    # the median of v over the frame w; Spark's median() takes no frame
    "@framed_median": (
        "((element_at(sort_array(collect_list(v) OVER w), CAST(floor(((count(*) OVER w) + 1) / 2e0) AS INT)) + element_at(sort_array(collect_list(v) OVER w), CAST(floor((count(*) OVER w) / 2e0) AS INT) + 1)) / 2e0)",
        "(median(v) OVER w)",
    ),
    # the k that greedy suppression keeps: by snr, each more than 2 from all kept before it
    "@kept": (
        "aggregate(transform(sort_array(collect_list(struct(-snr AS s, CAST(k AS BIGINT) AS k))), x -> x.k), CAST(array() AS ARRAY<BIGINT>), (kept, x) -> CASE WHEN exists(kept, o -> abs(o - x) <= 2) THEN kept ELSE concat(kept, array(x)) END)",
        "list_reduce(list([CAST(k AS BIGINT)] ORDER BY snr DESC, k), lambda kept, x: CASE WHEN len(list_filter(kept, lambda o: abs(o - x[1]) <= 2)) > 0 THEN kept ELSE list_concat(kept, x) END)",
    ),
    "@hour": ("date_trunc('hour', ts)", "date_trunc('hour', ts)"),
    "@json_k": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
}

CARRIERS = {
    # ordered frames of a shot: luma by time
    "frames": "SELECT user_id AS shot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, value AS luma, event_type FROM events",
    "pairs": "SELECT shot, f, luma, event_type, lag(luma) OVER (PARTITION BY shot ORDER BY f) AS before FROM frames",
    # gaps and islands: a frame unlike the one before begins a group
    "marked": "SELECT shot, f, luma, CASE WHEN before IS NULL THEN 1e0 ELSE greatest(0e0, (40e0 - abs(luma - before)) / 40e0) END AS confidence, sum(CASE WHEN abs(luma - before) < 40e0 THEN 0 ELSE 1 END) OVER (PARTITION BY shot ORDER BY f) AS mark FROM pairs",
    "groups": "SELECT shot, CAST(row_number() OVER (PARTITION BY shot ORDER BY min(f)) - 1 AS BIGINT) AS ord, CAST(min(f) AS BIGINT) AS first, CAST(max(f) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n, avg(confidence) AS confidence, avg(luma) AS luma FROM marked GROUP BY shot, mark",
    "vectors": "SELECT label AS shot, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, embedding FROM embeddings WHERE embedding IS NOT NULL",
    "px": "@pixels",
    "hours": "SELECT row_number() OVER (ORDER BY h) - 1 AS i, med, mean FROM (SELECT @hour AS h, median(value) AS med, avg(value) AS mean FROM events GROUP BY 1)",
    "days": "SELECT row_number() OVER (ORDER BY d) - 1 AS i, v FROM (SELECT date_trunc('day', l_shipdate) AS d, median(l_extendedprice) AS v FROM lineitem GROUP BY 1)",
    # the columns of the rows of days: line numbers
    "cells": "SELECT dense_rank() OVER (ORDER BY d) - 1 AS i, x, v FROM (SELECT date_trunc('day', l_shipdate) AS d, l_linenumber AS x, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)",
    # labelled shots: quality is the label, the prediction a rule on the length
    "judged": "SELECT d.doc_id, d.source, d.lang, l.quality AS label, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS prediction FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL",
    # segments of a customer's orders by time, and their motion
    "moves": "SELECT shot, CAST(f AS BIGINT) AS f, tx, ty, sqrt(tx * tx + ty * ty) AS size FROM (SELECT shot, f, (luma - before) / 20e0 AS tx, (luma - lag(before) OVER (PARTITION BY shot ORDER BY f)) / 40e0 AS ty FROM pairs) WHERE tx IS NOT NULL AND ty IS NOT NULL",
}
CARRIERS["affine"] = "SELECT shot, f, tx, ty, size, (1e0 + ty / 500e0) * cos(tx / 200e0) AS m00, -(1e0 + ty / 500e0) * sin(tx / 200e0) AS m01, (1e0 + ty / 500e0) * sin(tx / 200e0) AS m10, (1e0 + ty / 500e0) * cos(tx / 200e0) AS m11 FROM moves"
NEEDS = {"affine": ["moves"], "pairs": ["frames"], "marked": ["pairs"], "groups": ["marked"], "px": ["vectors"], "moves": ["pairs"]}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_ordered(NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def render(carriers: str, body: str, dialect: int) -> str:
    """The whole statement; ``body`` may begin with subqueries of its own: ``name AS (...), ... SELECT``."""
    parts = [f"{n} AS ({CARRIERS[n]})" for n in _ordered(carriers.split())]
    own, _, select = body.rpartition("\nSELECT")
    text = "SELECT" + select if _ else body
    parts += [own.strip().rstrip(",")] if own.strip() else []
    out = ("WITH " + ("RECURSIVE " if "/*recursive*/" in body else "") + ",\n".join(parts) + "\n" if parts else "") + text
    # a value in the middle between two roundings goes up in either engine
    out = re.sub(r", ([346])\) AS ", lambda m: f" + 1e-9, {m[1]}) AS ", out)
    for name, forms in DIALECTS.items():
        out = out.replace(name, forms[dialect])
    return re.sub(r"cadence_xor\(([^,]+), ([^)]+)\)", r"(\1 ^ \2)", out)


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text), **tables)

    return run


def compile_all(named: dict[str, tuple[str, ...]]) -> tuple[dict, dict]:
    """name: (carriers, body), or (carriers, body, carriers and body that say the same in another way, for the check)."""
    return {k: query(render(v[0], v[1], 0)) for k, v in named.items()}, {k: render(*v[-2:], 1) for k, v in named.items()}
