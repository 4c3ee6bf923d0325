"""Secret scans with corpus-wide ownership.

Every text is scanned for candidates: the three base kinds, and ``opaque`` strings (20 or
more of [A-Za-z0-9+/_-] with letters and digits in disorder, outside base spans). A candidate's
value goes on as a hash; the hashes are counted over the whole corpus by distinct repositories
and owners. A value that more than ``LIVE_OWNERS`` owners or ``LIVE_REPOSITORIES`` repositories
have is an example that was copied about; one that belongs to few looks live. Base spans always
stay; opaque ones are added when they look live.

Counts are over distinct (hash, repository, owner), pre-aggregated, and a value that many rows
share is joined by broadcast (shared.join_uneven), so that no task gets all its rows. Null text
counts as empty, null repository or owner as one of its own. Repeated rows each get their spans.
Texts of any length are scanned whole. An empty table gives no rows. ``documents`` names no
repository: there, a source is an owner, and a thousand of its ids a repository.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import brought_back, documents, give_back, join_uneven, set_aside, written

#: Letters in either case are ASCII ones only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so this is [0-9a-f]+ of 24 or more
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "opaque")
#: A value that more owners than this have is a copied example.
LIVE_OWNERS = 2
#: The same for repositories, of whichever owners.
LIVE_REPOSITORIES = 8
#: The repository of a row of ``documents``.
REPOSITORY = "concat_ws('/', source, cast(floor(doc_id / 1000) as string))"
#: Bits a character from which an opaque string is in disorder.
ENTROPY = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def disorder(value: str) -> bool:
    """Letters and digits mixed, as in keys, unlike words, paths, plain numbers or rules of dashes."""
    digits = sum(c.isdigit() for c in value)
    return digits >= 3 and sum(c.isalpha() for c in value) >= 3 and entropy(value) >= ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(begin, kind, end, value) of base candidates, in the order of the digest."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    return [(m.start(), 3, m.end(), m[0]) for m in OPAQUE.finditer(text) if disorder(m[0]) and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]


def label(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


FOUND = "_key string, n_assign long, n_access long, n_hex long, base_sha256 string, _cand array<struct<begin:int,kind:int,end:int,hash:string>>"
CAND = pa.list_(pa.struct([("begin", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))


def found_in(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What the scan of a text finds. _key: a digest of the text."""
    for batch in texts:
        out: dict[str, list] = {n: [] for n in ("key", "a", "b", "c", "sha", "cand")}
        for x in batch:
            text = x.as_py() or ""
            base = base_spans(text)
            kinds = Counter(k for _, k, _, _ in base)
            spans = sorted(base + more_spans(text, base))
            out["key"].append(xxhash.xxh3_128_hexdigest(text.encode()))
            for k, n in enumerate("abc"):
                out[n].append(kinds[k])
            out["sha"].append(hashlib.sha256(label(base).encode()).hexdigest())
            out["cand"].append([{"begin": a, "kind": k, "end": b, "hash": xxhash.xxh3_128_hexdigest(v.encode())} for a, k, b, v in spans])
        arrays = [pa.array(out["key"], pa.string()), *(pa.array(out[n], pa.int64()) for n in "abc"), pa.array(out["sha"], pa.string()), pa.array(out["cand"], CAND)]
        yield pa.StructArray.from_arrays(arrays, names=["_key", "n_assign", "n_access", "n_hex", "base_sha256", "_cand"])
        give_back()


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and FOUND of ``text``. Only the text is sent to Python."""
    found = docs.select(*(F.col(f"`{c}`") for c in keep), F.arrow_udf(found_in, FOUND)(F.col("text")).alias("_found"))
    return found.select(*(F.col(f"`{c}`") for c in keep), "_found.*")


def ownership(each: DataFrame, repository: str, owner: str) -> DataFrame:
    """hash, _n (rows of ``each``), repositories, owners: distinct ones of every candidate value."""
    rows = each.groupBy("hash", F.col(repository).alias("_r"), F.col(owner).alias("_o")).agg(F.count("*").alias("_n"))
    pair = lambda c: F.struct(F.col(c))  # noqa: E731  a null name counts as one
    return rows.groupBy("hash").agg(F.sum("_n").alias("_n"), F.count_distinct(pair("_r")).alias("repositories"), F.count_distinct(pair("_o")).alias("owners"))


def spans_text(cand: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(cand), lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["begin"].cast("string"), x["end"].cast("string"))), ",")


def owned(found: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """``found`` (scanned() in a written table) with _cand cut to base and live spans, and n_live, n_copied.

    Only rows with candidates are joined; the others pass by.
    """
    none = F.size("_cand") == 0
    zero = F.lit(0).cast("long")
    key = ["doc_id", "_key", *dict.fromkeys([repository, owner])]
    some = found.where(~none)
    each = some.select(*key, F.explode("_cand").alias("c")).distinct()
    each = written(each.withColumn("hash", F.col("c.hash")), "candidates")
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    each = join_uneven(each, ownership(each, repository, owner), "hash", each.count())
    spans = each.groupBy(*key).agg(
        F.collect_list(F.when(live | (F.col("c.kind") < 3), F.col("c"))).alias("_kept"),
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_copied"),
    )
    spans = spans.select(*(F.col(k).alias(f"_of{k}") for k in key), "_kept", "n_live", "n_copied")
    on = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in key]
    some = some.join(spans, on, "left").drop(*(f"_of{k}" for k in key)).withColumn("_cand", F.array_sort("_kept")).drop("_kept")
    return found.where(none).withColumns({"n_live": zero, "n_copied": zero}).unionByName(some)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("_repository", F.expr(REPOSITORY))
    found = written(scanned(docs, ["doc_id", "source", "_repository"]), "secrets")
    return owned(found, "_repository").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text(F.col("_cand")).alias("spans"), "n_live", "n_copied")


def masked(text: Column, cand: Column, mark: str) -> Column:
    """``text`` with each span replaced by ``mark``; spans that overlap become one."""

    def step(done: Column, c: Column) -> Column:
        more = F.when(c["begin"] >= done["at"], F.concat(F.substring(text, done["at"] + 1, c["begin"] - done["at"]), F.lit(mark))).otherwise("")
        return F.when(c["end"] <= done["at"], done).otherwise(F.struct(F.concat(done["out"], more).alias("out"), c["end"].alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(cand, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with base and live secrets replaced by ``mark``, n_chars anew; every document stays.

    Null texts stay null. Extra columns of any name come through.
    """
    docs, own = set_aside(docs, "doc_id", "source", "text")
    names = docs.columns
    found = owned(written(scanned(docs.withColumn("_repository", F.expr(REPOSITORY)), [*names, "_repository"]), "secrets"), "_repository")
    hit = F.size("_cand") > 0
    changed = {"text": F.when(hit, masked(F.col("text"), F.col("_cand"), mark)).otherwise(F.col("text"))}
    found = found.withColumns(changed)
    if n_chars := own.get("n_chars"):
        found = found.withColumn(n_chars, F.when(hit, F.length("text").cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return brought_back(found.select(*names), own)
