"""Labels as CSV, detections, motion and defects as JSON documents, and a run's failures.

Schemas are stated, never inferred; ids stay text ("0001" is no number).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "shot_id string, source_file string, frame_start string, frame_end string, koma_pattern string, global_motion string, local_motion string, defects_present string, intentional_effects string, source_type string, notes string"
DETECTIONS = "source_file string, shots array<struct<shot_id:string,frame_range:array<long>,dominant_koma_pattern:string,hold_groups:array<struct<start:long,end:long,pattern:string,confidence:double>>>>"
MOTIONS = (
    "source_file string, shots array<struct<shot_id:string,noise_floor:double,dominant_global_motion:string,camera_path:struct<direction_consistency:double,moving_transitions:int,median_translation_px:double,camera_shake:boolean>,"
    "global_motion:array<struct<start:long,end:long,type:string,params:map<string,double>,method:string,confidence:double>>,local_motion:array<struct<start:long,end:long,type:string,moving_ratio:double,largest_component_ratio:double,bbox:array<int>>>>>"
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One row a shot; blank cells are null, frame numbers longs, defects and effects lists (``none`` and blank: empty)."""
    rows = spark.read.schema(LABELS).option("header", True).option("encoding", "UTF-8").csv(path)
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), F.trim), lambda x: (x != "") & (x != "none"))
    blank = {c: F.when(F.trim(c) != "", F.trim(c)) for c in rows.columns}
    rows = rows.withColumns(blank)
    whole = lambda c: F.expr(f"CAST(TRY_CAST({c} AS double) AS long)")  # noqa: E731  1.0 counts as 1
    return rows.withColumns({"frame_start": whole("frame_start"), "frame_end": whole("frame_end"), "defects_present": listed("defects_present"), "intentional_effects": listed("intentional_effects")})


def shots_of(labels: DataFrame, clip: str) -> DataFrame:
    """The shots of the file whose name ends with ``clip``, those with a range."""
    return labels.where(F.col("source_file").endswith(clip) & F.col("frame_start").isNotNull() & F.col("frame_end").isNotNull())


def read_detections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """lines: a document on each line, as write_documents() has them; else a file is one document. Returns source_file, shot_id, frame_range, dominant_koma_pattern, group_ord, start, end, pattern, confidence; shots without groups have one row of nulls."""
    shots = spark.read.schema(DETECTIONS).option("multiLine", not lines).json(path).select("source_file", F.explode("shots").alias("s")).select("source_file", "s.*")
    found = shots.select("source_file", "shot_id", "frame_range", "dominant_koma_pattern", F.posexplode_outer("hold_groups").alias("group_ord", "g"))
    return found.select("source_file", "shot_id", "frame_range", "dominant_koma_pattern", "group_ord", "g.*")


def read_motions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Shots of a motion document, or of all ``*_motion.json`` of a directory, with the file's stem."""
    rows = spark.read.schema(MOTIONS).option("multiLine", not lines).option("pathGlobFilter", "*_motion.json").json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)_motion\.json$", 1)
    return rows.select(stem.alias("stem"), "source_file", F.explode("shots").alias("s")).select("stem", "source_file", "s.*")


def write_documents(documents: DataFrame, path: str) -> None:
    """A JSON line for each document."""
    documents.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_json(documents: DataFrame) -> list[dict]:
    """A few documents as Python has them."""
    return [json.loads(x) for x in documents.toJSON().collect()]


def merged(detections: list[DataFrame]) -> DataFrame:
    """Shots of several clips, each with its clip."""
    out = detections[0]
    for d in detections[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def each_step(items: list[str], steps: dict[str, Callable[[str], object]]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Results of every step on every item, and (item, step, error) of those that failed; the steps after a failed one are left out for its item."""
    done, failed = {}, []
    for item in items:
        for name, step in steps.items():
            try:
                done[item, name] = step(item)
            except Exception as e:  # noqa: BLE001  a run goes on with the next file
                failed.append((item, name, f"{type(e).__name__}: {e}"))
                break
    return done, failed
