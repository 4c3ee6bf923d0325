"""Frame rows, and tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FRAME = "clip string, frame_idx long, h int, w int, c int, dtype string, data binary"
SHOT = "clip string, shot_id string, frame_start long, frame_end long"


def image(row: dict) -> np.ndarray:
    """The plane or frame of a row (h, w, c, dtype, data)."""
    data = np.frombuffer(row["data"], row["dtype"])
    return data.reshape(row["h"], row["w"], row["c"]) if row["c"] > 1 else data.reshape(row["h"], row["w"])


def frame_row(clip: str, idx: int, x: np.ndarray) -> dict:
    return {"clip": clip, "frame_idx": idx, "h": x.shape[0], "w": x.shape[1], "c": x.shape[2] if x.ndim == 3 else 1, "dtype": str(x.dtype), "data": np.ascontiguousarray(x).tobytes()}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines share; set here only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cadence-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: nothing before it is worked out twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
