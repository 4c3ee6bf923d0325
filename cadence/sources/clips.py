"""Frames in and out: clips as numpy files, directories of numbered PNG files, host images of floats.

A clip is a .npy file (frames x height x width x channels). ``register`` offers it as the format ``clip``, whose
partitions are ranges of frames and whose filters on frame_idx cut them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from cadence.operators.tables import FRAME, frame_row, image
from cadence.sources import png

ROWS = pa.schema([("clip", pa.string()), ("frame_idx", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("dtype", pa.string()), ("data", pa.binary())])


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ClipReader(DataSourceReader):
    """Options: path; start (0); end (the last frame; beyond the end of the clip: its last frame); frames (of a partition, 16)."""

    def __init__(self, options: dict):
        path = options["path"]
        self.paths = sorted(str(p) for p in Path(path).glob("*.npy")) if os.path.isdir(path) else [path]
        self.first, self.last = int(options.get("start", 0)), int(options["end"]) if options.get("end") else None
        self.size = int(options.get("frames", 16))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_idx",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif getattr(f, "attribute", None) == ("frame_idx",) and isinstance(f, (LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.last = most if self.last is None else min(self.last, most)
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            if not os.path.exists(path):
                raise OSError(f"can't open the clip {path}")
            last = len(np.load(path, mmap_mode="r")) - 1
            last = last if self.last is None else min(last, self.last)
            out += [Range(path, a, min(a + self.size - 1, last)) for a in range(self.first, last + 1, self.size)]
        return out or [Range("", 0, -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.last < part.first:
            return
        clip = np.load(part.path, mmap_mode="r")
        for i in range(part.first, part.last + 1):
            yield pa.RecordBatch.from_pylist([frame_row(Path(part.path).stem, i, np.asarray(clip[i]))], ROWS)


class ClipWriter(DataSourceArrowWriter):
    """Frames as PNG files, a directory for each clip, each put in place whole."""

    def __init__(self, options: dict):
        self.path = Path(options["path"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for batch in batches:
            for row in batch.to_pylist():
                folder = self.path / row["clip"]
                folder.mkdir(parents=True, exist_ok=True)
                name = folder / f"frame_{row['frame_idx']:06d}.png"
                part = name.with_suffix(f".{os.getpid()}")
                part.write_bytes(png.encode(image(row)))
                part.replace(name)
        return WriterCommitMessage()


class ClipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> ClipReader:
        return ClipReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ClipWriter:
        return ClipWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClipSource)


def read_clip(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Frames ``start`` to ``end`` (with it) of a clip, or of all clips of a directory; fewer if the clip ends before."""
    register(spark)
    options = {"path": path, "start": str(start)} | ({"end": str(end)} if end is not None else {})
    return spark.read.format("clip").options(**options).load()


def read_directory(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """``frame_*.png`` in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.png").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, idx, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield pa.RecordBatch.from_pylist([frame_row(name, idx, png.decode(raw))], ROWS)

    folder = F.lit(clip) if clip else F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    number = F.regexp_extract("path", r"frame_(\d+)\.png$", 1).cast("long")
    return files.select(folder.alias("clip"), number.alias("idx"), "content").mapInArrow(run, FRAME)


def frame_at(frames: DataFrame, clip: str, idx: int) -> np.ndarray:
    """One frame; raises if it isn't there."""
    found = frames.where((F.col("clip") == clip) & (F.col("frame_idx") == idx)).take(1)
    if not found:
        raise LookupError(f"no frame {idx} in {clip}")
    return image(found[0].asDict())


def write_frames(frames: DataFrame, path: str) -> None:
    """PNG files, a directory a clip, in order within each task."""
    register(frames.sparkSession)
    frames.repartitionByRange("clip", "frame_idx").sortWithinPartitions("clip", "frame_idx").write.format("clip").mode("append").option("path", path).save()


def side_by_side(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Left half of the original, right half of the processed frame, a red line of two pixels between."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for h, w, c, a, b in zip(*(x.to_pylist() for x in columns), strict=True):
            x, y = (np.frombuffer(v, np.uint8).reshape(h, w, c) for v in (a, b))
            z = x.copy()
            z[:, w // 2 :] = y[:, w // 2 :]
            z[:, max(w // 2 - 1, 0) : w // 2 + 1] = [0, 0, 255][:c]
            out.append(z.tobytes())
        return pa.array(out, pa.binary())

    after = processed.select("clip", "frame_idx", F.col("data").alias("_after"))
    return original.join(after, ["clip", "frame_idx"]).select("clip", "frame_idx", "h", "w", "c", "dtype", F.arrow_udf(run, "binary")("h", "w", "c", "data", "_after").alias("data"))


def to_host(frame: np.ndarray, source: np.ndarray, left: int = 0, top: int = 0) -> np.ndarray:
    """A blue-green-red frame of bytes, placed at (left, top), as red-green-blue-alpha floats of the size of ``source``, whose alpha stays; beyond the frame its edge goes on."""
    h, w = source.shape[:2]
    y, x = (np.clip(np.arange(n) - a, 0, m - 1) for n, a, m in ((h, top, frame.shape[0]), (w, left, frame.shape[1])))
    out = source.astype(np.float32).copy()
    out[..., :3] = frame[np.ix_(y, x)][..., ::-1] / np.float32(255)
    return out


def from_host(host: np.ndarray) -> np.ndarray:
    """Floats (red, green, blue, alpha) to blue-green-red bytes, rounded and saturated."""
    return np.clip(np.floor(host[..., 2::-1] * 255 + 0.5), 0, 255).astype(np.uint8)
