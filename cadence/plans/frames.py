"""Queries over whole frames: each vector of ``embeddings`` is a frame of 64 x 64, each label a clip.

SQL can't say these; tests hold the operators against synthetic clips with known results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.kernels import plane
from cadence.operators import holds, motion, quality, restore
from cadence.operators.tables import image

SIDE, CELL = 8, 8
#: On these frames a hold is a pair whose hashes and differences are as near as the tables have them.
LOOSE = holds.Thresholds(hash=28, diff=40.0, similarity=0.2, span=3)


def tile(vectors: pa.Array) -> pa.Array:
    """8 x 8 values from -1 to 1 as squares of a 64 x 64 frame; vectors of another length are cut or filled up with 0."""
    out = []
    for v in vectors:
        x = np.zeros(SIDE * SIDE, np.float32)
        found = np.nan_to_num(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32))[: len(x)]
        x[: len(found)] = found
        out.append(np.kron(plane.rounded(127.5 + 127.5 * x).reshape(SIDE, SIDE), np.ones((CELL, CELL), np.uint8)).tobytes())
    return pa.array(out, pa.binary())


def carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FRAME rows of the vectors that there are, numbered within their label by vec_id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    side = F.lit(SIDE * CELL)
    return rows.select(F.col("label").cast("string").alias("clip"), number.cast("long").alias("frame_idx"), side.alias("h"), side.alias("w"), F.lit(1).alias("c"), F.lit("uint8").alias("dtype"), F.arrow_udf(tile, "binary")("embedding").alias("data"))


def measured(frames: DataFrame, schema: str, f) -> DataFrame:
    """clip, frame_idx and what ``f`` says of each frame."""

    def run(h: pa.Array, w: pa.Array, c: pa.Array, dtype: pa.Array, data: pa.Array) -> pa.Array:
        names = ["h", "w", "c", "dtype", "data"]
        rows = [f(image(dict(zip(names, r, strict=True)))) for r in zip(*(x.to_pylist() for x in (h, w, c, dtype, data)), strict=True)]
        fields = [x.split() for x in schema.split(", ")]
        kinds = {"double": pa.float64(), "long": pa.int64()}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    return frames.select("clip", "frame_idx", F.arrow_udf(run, schema)("h", "w", "c", "dtype", "data").alias("m")).select("clip", "frame_idx", "m.*")


def pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = holds.pairs(holds.features(carrier(spark, sf_dir)), LOOSE)
    return found.withColumn("same", holds.same_drawing(LOOSE)).drop("dusty")


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holds.document(holds.detect(carrier(spark, sf_dir), t=LOOSE, dust_robust=True))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = carrier(spark, sf_dir)
    return restore.group_stats(holds.detect(frames, t=LOOSE), frames).drop("reference")


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = carrier(spark, sf_dir)
    out = restore.denoise(holds.detect(frames, t=LOOSE), frames, restore.Settings(mode="full"))
    return out.select("clip", "frame_idx", "h", "w", F.crc32("data").alias("crc"))


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = carrier(spark, sf_dir)
    return restore.defect_document(holds.detect(frames, t=LOOSE), frames)


def motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = carrier(spark, sf_dir)
    return motion.motion_document(holds.detect(frames, t=LOOSE), frames, motion.Limits(rounds=10))


def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(carrier(spark, sf_dir), "hf_noise double, sharpness double, flat_share double", lambda x: (quality.hf_noise(x), quality.sharpness(x), float(quality.flat(x).mean())))


def bright_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parts(x: np.ndarray) -> tuple:
        _, s = plane.components(x > 160)
        k = int(s["area"].argmax()) if len(s["area"]) else None
        return (len(s["area"]), 0, 0, 0) if k is None else (len(s["area"]), int(s["area"][k]), int(s["height"][k]), int(s["width"][k]))

    return measured(carrier(spark, sf_dir), "parts long, largest long, height long, width long", parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(carrier(spark, sf_dir), "edge_pixels long, line_pixels long, crc long", lambda x: (int(plane.canny(x).sum()), int(plane.line_art(x).sum()), zlib.crc32(plane.median3(x).tobytes())))


QUERIES = {
    "a2_pair_measures": pair_measures,
    "c20_detection_document": detection,
    "c6_group_analysis": analysis,
    "c8_denoised_frames": denoised,
    "c17_defect_document": defects,
    "c19_motion_document": motions,
    "a26_frame_quality": sharpness,
    "k5_components": bright_parts,
    "k6_edges": edges,
}
