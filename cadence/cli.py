"""``python -m cadence.cli``: detect, motion, defects, denoise, pipeline and evaluate over clips (.npy) or frame directories."""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import labels as L
from cadence.operators import holds, motion, restore
from cadence.sources import clips, documents


def frames_of(spark: SparkSession, path: str) -> DataFrame:
    folder = Path(path)
    return clips.read_directory(spark, path) if folder.is_dir() and any(folder.glob("frame_*.png")) else clips.read_clip(spark, path)


def shots(spark: SparkSession, frames: DataFrame, path: str | None) -> DataFrame | None:
    if not path:
        return None
    rows = documents.read_labels(spark, path).where("frame_start is not null and frame_end is not null")
    names = frames.select("clip").distinct().withColumnRenamed("clip", "c")
    return rows.join(names, L.stem(F.col("source_file")) == F.col("c")).select(F.col("c").alias("clip"), "shot_id", "frame_start", "frame_end")


def groups_of(spark: SparkSession, path: str) -> DataFrame:
    """Groups of documents written by ``detect``."""
    return documents.read_detections(spark, path, lines=True).where("start is not null").select(F.col("source_file").alias("clip"), "shot_id", "group_ord", "start", "end", "confidence", "pattern")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cadence")
    every = argparse.ArgumentParser(add_help=False)
    every.add_argument("--input", required=True)
    every.add_argument("--output", required=True)
    held = argparse.ArgumentParser(add_help=False)
    held.add_argument("--hold-groups", required=True)
    found = argparse.ArgumentParser(add_help=False)
    found.add_argument("--shots-csv")
    found.add_argument("--hash-threshold", type=int, default=16)
    found.add_argument("--diff-threshold", type=float, default=3.0)
    found.add_argument("--ssim-threshold", type=float, default=0.92)
    found.add_argument("--block-size", type=int, default=32)
    found.add_argument("--dust-robust", action="store_true")
    found.add_argument("--no-drift-check", action="store_true")
    looks = argparse.ArgumentParser(add_help=False)
    looks.add_argument("--mode", choices=["texture", "full"], default="texture")
    looks.add_argument("--reference-method", choices=["trimmed_mean", "median", "mean"], default="trimmed_mean")
    looks.add_argument("--grain-reduction", type=float, default=0.0)
    looks.add_argument("--dust-sigma", type=float, default=5.0)
    looks.add_argument("--extend", type=int, default=0)
    for flag in ("flicker-correction", "remove-line-noise", "remove-scan-noise", "no-align", "no-dust", "side-by-side"):
        looks.add_argument(f"--{flag}", action="store_true")
    looks.add_argument("--scratch-defects", help="documents written by defects")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("detect", parents=[every, found])
    one = sub.add_parser("motion", parents=[every, held])
    one.add_argument("--work-width", type=int, default=640)
    one.add_argument("--moving-ratio-full", type=float, default=0.35)
    one.add_argument("--no-ecc", action="store_true")
    sub.add_parser("defects", parents=[every, held]).add_argument("--max-groups", type=int, default=12)
    sub.add_parser("denoise", parents=[every, held, looks])
    sub.add_parser("pipeline", parents=[every, found, looks]).add_argument("--skip-motion", action="store_true")
    judge = sub.add_parser("evaluate")
    for flag in ("labels", "hold-groups", "output"):
        judge.add_argument(f"--{flag}", required=True)
    return top


def detect(spark: SparkSession, a: argparse.Namespace, output: str) -> None:
    frames = frames_of(spark, a.input)
    t = holds.Thresholds(hash=a.hash_threshold, diff=a.diff_threshold, similarity=a.ssim_threshold, block=a.block_size)
    documents.write_documents(holds.document(holds.detect(frames, shots(spark, frames, a.shots_csv), t, a.dust_robust, not a.no_drift_check)), output)


def moves(spark: SparkSession, a: argparse.Namespace, held: str, output: str) -> None:
    t = motion.Limits(width=getattr(a, "work_width", 640), full=getattr(a, "moving_ratio_full", 0.35), refine=not getattr(a, "no_ecc", False))
    documents.write_documents(motion.motion_document(groups_of(spark, held), frames_of(spark, a.input), t), output)


def defects(spark: SparkSession, a: argparse.Namespace, held: str, output: str) -> None:
    documents.write_documents(restore.defect_document(groups_of(spark, held), frames_of(spark, a.input), getattr(a, "max_groups", 12)), output)


def denoise(spark: SparkSession, a: argparse.Namespace, held: str, output: str) -> None:
    frames = frames_of(spark, a.input)
    s = restore.Settings(
        mode=a.mode, method=a.reference_method, grain_reduction=a.grain_reduction, dust_sigma=a.dust_sigma, radius=a.extend, flicker=a.flicker_correction,
        lines=a.remove_line_noise, scan=a.remove_scan_noise, align=not a.no_align, dust=not a.no_dust,
    )
    scratches = None
    if a.scratch_defects:
        scratches = spark.read.schema("clip string, shot_id string, scratch_columns array<struct<x:int>>").json(a.scratch_defects).select("clip", "shot_id", F.col("scratch_columns.x").alias("columns"))
    out = restore.denoise(groups_of(spark, held), frames, s, scratches)
    clips.write_frames(clips.side_by_side(frames, out) if a.side_by_side else out, output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Accuracy by source type, and the judged shots as CSV."""
    predicted = documents.read_detections(spark, a.hold_groups, lines=True).select("shot_id", "dominant_koma_pattern").distinct()
    judged = L.judged_patterns(documents.read_labels(spark, a.labels), predicted)
    documents.write_table(judged, a.output)
    return {r["source_type"] or "all": r["accuracy"] for r in L.accuracy(judged).collect()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("cadence").getOrCreate()
    if a.command == "detect":
        detect(spark, a, a.output)
    elif a.command == "motion":
        moves(spark, a, a.hold_groups, a.output)
    elif a.command == "defects":
        defects(spark, a, a.hold_groups, a.output)
    elif a.command == "denoise":
        denoise(spark, a, a.hold_groups, a.output)
    elif a.command == "pipeline":
        at = lambda name: os.path.join(a.output, name)
        detect(spark, a, at("holds"))
        if not a.skip_motion:
            moves(spark, a, at("holds"), at("motion"))
        defects(spark, a, at("holds"), at("defects"))
        denoise(spark, a, at("holds"), at("frames"))
    else:
        print(json.dumps(evaluate(spark, a), ensure_ascii=False))


if __name__ == "__main__":
    main()
