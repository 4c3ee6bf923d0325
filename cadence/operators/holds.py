"""Hold detection: frames of the same drawing, from frames to a document.

Each frame is blurred and hashed once. Consecutive frames meet in a join on (clip, frame number), which has
no hot key, and become rows of scalars; groups are islands among those. Groups whose ends have drifted
apart are halved, all groups of a round together, so there are as many rounds as the longest has halvings.

A frame of another size than the one before begins a group. Null data likewise. Shots without frames have
no group. Frames that belong to no shot are left out; a repeated frame number keeps one of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.kernels import plane
from cadence.operators.tables import written


@dataclass(frozen=True)
class Thresholds:
    """hash: bits of 64 that may differ; diff: mean difference; similarity: block similarity; span: groups of so many frames aren't halved."""

    hash: int = 16
    diff: float = 3.0
    similarity: float = 0.92
    block: int = 32
    blur: int = 5
    span: int = 3
    dust_share: float = 0.10
    dust_area: float = 0.0008


LIMITS = Thresholds()


def features(frames: DataFrame, t: Thresholds = LIMITS) -> DataFrame:
    """clip, frame_idx, h, w, plane (blurred 8-bit luma), hash (64 bits)."""

    def run(h: pa.Array, w: pa.Array, c: pa.Array, dtype: pa.Array, data: pa.Array) -> pa.Array:
        planes, hashes = [], []
        for a, b, n, kind, x in zip(*(v.to_pylist() for v in (h, w, c, dtype)), data, strict=True):
            if not x.is_valid:
                planes.append(None)
                hashes.append(None)
                continue
            frame = np.frombuffer(x.as_buffer(), kind).reshape((a, b, n) if n > 1 else (a, b))
            planes.append(plane.blur(plane.gray8(frame), t.blur).tobytes())
            hashes.append(plane.perceptual_hash(frame))
        bits = np.array([x or 0 for x in hashes], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(planes, pa.binary()), pa.array(bits, mask=np.array([x is None for x in hashes], bool))], names=["plane", "hash"])

    found = frames.select("clip", "frame_idx", "h", "w", F.arrow_udf(run, "plane binary, hash long")("h", "w", "c", "dtype", "data").alias("f"))
    # after the planes, as they are smaller than the frames
    return found.select("clip", "frame_idx", "h", "w", "f.plane", "f.hash").dropDuplicates(["clip", "frame_idx"])


def same_but_dust(a: np.ndarray, b: np.ndarray, t: Thresholds = LIMITS) -> bool:
    """Whether two blurred planes are the same but for small compact spots."""
    d = np.abs(a.astype(np.float32) - b.astype(np.float32))
    if d.mean() < t.diff:
        return True
    high = plane.opened(d > max(6.0, 2 * t.diff), 3)
    if high.mean() > t.dust_share:
        return False
    _, s = plane.components(high)
    short, long = np.minimum(s["height"], s["width"]), np.maximum(s["height"], s["width"])
    thin = (long / np.maximum(short, 1) > 6) & (s["area"] / (s["height"] * s["width"]) < 0.3)
    if (s["area"] > int(d.size * t.dust_area)).any() or thin.any():
        return False
    rest = d[~plane.dilate(high, 5)]
    return bool(rest.size) and float(rest.mean()) < t.diff


MEASURES = "diff double, similarity double, dusty boolean"


def measured(a: Column, b: Column, h: Column, w: Column, close: Column, t: Thresholds, dusty: bool) -> Column:
    """MEASURES of two blurred planes; diff and similarity only where ``close`` says that the hashes are alike."""

    def run(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array, close: pa.Array) -> pa.Array:
        out = []
        for x, y, i, j, near in zip(a, b, h.to_pylist(), w.to_pylist(), close.to_pylist(), strict=True):
            if not (x.is_valid and y.is_valid):
                out.append((None, None, False))
                continue
            p, q = (np.frombuffer(v.as_buffer(), np.uint8).reshape(i, j) for v in (x, y))
            d = float(np.abs(p.astype(np.float32) - q.astype(np.float32)).mean()) if near else None
            s = plane.block_similarity(p, q, t.block) if near else None
            same = near and d < t.diff and s > t.similarity
            out.append((d, s, bool(dusty and not same and same_but_dust(p, q, t))))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.bool_()))], names=["diff", "similarity", "dusty"])

    return F.arrow_udf(run, MEASURES)(a, b, h, w, close)


def pairs(found: DataFrame, t: Thresholds = LIMITS, dusty: bool = False) -> DataFrame:
    """clip, frame_idx, distance, MEASURES of each frame and the one before it, nulls where there is none of its size. found: features()."""
    before = found.select("clip", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("plane").alias("_plane"), F.col("hash").alias("_hash"))
    both = found.join(before, ["clip", "frame_idx"], "left")
    distance = F.bit_count(F.col("hash").bitwiseXOR(F.col("_hash")))
    alike = (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))
    both = both.withColumn("distance", F.when(alike, distance))
    close = F.coalesce(F.col("distance") <= t.hash, F.lit(False))
    m = measured(F.when(alike, F.col("_plane")), F.col("plane"), F.col("h"), F.col("w"), close, t, dusty)
    return both.select("clip", "frame_idx", "distance", m.alias("m")).select("clip", "frame_idx", "distance", "m.*")


def same_drawing(t: Thresholds = LIMITS) -> Column:
    return F.coalesce((F.col("distance") <= t.hash) & (F.col("diff") < t.diff) & (F.col("similarity") > t.similarity), F.lit(False))


def confidence(t: Thresholds = LIMITS) -> Column:
    """How far within the limits a pair is, 0 to 1."""
    a = F.greatest(F.lit(0.0), (t.diff - F.col("diff")) / t.diff)
    b = F.greatest(F.lit(0.0), (F.col("similarity") - t.similarity) / (1 - t.similarity + 1e-6))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (a + b) / 2))


def islands(rows: DataFrame, t: Thresholds = LIMITS) -> DataFrame:
    """clip, shot_id, start, end, confidence from pairs() with shot_id. A dusty pair joins what is on its two sides."""
    order = Window.partitionBy("clip", "shot_id").orderBy("frame_idx")
    follows = F.coalesce(F.lag("frame_idx").over(order) == F.col("frame_idx") - 1, F.lit(False))
    marked = rows.withColumn("same", follows & same_drawing(t)).withColumn("joined", follows & (F.col("same") | F.coalesce("dusty", F.lit(False))))
    marked = marked.withColumn("mark", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    score = F.when(F.col("same"), confidence(t)).otherwise(1.0)
    return marked.groupBy("clip", "shot_id", "mark").agg(F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"), F.avg(score).alias("confidence")).drop("mark")


def halved(groups: DataFrame, found: DataFrame, t: Thresholds = LIMITS) -> DataFrame:
    """Groups whose first and last frame aren't the same are halved until they are, or short; each halving costs a fifth of the confidence."""
    ends = found.select("clip", "frame_idx", "h", "w", "plane")
    done, open_ = None, groups
    while True:
        short = F.col("end") - F.col("start") + 1 <= t.span
        settled = open_.where(short)
        long = open_.where(~short)
        a = ends.select("clip", F.col("frame_idx").alias("start"), F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("plane").alias("_a"))
        b = ends.select("clip", F.col("frame_idx").alias("end"), "h", "w", F.col("plane").alias("_b"))
        both = long.join(a, ["clip", "start"]).join(b, ["clip", "end"])
        m = measured(F.when((F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w")), F.col("_a")), F.col("_b"), F.col("h"), F.col("w"), F.lit(True), t, False)
        both = both.select("clip", "shot_id", "start", "end", "confidence", m.alias("m"))
        both = written(both.select("clip", "shot_id", "start", "end", "confidence", F.coalesce((F.col("m.diff") < t.diff) & (F.col("m.similarity") > t.similarity), F.lit(False)).alias("same")), "halving")
        settled = written(settled.unionByName(both.where("same").drop("same")), "settled")
        done = settled if done is None else done.unionByName(settled)
        apart = both.where("not same")
        if apart.isEmpty():
            return done
        middle = F.floor((F.col("start") + F.col("end")) / 2)
        parts = F.explode(F.array(F.struct(F.col("start").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("end").alias("b"))))
        open_ = apart.select("clip", "shot_id", (F.col("confidence") * 0.8).alias("confidence"), parts.alias("p")).select("clip", "shot_id", F.col("p.a").alias("start"), F.col("p.b").alias("end"), "confidence")


def named(groups: DataFrame) -> DataFrame:
    """group_ord and pattern: the most frequent length of a shot (the first seen among equals) is its rule."""
    groups = groups.withColumn("n", F.col("end") - F.col("start") + 1)
    usual = groups.groupBy("clip", "shot_id", "n").agg(F.count("*").alias("k"), F.min("start").alias("seen"))
    usual = usual.groupBy("clip", "shot_id").agg(F.min_by("n", F.struct(-F.col("k"), F.col("seen"))).alias("usual"))
    order = Window.partitionBy("clip", "shot_id").orderBy("start")
    pattern = F.concat(F.col("n").cast("string"), F.lit("koma"), F.when(F.col("n") != F.col("usual"), "_irregular").otherwise(""))
    out = groups.join(usual, ["clip", "shot_id"]).withColumn("group_ord", F.row_number().over(order) - 1)
    return out.select("clip", "shot_id", "group_ord", "start", "end", "confidence", pattern.alias("pattern"))


def detect(frames: DataFrame, shots: DataFrame | None = None, t: Thresholds = LIMITS, dust_robust: bool = False, drift_check: bool = True) -> DataFrame:
    """clip, shot_id, group_ord, start, end (frame numbers of the clip), confidence, pattern. shots: SHOT rows; without, a clip is the shot 0001."""
    found = written(features(frames, t), "features")
    rows = pairs(found, t, dust_robust)
    if shots is None:
        rows = rows.withColumn("shot_id", F.lit("0001"))
    else:
        s = shots.where("frame_start is not null and frame_end is not null").select("clip", "shot_id", "frame_start", "frame_end")
        rows = rows.join(F.broadcast(s) if s.count() < 1_000_000 else s, "clip").where(F.col("frame_idx").between(F.col("frame_start"), F.col("frame_end"))).drop("frame_start", "frame_end")
    groups = written(islands(rows, t), "groups")
    return named(halved(groups, found, t) if drift_check else groups)


def dominant(groups: DataFrame) -> DataFrame:
    """clip, shot_id, dominant_koma_pattern: one that 70% of the groups have, else mixed."""
    counts = groups.groupBy("clip", "shot_id", "pattern").agg(F.count("*").alias("k"), F.min("start").alias("seen"))
    top = counts.groupBy("clip", "shot_id").agg(F.min_by("pattern", F.struct(-F.col("k"), F.col("seen"))).alias("top"), (F.max("k") / F.sum("k")).alias("share"))
    return top.select("clip", "shot_id", F.when(F.col("share") >= 0.7, F.col("top")).otherwise("mixed").alias("dominant_koma_pattern"))


def document(groups: DataFrame) -> DataFrame:
    """source_file and its shots, each with its groups: one row a clip, as the JSON document has it."""
    one = F.struct("start", "end", "pattern", F.round("confidence", 3).alias("confidence"))
    held = groups.groupBy("clip", "shot_id").agg(F.array(F.min("start"), F.max("end")).alias("frame_range"), F.sort_array(F.collect_list(one)).alias("hold_groups"))
    shots = held.join(dominant(groups), ["clip", "shot_id"])
    shot = F.struct("shot_id", "frame_range", "dominant_koma_pattern", "hold_groups")
    return shots.groupBy(F.col("clip").alias("source_file")).agg(F.sort_array(F.collect_list(shot)).alias("shots"))


def representatives(groups: DataFrame, frames: DataFrame) -> DataFrame:
    """The middle frame of each group."""
    at = groups.select("clip", "shot_id", "group_ord", F.floor((F.col("start") + F.col("end")) / 2).alias("frame_idx"))
    return at.join(frames, ["clip", "frame_idx"])
