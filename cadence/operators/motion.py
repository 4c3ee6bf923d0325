"""Camera and local motion between two frames, and the motion document of a shot.

Points of interest are matched by binary descriptors both ways, and a similarity is voted for among the matches; with
too few of them the shift comes from phase correlation. That estimate gives the class; a refined one, if it leaves less, gives
what is left over.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.kernels import plane
from cadence.operators.holds import representatives
from cadence.operators.tables import image


@dataclass(frozen=True)
class Limits:
    width: int = 640
    blur: int = 5
    still: float = 0.5
    zoom: float = 0.002
    turn: float = 0.5
    matches: int = 20
    inliers: int = 10
    reach: float = 3.0
    refine: bool = True
    rounds: int = 50
    crop: float = 0.12
    worse: float = 4.0
    none: float = 0.01
    full: float = 0.35
    floor: float = 3.0


LIMITS = Limits()
POINTS, TESTS, PATCH = 500, 256, 12


@dataclass
class Motion:
    kind: str
    tx: float
    ty: float
    scale: float
    rotation: float
    method: str
    confidence: float
    warp: np.ndarray  # of work size, from a to b
    full: np.ndarray  # of full size
    ratio: float | None = None


def prepared(frame: np.ndarray, t: Limits = LIMITS) -> tuple[np.ndarray, float]:
    """Blurred 8-bit luma of at most the work width, and how many source pixels one of its pixels has."""
    y = plane.gray8(frame) if frame.dtype == np.uint8 else plane.rounded(plane.gray(frame))
    h, w = y.shape
    if w > t.width:
        y = plane.rounded(plane.shrink(y, int(round(h * t.width / w)), t.width))
    return plane.blur(y, t.blur), w / min(w, t.width)


def points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y), strongest first, and their descriptors (bits, packed)."""
    gx, gy = plane.sobel(y)
    w = plane.gaussian_weights(7)
    xx, yy, xy = (plane.convolve(p, w, w) for p in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    peak = (strength >= plane.dilate(strength, 5)) & (strength > 1e-4 * max(float(strength.max()), 1e-9))
    r = PATCH + 2
    peak[:r], peak[-r:], peak[:, :r], peak[:, -r:] = False, False, False, False
    py, px = np.nonzero(peak)
    best = np.lexsort((px, py, -strength[py, px]))[:POINTS]
    py, px = py[best], px[best]
    offsets = np.clip(np.rint(np.random.default_rng(0).normal(0, PATCH / 2.5, (TESTS, 4))), -PATCH, PATCH).astype(int)
    soft = plane.blur(y.astype(np.float32), 5)
    read = lambda k: soft[py[:, None] + offsets[None, :, k], px[:, None] + offsets[None, :, k + 1]]
    return np.stack([px, py], 1).astype(float), np.packbits(read(0) < read(2), axis=1)


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (i, j, distance) of descriptors that are each other's nearest, nearest first."""
    if not len(a) or not len(b):
        return np.zeros((0, 3), int)
    d = np.bitwise_count(a[:, None, :] ^ b[None]).sum(2, dtype=np.int64)
    j = d.argmin(1)
    i = np.flatnonzero(d.argmin(0)[j] == np.arange(len(a)))
    out = np.stack([i, j[i], d[i, j[i]]], 1)
    return out[np.argsort(out[:, 2], kind="stable")]


def _solve(p: np.ndarray, q: np.ndarray, similar: bool) -> np.ndarray:
    """Least squares p -> q: a similarity, or any affine map."""
    n, zero, one = len(p), np.zeros(len(p)), np.ones(len(p))
    if similar:
        rows = np.concatenate([np.stack([p[:, 0], -p[:, 1], one, zero], 1), np.stack([p[:, 1], p[:, 0], zero, one], 1)])
        a, b, x, y = np.linalg.lstsq(rows, np.concatenate([q[:, 0], q[:, 1]]), rcond=None)[0]
        return np.array([[a, -b, x], [b, a, y]])
    return np.linalg.lstsq(np.column_stack([p, np.ones(n)]), q, rcond=None)[0].T


def voted(p: np.ndarray, q: np.ndarray, similar: bool = True, reach: float = 3.0, rounds: int = 500) -> tuple[np.ndarray | None, np.ndarray]:
    """The map p -> q that most pairs agree on within ``reach`` pixels, and which do; seeded, so reruns agree."""
    need = 2 if similar else 3
    none = np.zeros(len(p), bool)
    if len(p) < need:
        return None, none
    rng, best = np.random.default_rng(0), none
    far = lambda m: np.hypot(*(p @ m[:, :2].T + m[:, 2] - q).T)
    for _ in range(rounds):
        pick = rng.choice(len(p), need, replace=False)
        ok = far(_solve(p[pick], q[pick], similar)) <= reach
        if ok.sum() > best.sum():
            best = ok
            if best.mean() > 0.95:
                break
    if best.sum() < need:
        return None, none
    for _ in range(3):
        m = _solve(p[best], q[best], similar)
        best = far(m) <= reach
        if best.sum() < need:
            return None, none
    return m, best


def parts(m: np.ndarray) -> tuple[float, float, float, float]:
    """tx, ty, scale (root of the determinant), degrees turned."""
    return float(m[0, 2]), float(m[1, 2]), math.sqrt(max(float(np.linalg.det(m[:, :2])), 1e-12)), math.degrees(math.atan2(m[1, 0], m[0, 0]))


def kind_of(tx: float, ty: float, scale: float, rotation: float, t: Limits = LIMITS) -> str:
    if abs(rotation) >= t.turn:
        return "rotation"
    if abs(scale - 1) >= t.zoom:
        return "zoom"
    return "pan" if math.hypot(tx, ty) >= t.still else "static"


def left_over(a: np.ndarray, b: np.ndarray, m: np.ndarray | None, crop: float = 0.0) -> np.ndarray:
    """How far b lies outside the range that a, moved by m, has around each pixel."""
    if m is not None:
        a = plane.rounded(plane.warp(a, np.linalg.inv(np.vstack([m, [0, 0, 1]]))[:2]))
    x = b.astype(np.float32)
    out = np.maximum(np.maximum(x - plane.dilate(a, 3), plane.erode(a, 3) - x), 0)
    i, j = int(out.shape[0] * crop), int(out.shape[1] * crop)
    return out[i : out.shape[0] - i, j : out.shape[1] - j]


def estimate(frame_a: np.ndarray, frame_b: np.ndarray, t: Limits = LIMITS) -> Motion:
    a, to_source = prepared(frame_a, t)
    b, _ = prepared(frame_b, t)
    (pa_, da), (pb, db) = points(a), points(b)
    pairs = matched(da, db)
    warp, method, trust, p, q = None, "phase", 0.0, None, None
    if len(pairs) >= t.matches:
        p, q = pa_[pairs[:, 0]], pb[pairs[:, 1]]
        m, agree = voted(p, q, True, t.reach)
        if m is not None and agree.sum() >= t.inliers:
            warp, method, trust = m, "points", float(agree.mean())
    shift = plane.phase_shift(a.astype(float), b.astype(float))
    if warp is None:
        warp, trust = np.array([[1.0, 0, shift[0]], [0, 1, shift[1]]]), float(np.clip(shift[2], 0, 1))
        p = None
    tx, ty, scale, rotation = parts(warp)
    first, refined = left_over(a, b, warp, t.crop), warp
    if t.refine:
        back = plane.correlate_warp(b, a, False, t.rounds, np.linalg.inv(np.vstack([warp, [0, 0, 1]]))[:2])
        if back is not None and abs(np.linalg.det(back[:, :2])) > 1e-6:
            better = np.linalg.inv(np.vstack([back, [0, 0, 1]]))[:2]
            if left_over(a, b, better, t.crop).mean() <= first.mean():
                refined, method = better, method + "+refined"
                trust = max(trust, 0.5)
    kind, ratio = kind_of(tx, ty, scale, rotation, t), None
    if kind != "static":
        still = left_over(a, b, None, t.crop)
        if ((still <= t.worse) & (first > t.worse)).mean() >= ((still > t.worse) & (first <= t.worse)).mean():
            kind = "static"
    if kind in ("zoom", "rotation"):
        layered = False
        if p is not None:
            m, _ = voted(p, q, False, t.reach)
            if m is not None:
                low, high = sorted(abs(np.hypot(*m[:, k]) - 1) for k in (0, 1))
                if high > 0.005:
                    ratio = float(low / high)
                    layered = ratio < 0.75
        if not layered:
            plain = np.array([[1.0, 0, shift[0]], [0, 1, shift[1]]])
            layered = (left_over(a, b, plain, t.crop) <= t.worse).mean() >= (first <= t.worse).mean()
        if layered:
            kind = "pan" if math.hypot(*shift[:2]) >= t.still else "static"
            if kind == "pan":
                tx, ty, scale, rotation = shift[0], shift[1], 1.0, 0.0
    full = refined.copy()
    full[:, 2] *= to_source
    return Motion(kind, tx * to_source, ty * to_source, scale, rotation, method, trust, refined, full, ratio)


@dataclass
class Local:
    kind: str
    ratio: float
    largest: float
    box: list[int] | None


def local(frame_a: np.ndarray, frame_b: np.ndarray, m: Motion, noise: float, t: Limits = LIMITS) -> Local:
    """What moves apart from the camera: its share, and the largest part with its box in source pixels (left, top, width, height)."""
    (a, to_source), (b, _) = prepared(frame_a, t), prepared(frame_b, t)
    rest = left_over(a, b, m.warp, t.crop)
    moving = plane.opened(rest > noise, 3)
    ratio, largest, box = float(moving.mean()), 0.0, None
    if moving.any():
        merged = plane.closed(moving, 9)
        _, c = plane.components(merged)
        k = int(c["area"].argmax())
        largest = float(c["area"][k] / max(int(merged.sum()), 1))
        i, j = int(a.shape[0] * t.crop), int(a.shape[1] * t.crop)
        box = [int(v * to_source) for v in (c["left"][k] + j, c["top"][k] + i, c["width"][k], c["height"][k])]
    return Local("none" if ratio < t.none else "full" if ratio >= t.full else "local", ratio, largest, box)


def noise_floor(pairs: list[tuple[np.ndarray, np.ndarray]], t: Limits = LIMITS) -> float:
    """What is left over between the ends of held groups: the median of their 99.5 percentiles."""
    found = [float(np.percentile(left_over(prepared(a, t)[0], prepared(b, t)[0], None, t.crop), 99.5)) for a, b in pairs]
    return max(t.floor, float(np.median(found))) if found else t.floor


def camera_path(moves: list[tuple[float, float]], least: float = 2.0) -> dict:
    v = np.array(moves, float).reshape(-1, 2)
    size = np.hypot(*v.T)
    unit = v[size >= least] / size[size >= least, None]
    steady = float(np.hypot(*unit.mean(0))) if len(unit) >= 3 else 1.0
    return {"direction_consistency": round(steady, 3), "moving_transitions": len(unit), "median_translation_px": float(np.median(size)) if len(size) else 0.0, "camera_shake": len(unit) >= 3 and steady < 0.5}


def dominant(kinds: list[str], shake: bool) -> str:
    """The vote of a shot: the most frequent motion (the first seen among equals) where a quarter or more move."""
    if not kinds:
        return "unknown"
    moving = [k for k in kinds if k != "static"]
    if len(moving) >= max(2, 0.25 * len(kinds)):
        most = max(dict.fromkeys(moving), key=moving.count)
        return "static" if most == "pan" and shake else most
    return max(dict.fromkeys(kinds), key=kinds.count)


GLOBAL = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("params", pa.map_(pa.string(), pa.float64())), ("method", pa.string()), ("confidence", pa.float64()), ("tx", pa.float64()), ("ty", pa.float64())])
LOCAL = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("moving_ratio", pa.float64()), ("largest_component_ratio", pa.float64()), ("bbox", pa.list_(pa.int32()))])
MOVES = "global struct<start:long,end:long,type:string,params:map<string,double>,method:string,confidence:double,tx:double,ty:double>, local struct<start:long,end:long,type:string,moving_ratio:double,largest_component_ratio:double,bbox:array<int>>"


def transitions(groups: DataFrame, frames: DataFrame, t: Limits = LIMITS) -> DataFrame:
    """clip, shot_id, noise_floor, global, local: from each group to the next, by their middle frames. Shots of one group have none."""
    data = F.struct("h", "w", "c", "dtype", "data")
    mid = representatives(groups, frames).select("clip", "shot_id", "group_ord", data.alias("b"))
    before = mid.select("clip", "shot_id", (F.col("group_ord") + 1).alias("group_ord"), F.col("b").alias("a"))
    by_length = Window.partitionBy("clip", "shot_id").orderBy(F.desc("n"), "group_ord")
    held = groups.withColumn("n", F.col("end") - F.col("start") + 1).where("n >= 2").withColumn("k", F.row_number().over(by_length)).where("k <= 3")
    at = lambda which, name: held.select("clip", "shot_id", "group_ord", F.col(which).alias("frame_idx")).join(frames, ["clip", "frame_idx"]).select("clip", "shot_id", "group_ord", data.alias(name))

    def measure(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            p, q = image(x), image(y)
            out.append(float(np.percentile(left_over(prepared(p, t)[0], prepared(q, t)[0], None, t.crop), 99.5)) if p.shape == q.shape else None)
        return pa.array(out, pa.float64())

    noise = at("start", "a").join(at("end", "b"), ["clip", "shot_id", "group_ord"]).select("clip", "shot_id", F.arrow_udf(measure, "double")("a", "b").alias("v"))
    noise = noise.groupBy("clip", "shot_id").agg(F.greatest(F.lit(t.floor), F.median("v")).alias("noise_floor"))
    span = groups.select("clip", "shot_id", "group_ord", "start", "end")
    earlier = span.select("clip", "shot_id", (F.col("group_ord") + 1).alias("group_ord"), F.col("start").alias("from"))
    rows = mid.join(before, ["clip", "shot_id", "group_ord"]).join(span.select("clip", "shot_id", "group_ord", F.col("end").alias("to")), ["clip", "shot_id", "group_ord"]).join(earlier, ["clip", "shot_id", "group_ord"])
    rows = rows.join(noise, ["clip", "shot_id"], "left").withColumn("noise_floor", F.coalesce("noise_floor", F.lit(t.floor)))

    def move(a: pa.Array, b: pa.Array, noise: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        whole, part = [], []
        for x, y, n, i, j in zip(*(v.to_pylist() for v in (a, b, noise, start, end)), strict=True):
            p, q = image(x), image(y)
            if p.shape != q.shape:
                whole.append(None)
                part.append(None)
                continue
            m = estimate(p, q, t)
            params = {"tx": round(m.tx, 2), "ty": round(m.ty, 2)} | ({"scale": round(m.scale, 4)} if m.kind == "zoom" else {}) | ({"rotation_deg": round(m.rotation, 3)} if m.kind == "rotation" else {})
            whole.append({"start": i, "end": j, "type": m.kind, "params": list(params.items()), "method": m.method, "confidence": m.confidence, "tx": m.tx, "ty": m.ty})
            k = local(p, q, m, n, t)
            part.append({"start": i, "end": j, "type": k.kind, "moving_ratio": k.ratio, "largest_component_ratio": k.largest, "bbox": k.box})
        return pa.StructArray.from_arrays([pa.array(whole, GLOBAL), pa.array(part, LOCAL)], names=["global", "local"])

    found = rows.select("clip", "shot_id", "noise_floor", F.arrow_udf(move, MOVES)("a", "b", "noise_floor", "from", "to").alias("m"))
    return found.select("clip", "shot_id", "noise_floor", "m.*").where("global is not null")


def motion_document(groups: DataFrame, frames: DataFrame, t: Limits = LIMITS) -> DataFrame:
    """One row a shot of two groups or more: noise floor, vote, camera path, global and local motion."""
    rows = transitions(groups, frames, t)
    held = rows.groupBy("clip", "shot_id").agg(F.first("noise_floor").alias("noise_floor"), F.array_sort(F.collect_list(F.struct("global", "local")), lambda a, b: (a["global"]["start"] - b["global"]["start"]).cast("int")).alias("m"))
    path = "direction_consistency double, moving_transitions int, median_translation_px double, camera_shake boolean, dominant_global_motion string"

    def vote(m: pa.Array) -> pa.Array:
        out = []
        for found in m.to_pylist():
            one = camera_path([(g["tx"], g["ty"]) for g in found])
            out.append(one | {"dominant_global_motion": dominant([g["type"] for g in found], one["camera_shake"])})
        return pa.array(out, pa.struct([("direction_consistency", pa.float64()), ("moving_transitions", pa.int32()), ("median_translation_px", pa.float64()), ("camera_shake", pa.bool_()), ("dominant_global_motion", pa.string())]))

    moves = F.transform("m", lambda x: F.struct(x["global"]["tx"].alias("tx"), x["global"]["ty"].alias("ty"), x["global"]["type"].alias("type")))
    out = held.withColumn("v", F.arrow_udf(vote, path)(moves))
    drop = lambda x: F.struct(*(x["global"][k].alias(k) for k in ("start", "end", "type", "params", "method", "confidence")))
    return out.select("clip", "shot_id", "noise_floor", "v.dominant_global_motion", F.struct("v.direction_consistency", "v.moving_transitions", "v.median_translation_px", "v.camera_shake").alias("camera_path"), F.transform("m", drop).alias("global_motion"), F.transform("m", lambda x: x["local"]).alias("local_motion"))
