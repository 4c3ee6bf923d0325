"""Hold detection on a stream of frames, with the state of each shot between micro-batches.

Frames of a shot come in order of their numbers (late and repeated ones are passed over). A group goes out when the next
one begins, or, for the last, when a frame says ``last`` or, if ``quiet`` is given, the shot has had no frame for so many
milliseconds (a query with such a timeout never ends by itself).
Results are those of the batch form without halving: a group's ends are only known when it is closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadence.kernels import plane
from cadence.operators.holds import LIMITS, Thresholds
from cadence.operators.tables import image

def _wait(state: GroupState, quiet: int | None) -> None:
    if quiet:
        state.setTimeoutDuration(quiet)


GROUPS = "clip string, shot_id string, start long, end long, confidence double"
STATE = "idx long, start long, total double, h int, w int, plane binary, hash string"


def compared(a: np.ndarray, b: np.ndarray, hash_a: int, hash_b: int, t: Thresholds) -> float | None:
    """The confidence that two blurred planes are the same drawing; None: they aren't."""
    if a.shape != b.shape or (hash_a ^ hash_b).bit_count() > t.hash:
        return None
    d = float(np.abs(a.astype(np.float32) - b.astype(np.float32)).mean())
    if d >= t.diff:
        return None
    s = plane.block_similarity(a, b, t.block)
    if s <= t.similarity:
        return None
    return float(np.clip(((t.diff - d) / t.diff + max(0.0, (s - t.similarity) / (1 - t.similarity + 1e-6))) / 2, 0, 1))


def stream_groups(frames: DataFrame, t: Thresholds = LIMITS, quiet: int | None = None) -> DataFrame:
    """frames: streaming FRAME rows with shot_id and last (boolean). Returns closed GROUPS."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clip, shot = key
        out = []
        now = state.get if state.exists else None
        closed = lambda s: (clip, shot, s[1], s[0], s[2] / (s[0] - s[1] + 1))
        if state.hasTimedOut:
            out.append(closed(now))
            state.remove()
        else:
            # a task of one shot gets its rows of a micro-batch in any order
            rows = pd.concat(list(batches)).sort_values("frame_idx", kind="stable")
            for row in rows.to_dict("records"):
                idx = int(row["frame_idx"])
                if row["data"] is not None and (now is None or idx > now[0]):
                    frame = image(row)
                    soft, code = plane.blur(plane.gray8(frame), t.blur), plane.perceptual_hash(frame)
                    score = None
                    if now is not None and idx == now[0] + 1:
                        score = compared(np.frombuffer(now[5], np.uint8).reshape(now[3], now[4]), soft, int(now[6], 16), code, t)
                    if now is not None and score is None:
                        out.append(closed(now))
                    begins = now is None or score is None
                    now = (idx, idx if begins else now[1], 1.0 if begins else now[2] + score, soft.shape[0], soft.shape[1], soft.tobytes(), f"{code:016x}")
                if row["last"] and now is not None:
                    out.append(closed(now))
                    now = None
            if now is not None:
                state.update(now)
                _wait(state, quiet)
            elif state.exists:
                state.remove()
        if out:
            yield pd.DataFrame(out, columns=["clip", "shot_id", "start", "end", "confidence"])

    rows = frames.select("clip", "shot_id", "frame_idx", "h", "w", "c", "dtype", "data", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("clip", "shot_id").applyInPandasWithState(run, GROUPS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout)


WINDOWS = "clip string, shot_id string, center long, members array<struct<start:long,end:long>>"


def stream_windows(groups: DataFrame, radius: int = 2, quiet: int | None = None) -> DataFrame:
    """Each group (clip, shot_id, start, end, last) once, with those up to ``radius`` before and after it; what no window needs any more is dropped from the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = ([tuple(x) for x in state.get[0]], state.get[1]) if state.exists else ([], 0)
        ended = state.hasTimedOut
        if not ended:
            rows = pd.concat(list(batches)).sort_values("start", kind="stable")
            held += [(int(a), int(b)) for a, b in zip(rows["start"], rows["end"], strict=True)]
            ended = bool(rows["last"].any())
        out = []
        while done < len(held) and (ended or done + radius < len(held)):
            out.append((*key, held[done][0], [{"start": a, "end": b} for a, b in held[max(0, done - radius) : done + radius + 1]]))
            done += 1
            gone = max(0, done - radius)
            held, done = held[gone:], done - gone
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update(([list(x) for x in held], done))
            _wait(state, quiet)
        if out:
            yield pd.DataFrame(out, columns=["clip", "shot_id", "center", "members"])

    rows = groups.select("clip", "shot_id", "start", "end", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("clip", "shot_id").applyInPandasWithState(run, WINDOWS, "held array<array<long>>, done int", "append", GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout)
