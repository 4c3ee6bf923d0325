"""Labels' spellings, and predictions held against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ["static", "pan", "zoom", "rotation"]
#: Spellings of the four kinds of camera motion, in English and Japanese.
ALIASES = {
    "static": ["static", "静止", "fix", "止め"],
    "pan": ["pan", "パン", "tilt", "ティルト", "panup", "pandown", "パンアップ", "パンダウン"],
    "zoom": ["zoom", "ズーム", "zoomin", "zoomout", "zoomup", "zoomback", "ズームイン", "ズームアウト", "ズームアップ", "ズームバック", "寄り", "引き"],
    "rotation": ["rotation", "回転", "rotate"],
}
#: Spellings of no local motion.
NONE = ["none", "なし", "no", "静止"]


def global_label(raw: Column) -> Column:
    """One of CLASSES; null for blanks and spellings that aren't known."""
    plain = F.regexp_replace(F.lower(F.trim(raw)), "[ _-]", "")
    out = F.lit(None).cast("string")
    for kind, names in ALIASES.items():
        out = F.when(plain.isin(names), kind).otherwise(out)
    return out


def local_label(raw: Column) -> Column:
    plain = F.lower(F.trim(raw))
    return F.when(plain.isin(NONE), "none").when(plain != "", "moving")


def local_vote(kinds: Column, share: float = 0.3) -> Column:
    """moving where ``share`` of the segments or more move; no segments: none."""
    n, k = F.size(kinds), F.size(F.filter(kinds, lambda x: x != "none"))
    return F.when((n > 0) & (k / F.greatest(n, F.lit(1)) >= share), "moving").otherwise("none")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def judged_patterns(labels: DataFrame, predicted: DataFrame) -> DataFrame:
    """shot_id, source_type, label, prediction, correct of the labelled shots that have a prediction (shot_id, dominant_koma_pattern)."""
    rows = labels.where("koma_pattern is not null").join(predicted, "shot_id")
    return rows.select("shot_id", "source_type", F.col("koma_pattern").alias("label"), F.col("dominant_koma_pattern").alias("prediction"), (F.col("koma_pattern") == F.col("dominant_koma_pattern")).alias("correct"))


def accuracy(judged: DataFrame) -> DataFrame:
    """Overall (source_type null) and by source type."""
    return judged.groupingSets([[], ["source_type"]], "source_type").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def labelled_motions(motions: DataFrame, labels: DataFrame) -> DataFrame:
    """Shots (stem, shot_id, dominant_global_motion, local_motion) with the label row of their id within their file, else the first row of that file; files without labels go."""
    rows = labels.select(stem(F.col("source_file")).alias("stem"), "shot_id", global_label(F.col("global_motion")).alias("global_label"), local_label(F.col("local_motion")).alias("local_label"), F.coalesce("frame_start", F.lit(-1)).alias("at"))
    first = rows.groupBy("stem").agg(F.min_by(F.struct("global_label", "local_label"), F.struct("at", "shot_id")).alias("first"))
    own = rows.groupBy("stem", "shot_id").agg(F.min_by(F.struct("global_label", "local_label"), "at").alias("own"))
    found = motions.join(F.broadcast(first) if first.count() < 1_000_000 else first, "stem").join(own, ["stem", "shot_id"], "left").withColumn("label", F.coalesce("own", "first"))
    kinds = F.transform("local_motion", lambda x: x["type"])
    return found.select("stem", "shot_id", F.col("dominant_global_motion").alias("global_pred"), "label.global_label", local_vote(kinds).alias("local_pred"), "label.local_label")


def confusion(judged: DataFrame, truth: str = "global_label", prediction: str = "global_pred", classes: list[str] = CLASSES) -> DataFrame:
    """truth, and a count for each class, zeros too."""
    counts = judged.where(F.col(truth).isin(classes)).groupBy(F.col(truth).alias("truth")).pivot(prediction, classes).count()
    every = judged.sparkSession.createDataFrame([(c,) for c in classes], "truth string")
    return every.join(counts, "truth", "left").fillna(0)
