"""Gaps and islands: frames over a threshold merged into candidate intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, fixed


def over_threshold(frames: DataFrame, threshold: float = C.AUDIO_THRESHOLD) -> DataFrame:
    return frames.where(F.col("score") >= threshold)


def island_ids(frames: DataFrame, keys: list[str], gap: float, order: str = "frame_idx") -> DataFrame:
    """`frames` with island (1, 2, ...): a frame starts a new one if it begins more than `gap` after all ends before it.

    One exchange on the keys; both running aggregates share its sort.
    """
    w = Window.partitionBy(*keys).orderBy("start", order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    return frames.withColumn("_new", new).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def merge_islands(frames: DataFrame, keys: list[str], gap: float = C.AUDIO_MERGE_GAP, padding: float = C.AUDIO_PADDING, duration: Column | float | None = None, order: str = "frame_idx") -> DataFrame:
    """keys, island, start, end, score, top_label, frame_count, time: one candidate per island, padded within [0, duration].

    The top label is that of the last frame with the best score. Where frames have
    label_scores (a map), so has the candidate: each label's maximum over its frames.
    """
    marked = island_ids(frames, keys, gap, order)
    g = marked.groupBy(*keys, "island").agg(
        F.min("start").alias("_s"), F.max("end").alias("_e"), F.max("score").alias("_score"),
        F.max_by("top_label", F.struct("score", order)).alias("top_label"), F.count(F.lit(1)).alias("frame_count"),
    )
    more = []
    if "label_scores" in frames.columns:
        own = [*keys, "island"]
        labels = label_maxima(marked.select(*own, F.explode("label_scores").alias("label", "score")), own)
        g, more = g.join(labels, own, "left"), [F.coalesce("label_scores", F.create_map().cast("map<string,double>")).alias("label_scores")]
    end = F.col("_e") + padding
    end = end if duration is None else F.least(end, duration if isinstance(duration, Column) else F.lit(float(duration)))
    g = g.withColumn("start", fixed(F.greatest(F.lit(0.0), F.col("_s") - padding))).withColumn("end", fixed(end))
    return g.select(*keys, "island", "start", "end", fixed(F.col("_score"), 4).alias("score"), "top_label", "frame_count", clock(F.col("start")).alias("time"), *more)


def label_maxima(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label_scores: the maximum of each label over the rows of `keys` (long rows: label, score)."""
    each = frames.groupBy(*keys, "label").agg(F.max("score").alias("score"))
    pairs = F.sort_array(F.collect_list(F.struct("label", fixed(F.col("score"), 4).alias("score"))))
    return each.groupBy(*keys).agg(F.map_from_entries(pairs).alias("label_scores"))


def merge_with_evidence(frames: DataFrame, keys: list[str], order: str = "input_pos", separator: str = "；") -> DataFrame:
    """Islands with gap 0 whose texts are folded in order: a text is left out if it is empty or part of what is there."""
    g = island_ids(frames, keys, 0.0, order).groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", F.col(order).alias("pos"), "evidence"))).alias("_texts"),
    )
    return g.withColumn("evidence", evidence_fold(F.transform("_texts", lambda t: t["evidence"]), separator)).drop("_texts")


def evidence_fold(texts: Column, separator: str = "；") -> Column:
    def add(acc: Column, x: Column) -> Column:
        return F.when(x.isNull() | (x == "") | F.contains(acc, x), acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(separator), x))

    return F.aggregate(texts, F.lit(""), add)


def class_maxima(scores: DataFrame, keys: list[str], frame: str, vector: str, hop: float = C.FRAME_HOP) -> DataFrame:
    """keys, class, score, frame, time: each class's maximum over all frames and the first frame that has it."""
    long = scores.select(*keys, F.col(frame).alias("frame"), F.posexplode(vector).alias("class", "value"))
    best = long.groupBy(*keys, "class").agg(F.max("value").alias("score"), F.min_by("frame", F.struct(-F.col("value"), F.col("frame"))).alias("frame"))
    return best.withColumn("time", F.col("frame").cast("double") * hop)


def frame_argmax(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top_label, score: each frame's best label among long rows (label, label_pos, score); ties go to the first label."""
    return frames.groupBy(*keys).agg(F.max_by("label", F.struct("score", -F.col("label_pos"))).alias("top_label"), F.max("score").alias("score"))
