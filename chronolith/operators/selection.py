"""Orders, budgets and greedy selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import fixed, iou, overlap_fraction, range_label


def top_k(df: DataFrame, keys: list[str], k: int | Column, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in `order`, with their rank from 1; the limit is pushed before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def budgets(candidates: DataFrame, keys: list[str], most: int = C.MAX_CANDIDATES, most_scene: int = C.SCENE_MAX_CANDIDATES, pos: str = "input_pos") -> DataFrame:
    """The best candidates of each source class: audio and remote visual have `most` each, local scene changes a small budget of their own."""
    kind = F.when(F.col("origin") == "audio", 0).when(F.col("origin") == "visual_change", 2).otherwise(1)
    d = candidates.withColumn("class", kind)
    limit = F.when(F.col("class") == 2, F.lit(min(most, most_scene))).otherwise(F.lit(most))
    ranked = top_k(d, [*keys, "class"], max(most, 1), F.desc("score"), F.asc(pos))
    return ranked.where(F.col("rank") <= limit)


def uncovered_hints(hints: DataFrame, covered_by: DataFrame, keys: list[str], margin: float = C.COVERAGE_MARGIN) -> DataFrame:
    """Hints (time) that lie in no interval (start, end) of their group widened by `margin`.

    One pass over both in order of time: a hint is covered if the intervals that have
    begun reach that far. Null times and null keys are covered by nothing.
    """
    c = covered_by.where("start IS NOT NULL AND end IS NOT NULL").select(*keys, (F.col("start") - margin).alias("_at"), (F.col("end") + margin).alias("_reach"))
    d = hints.withColumn("_at", F.col("time")).unionByName(c, allowMissingColumns=True).withColumn("_hint", F.col("_reach").isNull())
    w = Window.partitionBy(*keys).orderBy("_at", "_hint").rowsBetween(Window.unboundedPreceding, 0)  # at one time, intervals are first
    d = d.withColumn("_far", F.max("_reach").over(w))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return d.where(F.col("_hint") & ~F.coalesce(known & (F.col("_far") >= F.col("time")), F.lit(False))).select(*hints.columns)


def scene_intervals(hints: DataFrame, duration: Column, padding: float = C.VISUAL_PADDING, min_score: float = C.SCENE_MIN_SCORE) -> DataFrame:
    """Hints of sufficient score within the source as candidates that look back a little and ahead by `padding`."""
    t = F.col("time")
    d = hints.where((F.col("score") >= min_score) & (t >= 0) & (t <= duration))
    start, end = F.greatest(F.lit(0.0), t - min(padding, C.SCENE_PRE_PADDING)), F.least(duration, t + padding)
    d = d.withColumn("_s", start).withColumn("_e", end).where("_e > _s")
    d = d.withColumn("start", fixed(F.col("_s"))).withColumn("end", fixed(F.col("_e")))
    return d.withColumn("focus_time", fixed(t - F.col("_s"))).withColumn("change_time", fixed(t)).withColumn("score", fixed(F.least(F.lit(1.0), F.col("score")), 4)).withColumn("label", range_label(F.col("_s"), F.col("_e"))).drop("_s", "_e")


def greedy_nms(df: DataFrame, keys: list[str], most: int, pos: str, top_iou: float = C.NMS_IOU, top_overlap: float = C.NMS_OVERLAP) -> DataFrame:
    """keys, kept array<struct<score,pos,start,end>>: best first, without what overlaps one already kept, `most` at most.

    A fold over the group's sorted array; input_pos breaks ties, the first wins.
    """
    item = F.struct((-F.col("score")).alias("o"), F.col(pos).alias("pos"), "score", "start", "end")
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    near = lambda a, b: (iou(a["start"], a["end"], b["start"], b["end"]) >= top_iou) | (overlap_fraction(a["start"], a["end"], b["start"], b["end"]) >= top_overlap)
    empty = F.slice("items", 1, 0)
    step = lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda a: near(a, x)), acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate("items", empty, step)
    return g.select(*keys, F.transform(kept, lambda x: F.struct(x["score"].alias("score"), x["pos"].alias("pos"), x["start"].alias("start"), x["end"].alias("end"))).alias("kept"))


def split_windows(df: DataFrame, window: float = C.WINDOW_SECONDS, overlap: float = C.WINDOW_OVERLAP) -> DataFrame:
    """Candidates longer than `window` as overlapping windows of that length, the last one anchored at the end.

    Adds parent_start, parent_end, segment_index (from 1) and segment_count, null for
    candidates that stay whole; focus_time, where there is one, is taken relative to
    the window and clamped to it.
    """
    if window <= 0 or not 0 <= overlap < window:
        raise ValueError("0 <= overlap < window is needed")
    length = F.col("end") - F.col("start")
    n = F.when(length <= window, F.lit(1)).otherwise(F.ceil((length - overlap) / (window - overlap)).cast("int"))
    d = df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = (length - window) / F.nullif(F.col("_n") - 1, F.lit(0)).cast("double")
    whole, last = F.col("_n") == 1, F.col("_i") == F.col("_n") - 1
    raw = F.when(last, F.col("end") - window).otherwise(F.col("start") + step * F.col("_i"))
    d = d.withColumn("_s", F.when(whole, F.col("start")).otherwise(fixed(raw)))
    d = d.withColumn("_e", F.when(whole, F.col("end")).when(last, fixed(F.col("end"))).otherwise(fixed(raw + window)))
    if "focus_time" in df.columns:
        focus = fixed(F.greatest(F.lit(0.0), F.least(F.lit(window), F.col("start") + F.col("focus_time") - F.col("_s"))))
        d = d.withColumn("focus_time", F.when(whole | F.col("focus_time").isNull(), F.col("focus_time")).otherwise(focus))
    part = lambda x: F.when(~whole, x)
    d = d.withColumn("parent_start", part(fixed(F.col("start")))).withColumn("parent_end", part(fixed(F.col("end"))))
    d = d.withColumn("segment_index", part(F.col("_i") + 1)).withColumn("segment_count", part(F.col("_n")))
    return d.withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_s", "_e", "_i", "_n")


def sample_sparsely(frames: DataFrame, keys: list[str], interval: float = C.SCAN_INTERVAL, time: str = "time") -> DataFrame:
    """The first frame of every `interval` seconds."""
    d = frames.withColumn("bucket", F.floor(F.col(time) / interval).cast("long"))
    return top_k(d, [*keys, "bucket"], 1, F.asc(time)).drop("rank")
