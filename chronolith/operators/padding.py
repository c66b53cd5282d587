"""Context around cores, bounded by their neighbours, and adjacent fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import fixed


def pad_cores(cores: DataFrame, keys: list[str], duration: Column | float, padding: float = C.EVENT_PADDING, tie: str = "stable_id") -> DataFrame:
    """`cores` with number (from 1, in time order), clip_start, clip_end, min_start, max_end and conflicts.

    Padding ends halfway to a neighbouring core; where a neighbour overlaps the core,
    there is none on that side and the conflict is named. One window, one exchange.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end", tie)
    duration = duration if isinstance(duration, Column) else F.lit(float(duration))
    d = cores.withColumn("number", F.row_number().over(w)).withColumn("_pe", F.lag("end").over(w)).withColumn("_ns", F.lead("start").over(w))
    before, after = F.col("_pe") > F.col("start"), F.col("_ns") < F.col("end")
    lo = F.when(F.col("_pe").isNull(), F.lit(0.0)).when(before, F.col("start")).otherwise((F.col("_pe") + F.col("start")) / 2.0)
    hi = F.when(F.col("_ns").isNull(), duration).when(after, F.col("end")).otherwise((F.col("end") + F.col("_ns")) / 2.0)
    d = d.withColumn("_lo", lo).withColumn("_hi", hi)
    names = F.array_compact(F.array(F.when(before, F.lit("previous_core_overlap")), F.when(after, F.lit("next_core_overlap"))))
    d = d.withColumn("clip_start", fixed(F.greatest("_lo", F.col("start") - padding))).withColumn("clip_end", fixed(F.least("_hi", F.col("end") + padding)))
    return d.withColumn("min_start", fixed(F.col("_lo"))).withColumn("max_end", fixed(F.col("_hi"))).withColumn("conflicts", names).drop("_pe", "_ns", "_lo", "_hi")


def modalities(origin: Column) -> Column:
    return F.when(origin == "audio_visual", F.array(F.lit("audio"), F.lit("visual"))).when(origin.isin("visual_fallback", "visual_change"), F.array(F.lit("visual"))).when(origin == "audio", F.array(F.lit("audio"))).otherwise(F.array().cast("array<string>"))


def adjacent_groups(clips: DataFrame, keys: list[str], max_gap: float, tie: str) -> DataFrame:
    """`clips` with group_id (from 1): clip and successor are one group if their gap is within [0, max_gap] and their modalities are complementary; two clips at most.

    A run of joinable clips is cut into pairs from its start: the limit makes the
    first of three join the second, which the position's parity in the run says.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end", tie)
    d = clips.withColumn("_m", modalities(F.col("origin"))).withColumn("_gap", F.col("start") - F.lag("end").over(w)).withColumn("_pm", F.lag("_m").over(w))
    fits = F.coalesce((F.col("_gap") >= 0) & (F.col("_gap") <= max_gap) & (F.size("_m") > 0) & (F.size("_pm") > 0) & ~F.arrays_overlap("_m", "_pm"), F.lit(False))
    d = d.withColumn("_fits", fits).withColumn("_run", F.sum((~F.col("_fits")).cast("int")).over(w))
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("start", "end", tie)) - 1)
    d = d.withColumn("group_id", F.sum((F.col("_at") % 2 == 0).cast("int")).over(w).cast("long"))
    return d.drop("_m", "_gap", "_pm", "_fits", "_run", "_at")


def consolidate(groups: DataFrame, keys: list[str], decisions: DataFrame, min_confidence: float = C.MIN_CONFIDENCE) -> DataFrame:
    """One row per group: pairs that a decision (same, count, confidence) calls one event become one clip, others stay as they are."""
    d = groups.join(decisions, [*keys, "group_id"], "left")
    merge = F.coalesce(F.col("same") & (F.col("count") == 1) & (F.col("confidence") >= min_confidence), F.lit(False))
    d = d.withColumn("merged", merge & (F.count(F.lit(1)).over(Window.partitionBy(*keys, "group_id")) == 2))
    part = F.when(F.col("merged"), F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(*keys, "group_id").orderBy("start", "end")))
    return d.withColumn("_part", part).groupBy(*keys, "group_id", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("merged").alias("merged"), F.count(F.lit(1)).alias("members")).drop("_part")
