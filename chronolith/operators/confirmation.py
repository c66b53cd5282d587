"""Model answers to proposals: normalised events, cores, rejects and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import as_confidence, fixed, source_core


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def candidate_id(candidate: Column) -> Column:
    """16 hex digits of the candidate's canonical text."""
    return F.substring(F.sha2(candidate, 256), 1, 16)


def stable_id(cid: Column, occurrence: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%s:%.3f-%.3f", cid, occurrence.cast("string"), start, end)


def local_events(answers: DataFrame, keys: list[str], answer: str = "answer", clip_duration: str = "clip_duration", tolerance: float = C.BOUND_TOLERANCE, read: Callable[[Column], Column] = as_confidence) -> DataFrame:
    """keys, pos, event_start, event_end, confidence, visual_evidence, audio_evidence, reason: clip-local events of VARIANT answers.

    The answer's events array, or the answer itself as one event where it has no such
    field. Bounds outside the clip by more than the tolerance, out of order or not
    finite drop the event; the rest is clamped to the clip. Missing fields are the
    answer's own. `read` makes a confidence of the number: a model's may be percent.
    """
    a = F.col(answer)
    listed = F.schema_of_variant(F.try_variant_get(a, "$.events", "variant"))
    has = F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(a, "$", "map<string,variant>")), "events"), F.lit(False))
    many = F.when(F.coalesce(listed.startswith("ARRAY"), F.lit(False)), F.try_variant_get(a, "$.events", "array<variant>")).otherwise(F.array().cast("array<variant>"))
    d = answers.select(*keys, answer, clip_duration, F.posexplode(F.when(has, many).otherwise(F.array(a))).alias("pos", "v"))
    v, top = F.col("v"), _number(a, "$.confidence")
    text = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.try_variant_get(a, f"$.{name}", "string"), F.lit(""))
    d = d.where(F.schema_of_variant(v).startswith("OBJECT"))
    d = d.withColumn("_s", F.coalesce(_number(v, "$.event_start"), _number(v, "$.start"))).withColumn("_e", F.coalesce(_number(v, "$.event_end"), _number(v, "$.end")))
    length = F.col(clip_duration)
    d = d.where((F.col("_s") >= -tolerance) & (F.col("_e") <= length + tolerance) & (F.col("_e") > F.col("_s")) & ~F.isnan("_s") & ~F.isnan("_e"))
    clamp = lambda x: fixed(F.greatest(F.lit(0.0), F.least(length, x)))
    out = d.select(*keys, "pos", clamp(F.col("_s")).alias("event_start"), clamp(F.col("_e")).alias("event_end"), read(F.coalesce(_number(v, "$.confidence"), top)).alias("confidence"), text("visual_evidence").alias("visual_evidence"), text("audio_evidence").alias("audio_evidence"), text("reason").alias("reason"))
    return out.where("event_end > event_start")


def distinct_events(events: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One event per bounds: the most confident, the first of equals."""
    w = Window.partitionBy(*keys, "event_start", "event_end").orderBy(F.desc("confidence"), pos)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_events(events: DataFrame, keys: list[str], most: int = C.MAX_EVENTS) -> DataFrame:
    """The first `most` events in time order, with occurrence_index from 1."""
    w = Window.partitionBy(*keys).orderBy("event_start", "event_end")
    return events.withColumn("occurrence_index", F.row_number().over(w)).where(F.col("occurrence_index") <= most)


def confirmations(events: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confirmed, confidence, occurrence_count: an answer is confirmed by the events that survived, whatever it says itself."""
    e = events.groupBy(*keys).agg(F.max("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"))
    d = tops.join(e, keys, "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return d.select(*keys, (n > 0).alias("confirmed"), F.greatest("top_confidence", F.coalesce("_c", F.lit(0.0))).alias("confidence"), n.alias("occurrence_count"))


def proposals(events: DataFrame, duration: Column, min_confidence: float = C.MIN_CONFIDENCE) -> DataFrame:
    """`events` (cand_start, cand_end, event_start, event_end, confidence) with core, status: accepted, low_confidence or invalid_event_core."""
    core = source_core(F.col("cand_start"), F.col("cand_end"), F.col("event_start"), F.col("event_end"), duration)
    d = events.withColumn("core", core)
    return d.withColumn("status", F.when(F.col("confidence") < min_confidence, "low_confidence").when(F.col("core").isNull(), "invalid_event_core").otherwise("accepted"))


def provenance(proposals: DataFrame, *fields: str) -> DataFrame:
    """`proposals` with a struct of the fields that a report keeps of each."""
    return proposals.withColumn("provenance", F.struct(*(F.col(f).alias(f.split(".")[-1]) for f in fields)))
