"""Technical and model reviews of clips, and how a run ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import fixed


def technical_review(clips: DataFrame) -> DataFrame:
    """`clips` (expected_seconds, duration, size, streams) with each check and passed."""
    has = lambda kind: F.exists("streams", lambda s: s["codec_type"] == kind)
    d = clips.withColumn("has_video", has("video")).withColumn("has_audio", has("audio"))
    d = d.withColumn("duration_ok", F.abs(F.col("duration") - F.col("expected_seconds")) <= C.TECHNICAL_TOLERANCE).withColumn("nonempty", F.col("size") > 0)
    return d.withColumn("passed", F.col("has_video") & F.col("has_audio") & F.col("duration_ok") & F.col("nonempty"))


def review_passed(review: Column, min_confidence: float = C.MIN_CONFIDENCE) -> Column:
    return F.coalesce(review["event_present"] & review["complete"] & (review["confidence"] >= min_confidence), F.lit(False))


def reviewed(clips: DataFrame, padding: float = C.RETRY_PADDING, min_confidence: float = C.MIN_CONFIDENCE) -> DataFrame:
    """`clips` (clip_start, clip_end, min_start, max_end, review1, review2) with final bounds, retried and status.

    A clip that shows its event but not all of it is widened once, on the sides that
    the first review names (both if none), within the limits; then the second counts.
    """
    r1, r2 = F.col("review1"), F.col("review2")
    ok = review_passed(r1, min_confidence)
    neither = ~(r1["needs_more_before"] | r1["needs_more_after"])
    start = F.greatest("min_start", F.col("clip_start") - F.when(r1["needs_more_before"] | neither, padding).otherwise(0.0))
    end = F.least("max_end", F.col("clip_end") + F.when(r1["needs_more_after"] | neither, padding).otherwise(0.0))
    grows = (start < F.col("clip_start")) | (end > F.col("clip_end"))
    d = clips.withColumn("retried", ~ok & r1["event_present"] & grows)
    d = d.withColumn("final_start", F.when(F.col("retried"), fixed(start)).otherwise(F.col("clip_start"))).withColumn("final_end", F.when(F.col("retried"), fixed(end)).otherwise(F.col("clip_end")))
    passed = ok | (F.col("retried") & review_passed(r2, min_confidence))
    return d.withColumn("status", F.when(passed, "completed").otherwise("model_review_failed"))


def cut_plan(clips: DataFrame, start: str, end: str) -> DataFrame:
    """What to cut: offset and seconds, a tenth of a second at least."""
    return clips.withColumn("offset", F.col(start)).withColumn("seconds", fixed(F.greatest(F.lit(C.MIN_CUT_SECONDS), F.col(end) - F.col(start))))


def run_status(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status of each run: errors outweigh outputs, outputs outweigh none."""
    error, done = F.bool_or(F.col("status") == "error"), F.bool_or(F.col("status") == "completed")
    return results.groupBy(*keys).agg(F.when(error, "completed_with_errors").when(done, "completed").otherwise("no_confirmed_event").alias("status"), F.count_if(F.col("status") == "completed").alias("outputs"))


def scorable(reports: DataFrame) -> DataFrame:
    """Reports that may be scored: a successful status, no scan error, no result with an error."""
    bad = F.exists("results", lambda r: r["status"] == "error")
    return reports.where(F.col("status").isin(*C.SUCCESSFUL_STATUSES) & F.col("visual_error").isNull() & ~bad)
