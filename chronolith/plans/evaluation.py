"""Scoring of a run: results against a manifest's truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import lookups, matching, metrics, reviews, runs


def event_rows(results: DataFrame, column: str) -> DataFrame:
    """id, pos, start, end and, for predictions, clip bounds of the intervals in an array column."""
    return results.select("id", F.posexplode(column).alias("pos", "x")).select("id", "pos", "x.*")


def score(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classification, temporal and strict temporal metrics of results (id, status, expected, predicted, events, predictions).

    Complete coverage is judged on the clips where there are any: as the largest matching
    of events and clips, and as the share of matched events that lie in their own clip.
    """
    ok = results.where("status = 'ok'")
    truth, found = event_rows(ok, "events"), event_rows(ok, "predictions")
    clips = found.select("id", "pos", F.coalesce("clip_start", "start").alias("start"), F.coalesce("clip_end", "end").alias("end"))
    covered = matching.matching_size(matching.coverage_edges(truth, clips, ["id"]), ["id"])
    by = lambda least: matching.match(matching.iou_edges(truth, found, ["id"], least), ["id"])
    own = found.select("id", F.col("pos").alias("p_pos"), F.col("clip_start").alias("p_clip_start"), F.col("clip_end").alias("p_clip_end"))
    matched = by(C.MATCH_IOU).join(own, ["id", "p_pos"])
    return metrics.confusion(results), metrics.temporal(truth, found, matched, covered), metrics.temporal(truth, found, by(C.STRICT_MATCH_IOU))


def results_of(reports: DataFrame, samples: DataFrame) -> DataFrame:
    """One result per sample: `ok` with its completed events if its report may be scored, else `error`."""
    good = reviews.scorable(reports)
    done = F.filter("results", lambda r: r["status"] == "completed")
    rows = F.transform(done, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["clip_start"].alias("clip_start"), r["clip_end"].alias("clip_end")))
    g = good.select("id", rows.alias("predictions"))
    d = samples.select("id", "expected", "events").join(g, "id", "left")
    return d.select("id", F.when(F.col("predictions").isNull(), "error").otherwise("ok").alias("status"), "expected", (F.coalesce(F.size("predictions"), F.lit(0)) > 0).alias("predicted"), "events", "predictions")


def resume(samples: DataFrame, previous: DataFrame, old_settings: DataFrame, new_settings: DataFrame, old_media: DataFrame | None = None, new_media: DataFrame | None = None) -> DataFrame:
    """Samples still to be run. What forbids going on raises when it is read: other settings and, with media fingerprints, unfit earlier results or changed media."""
    found = runs.resumable(old_settings, new_settings)
    if old_media is not None and new_media is not None:
        found = found.unionByName(runs.resume_problems(previous, samples, old_media, new_media))
    problem = found.agg(F.min(F.concat_ws(": ", "key", "problem")).alias("_problem"))
    left = lookups.remaining(samples, previous, ["id"]).join(F.broadcast(problem))  # one row
    return left.where(F.when(F.col("_problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_problem")).cast("boolean"))).drop("_problem")
