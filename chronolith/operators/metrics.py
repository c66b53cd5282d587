"""Scores of predictions against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio


def confusion(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """total, evaluated, errors, tp, tn, fp, fn and precision, recall, f1, accuracy of results (status, expected, predicted); only `ok` ones are scored."""
    ok, e, p = F.col("status") == "ok", F.col("expected"), F.col("predicted")
    d = results.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("evaluated"),
        F.count_if(ok & e & p).alias("tp"), F.count_if(ok & ~e & ~p).alias("tn"), F.count_if(ok & ~e & p).alias("fp"), F.count_if(ok & e & ~p).alias("fn"),
    ).withColumn("errors", F.col("total") - F.col("evaluated"))
    return with_rates(d).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("evaluated")))


def with_rates(d: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return d.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def temporal(n_truth: DataFrame, n_predictions: DataFrame, matches: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One row: event-level counts and rates, mean IoU and errors of matches and, with `coverage`, complete coverage.

    n_truth and n_predictions are event rows; `coverage` has the matches per group. Of
    the matched events those count as completely covered whose own clip (p_clip_start,
    p_clip_end of `matches`, else the prediction) contains them. All sides are
    one table, aggregated once.
    """
    one, nil = F.lit(1).cast("long"), F.lit(None)
    means = ["iou", "start_error", "end_error"]
    clip = [F.coalesce(F.col(f"p_clip_{x}"), F.col(f"p_{x}")) if f"p_clip_{x}" in matches.columns else F.col(f"p_{x}") for x in ("start", "end")]
    counts = lambda df, **own: df.select(*(own.get(c, F.lit(0).cast("long")).alias(c) for c in ("n_truth", "n_predictions", "tp", "complete", "complete_matched")), *(F.col(c) if c in own else nil.cast("double").alias(c) for c in means))
    inside = F.coalesce((clip[0] <= F.col("t_start")) & (clip[1] >= F.col("t_end")), F.lit(False)).cast("long") if coverage is not None else F.lit(0).cast("long")
    rows = counts(n_truth, n_truth=one).unionByName(counts(n_predictions, n_predictions=one)).unionByName(counts(matches, tp=one, complete_matched=inside, **dict.fromkeys(means)))
    if coverage is not None:
        rows = rows.unionByName(counts(coverage, complete=F.col("matches")))
    total = {c: F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("n_truth", "n_predictions", "tp", "complete", "complete_matched")}
    d = rows.agg(*(x.alias(c) for c, x in total.items()), F.round(F.avg("iou"), 4).alias("mean_iou"), F.round(F.avg("start_error"), 4).alias("mean_start_error"), F.round(F.avg("end_error"), 4).alias("mean_end_error"))
    d = with_rates(d.withColumn("fp", F.col("n_predictions") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp")))
    out = ["n_truth", "n_predictions", "tp", "mean_iou", "mean_start_error", "mean_end_error", "fp", "fn", "precision", "recall", "f1"]
    if coverage is None:
        return d.select(*out)
    return d.select(*out, "complete", ratio(F.col("complete"), F.col("n_truth")).alias("complete_coverage_recall"), ratio(F.col("complete_matched"), F.col("tp")).alias("complete_coverage_rate_on_matched"))
