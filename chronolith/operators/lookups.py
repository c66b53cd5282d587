"""Equi-joins against small dimensions, caches and earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_labels(events: DataFrame, labels: DataFrame, event: str = "event") -> DataFrame:
    """`events` with labels array: those of the first configured event whose name or alias matches (trimmed, without case), else the event itself.

    `labels`: config_pos, name, aliases, detector_labels - a configuration, whose size
    the optimizer checks before it broadcasts it.
    """
    names = labels.select("config_pos", "detector_labels", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_alias"))
    names = names.groupBy(F.lower(F.trim("_alias")).alias("_alias")).agg(F.min_by("detector_labels", "config_pos").alias("_labels"))
    d = events.join(names, F.lower(F.trim(event)) == F.col("_alias"), "left")
    return d.withColumn("labels", F.coalesce("_labels", F.array(event))).drop("_alias", "_labels")


def class_indices(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """label, class_index without regard to case; a label that no class has raises an error when it is read."""
    c = classes.select(F.lower("display_name").alias("_n"), "class_index")
    d = labels.join(c, F.lower("label") == F.col("_n"), "left")
    missing = F.raise_error(F.concat(F.lit("no detector class for label "), F.col("label")))
    return d.withColumn("class_index", F.when(F.col("class_index").isNull(), missing.cast("int")).otherwise(F.col("class_index"))).drop("_n")


def cache_lookup(work: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """`work` with the cached payload and is_hit; the latest entry of a key counts."""
    c = cache.groupBy(key).agg(F.max_by(payload, "written").alias(payload))
    return work.join(c, key, "left").withColumn("is_hit", F.col(payload).isNotNull())


def remaining(work: DataFrame, done: DataFrame, ids: list[str]) -> DataFrame:
    """Work without an `ok` result; failed ones are tried again."""
    return work.join(done.where("status = 'ok'").select(*ids), ids, "left_anti")


def changed_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys (key, value) whose values differ or that only one side has."""
    o, n = old.select("key", F.col("value").alias("old")), new.select("key", F.col("value").alias("new"))
    return o.join(n, "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def merged_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of keys; the new value wins."""
    o, n = old.select("key", F.col("value").alias("old")), new.select("key", F.col("value").alias("new"))
    return o.join(n, "key", "full").select("key", F.coalesce("new", "old").alias("value"))


def missing_rows(needed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return needed.select(key).distinct().join(there.select(key), key, "left_anti")


def first_per_key(items: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, before anything expensive is fetched for it."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def overlapping(events: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """Events that an issue of their group strictly overlaps.

    One pass over both in order of time: of the issues that start before the event ends,
    the one that reaches farthest decides. Null bounds and null keys overlap nothing.
    """
    i = issues.where("start IS NOT NULL AND end IS NOT NULL").select(*keys, F.col("start").alias("_at"), F.col("end").alias("_reach"))
    d = events.withColumn("_at", F.col("end")).unionByName(i, allowMissingColumns=True).withColumn("_event", F.col("_reach").isNull())
    w = Window.partitionBy(*keys).orderBy("_at", F.desc("_event")).rowsBetween(Window.unboundedPreceding, 0)  # at one time, events are first
    d = d.withColumn("_far", F.max("_reach").over(w)).where(F.col("_event") & (F.col("_far") > F.col("start")))
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return d.select(*events.columns)
