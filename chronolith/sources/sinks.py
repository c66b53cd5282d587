"""Sinks: reports, caches and results. Spark's committers make each write all or nothing."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.write.mode("overwrite").json(path)


def as_report(df: DataFrame, keys: list[str], name: str = "results") -> DataFrame:
    """One nested document per key: its rows, in order, as an array."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias(name))


def append_entries(entries: DataFrame, path: str) -> None:
    """Add cache or result entries with the time of writing; readers take the latest of a key."""
    entries.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def latest_entries(spark: SparkSession, path: str, key: str) -> DataFrame:
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), "written").alias("e")).select(key, "e.*")


def report_path(source: str, folder: str) -> str:
    """Where a source's candidate report goes: the file itself if it is named .json, else <folder>/<stem>_candidates.json."""
    if folder.endswith(".json"):
        return folder
    stem = source.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{folder.rstrip('/')}/{stem}_candidates.json"


def try_append(entries: DataFrame, path: str) -> str | None:
    """`append_entries`, or what went wrong: a cache that can't be written doesn't end a run, its report says so (cache_write_error)."""
    try:
        append_entries(entries, path)
    except (PySparkException, Py4JError) as e:
        return f"{type(e).__name__}: {str(e).splitlines()[0]}"
    return None


def write_items(items: DataFrame, path: str, version: int = 1) -> None:
    """One document of a version and its items, in order of pos: metadata of a catalog, some dozens of rows."""
    fields = [c for c in items.columns if c != "pos"]
    d = items.groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("i")))).alias("all"))
    d.select(F.lit(version).alias("version"), F.transform("all", lambda x: x["i"]).alias("items")).coalesce(1).write.mode("overwrite").json(path)


def cache_counters(lookups: DataFrame, keys: list[str], written: DataFrame | None = None) -> DataFrame:
    """keys, hits, misses, writes of cache lookups (is_hit) and of the entries written after them."""
    d = lookups.groupBy(*keys).agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
    if written is None:
        return d.withColumn("writes", F.lit(0).cast("long"))
    w = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("writes"))
    return d.join(w, keys, "left").withColumn("writes", F.coalesce("writes", F.lit(0).cast("long")))


def run_reports(media: DataFrame, candidates: DataFrame, decisions: DataFrame, clips: DataFrame, keys: list[str], caches: DataFrame | None = None) -> DataFrame:
    """keys, report (JSON): one document per media item: its fields, status, counts, candidates, decisions and results, each in order.

    `media` has the keys, scan_error (null if the scan went well) and any other field;
    `clips` a status. Status: visual_scan_failed without candidates after a scan error,
    no_candidate, no_confirmed_event, completed_with_errors, completed. A document is
    one row, bounded by the budgets of candidates and events of a media item.
    """
    def listed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        fields = [c for c in df.columns if c not in keys]
        rows = F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("row"))))
        return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["row"]).alias(name))

    done = clips.groupBy(*keys).agg(F.count_if(F.col("status") == "completed").alias("_done"), F.count_if(F.col("status") == "error").alias("_errors"))
    d = media.join(listed(candidates, "candidates", ["start", "end"]), keys, "left").join(listed(decisions, "decisions", ["decision_order"]), keys, "left").join(listed(clips, "results", ["start", "end"]), keys, "left").join(done, keys, "left")
    counts = {"_done": F.coalesce("_done", F.lit(0).cast("long")), "_errors": F.coalesce("_errors", F.lit(0).cast("long"))}
    none = F.coalesce(F.size("candidates"), F.lit(0)) == 0
    status = (
        F.when(none & F.col("scan_error").isNotNull(), "visual_scan_failed").when(none, "no_candidate")
        .when(F.col("_errors") > 0, "completed_with_errors").when(F.col("_done") > 0, "completed").otherwise("no_confirmed_event")
    )
    d = d.withColumns(counts).withColumn("status", status).withColumnsRenamed({"_done": "outputs", "_errors": "errors"})
    if caches is not None:
        d = d.join(caches.select(*keys, F.struct(*(c for c in caches.columns if c not in keys)).alias("cache")), keys, "left")
    return d.select(*keys, F.to_json(F.struct(*d.columns)).alias("report"))
