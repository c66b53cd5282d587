"""Identities, caches and resumable runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .lookups import changed_keys


def identity(**parts: Column) -> Column:
    """SHA-256 of named parts in order of their names; any difference, null included, is another identity."""
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(parts[k].cast("string"), F.lit("\u0000"))) for k in sorted(parts)]
    return F.sha2(F.concat_ws("\u0001", *pairs), 256)


def usable_entries(cache: DataFrame, version: int, source_sha256: Column) -> DataFrame:
    """Cache entries of this version and source; others are as if they weren't there."""
    return cache.where((F.col("version") == version) & (F.col("source_sha256") == source_sha256))


def cached_scans(cache: DataFrame, version: int, identity_: Column) -> DataFrame:
    """Scan entries that may be used again (version, identity, answer): of this version and identity, with an answer that is a JSON object and holds its candidates."""
    answer = F.try_parse_json("answer")
    held = F.schema_of_variant(F.try_variant_get(answer, "$.candidates", "variant")).startswith("ARRAY")
    return cache.where((F.col("version") == version) & (F.col("identity") == identity_) & F.coalesce(held, F.lit(False)))


def run_settings(spark: SparkSession, stage: str, manifest: dict, settings: dict, local_model: dict, remote: dict | None = None) -> DataFrame:
    """key, value (canonical JSON) of what a run depends on besides its media; the remote model counts in the full stage only."""
    parts = {"evaluation_version": C.EVALUATION_VERSION, "pipeline_version": C.PIPELINE_VERSION, "stage": stage, "manifest": manifest, "settings": settings, "local_model": local_model}
    if stage == "full":
        parts["remote_model"] = {k: v.rstrip("/") if k == "base_url" else v for k, v in (remote or {}).items()}
    rows = [(k, json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for k, v in parts.items()]
    return spark.createDataFrame(rows, "key string, value string")


def resumable(old: DataFrame, new: DataFrame) -> DataFrame:
    """Problems that forbid going on with an earlier run: settings (key, value) that changed."""
    return changed_keys(old, new).select("key", F.concat_ws(" -> ", F.coalesce("old", F.lit("none")), F.coalesce("new", F.lit("none"))).alias("problem"))


def resume_problems(previous: DataFrame, manifest_ids: DataFrame, old_media: DataFrame, new_media: DataFrame) -> DataFrame:
    """key, problem of earlier results (id) and media fingerprints (id, path, sha256): repeated results, results that the manifest doesn't have, results without a fingerprint, media that changed since."""
    ids = previous.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    say = lambda d, text: d.select(F.col("id").alias("key"), F.lit(text).alias("problem"))
    o, n = (m.select("id", F.struct("path", "sha256").alias(c)) for m, c in ((old_media, "old"), (new_media, "new")))
    return (
        say(ids.where("n > 1"), "repeated result").unionByName(say(ids.join(manifest_ids.select("id"), "id", "left_anti"), "not in the manifest"))
        .unionByName(say(ids.join(old_media.select("id"), "id", "left_anti"), "no media fingerprint"))
        .unionByName(say(o.join(n, "id").where(~F.col("old").eqNullSafe(F.col("new"))), "its media changed"))
    )


def merged_media(old_media: DataFrame, new_media: DataFrame) -> DataFrame:
    """Fingerprints of both runs; this run's count where both have one."""
    return updated_results(old_media, new_media)


def updated_results(previous: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Earlier results with those of this run in their place; results that this run didn't touch stay."""
    return previous.join(current.select(key), key, "left_anti").unionByName(current, allowMissingColumns=True)
