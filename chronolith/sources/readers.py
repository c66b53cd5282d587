"""Sources: documents of the event pipeline as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clean_html, clock_seconds, fixed

PROBE = "struct<format:struct<duration:string,size:string>,streams:array<struct<codec_type:string,codec_name:string>>>"
MANIFEST = "version int, name string, root string, default_event string, samples array<struct<id:string,path:string,event:string,expected:boolean,split:string,kind:string,notes:string,events:array<struct<start:double,end:double>>>>"
#: Field names of documents are fixed values. A label configuration names the detector's classes in yamnet_labels; detector_labels is taken too.
LABELS = "events array<struct<name:string,aliases:array<string>,yamnet_labels:array<string>,detector_labels:array<string>>>"
CATALOG = "version int, items array<struct<id:string,file_title:string,filename:string,license_expected:string,license_review_note:string,source_group:string,derivative_url:string,derivative_size:bigint,local_path:string,local_existing:boolean,expected:boolean,clip_start:double,clip_end:double>>"
BASELINE = "run_date string, model string, source string, question string, result struct<summary:string,events:array<struct<time:string,visual:string,audio:string,relation:string>>>, verification struct<json_valid:boolean,audio_mean_db_by_second:array<double>,assessment:string,issues:array<struct<time:string,label:string,detail:string>>>"


def probes(df: DataFrame, raw: str = "raw") -> DataFrame:
    """duration, size, has_video, has_audio, streams of probe reports in JSON (one a row)."""
    d = df.withColumn("_p", F.from_json(raw, PROBE))
    has = lambda kind: F.coalesce(F.exists("_p.streams", lambda s: s["codec_type"] == kind), F.lit(False))
    seconds = F.col("_p.format.duration").try_cast("double")
    d = d.withColumn("exact_duration", seconds).withColumn("duration", fixed(seconds)).withColumn("size", F.col("_p.format.size").try_cast("long"))
    return d.withColumn("has_video", has("video")).withColumn("has_audio", has("audio")).withColumn("streams", F.col("_p.streams")).drop("_p")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """class_index, display_name of a detector's class map (CSV with index, mid, display_name)."""
    return spark.read.schema("class_index int, mid string, display_name string").csv(path, header=True).select("class_index", "display_name")


def event_config(spark: SparkSession, path: str) -> DataFrame:
    """config_pos, name, aliases, detector_labels of a label configuration in JSON."""
    d = spark.read.schema(LABELS).json(path, multiLine=True)
    d = d.select(F.posexplode("events").alias("config_pos", "e"))
    return d.select("config_pos", "e.name", "e.aliases", F.coalesce("e.yamnet_labels", "e.detector_labels").alias("detector_labels"))


def _of_version(d: DataFrame, kind: str) -> DataFrame:
    """`d`, or an error when it's read if its version isn't 1."""
    return d.where(F.when(F.col("version") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{kind} version 1 is needed")).cast("boolean")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """pos, id, path, event, expected, split, kind, notes, events of a manifest's samples; an unknown version raises."""
    d = _of_version(spark.read.schema(MANIFEST).json(path, multiLine=True), "manifest")
    d = d.select("root", "default_event", F.posexplode("samples").alias("pos", "s"))
    where = F.when(F.col("s.path").startswith("/") | F.col("root").isNull(), F.col("s.path")).otherwise(F.concat_ws("/", F.rtrim(F.col("root"), F.lit("/")), "s.path"))
    return d.select("pos", "s.id", where.alias("path"), F.coalesce("s.event", "default_event").alias("event"), "s.expected", "s.split", "s.kind", "s.notes", F.coalesce("s.events", F.array().cast("array<struct<start:double,end:double>>")).alias("events"))


def manifest_problems(samples: DataFrame) -> DataFrame:
    """id, problem of every sample that breaks a rule: ids present and different, expected and event given, intervals valid, positives with events."""
    bad = lambda e: ~F.coalesce((e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] < float("inf")), F.lit(False))
    rules = {
        "no id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "no event": F.coalesce(F.trim("event"), F.lit("")) == "",
        "expected is no boolean": F.col("expected").isNull(),
        "invalid interval": F.exists("events", bad),
        "positive without events": F.coalesce(F.col("expected"), F.lit(False)) & (F.size("events") == 0),
        "repeated id": F.count(F.lit(1)).over(Window.partitionBy("id")) > 1,
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return samples.withColumn("_found", found).select("id", F.explode("_found").alias("problem"))


def checked(samples: DataFrame) -> DataFrame:
    """`samples`, or an error when they're read that names the first problem."""
    first = manifest_problems(samples).agg(F.min(F.concat_ws(": ", "id", "problem")).alias("_problem"))
    d = samples.join(F.broadcast(first))  # one row
    return d.where(F.when(F.col("_problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_problem")).cast("boolean"))).drop("_problem")


def selected(samples: DataFrame, split: str | None = None, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The samples of a split, then those with the ids, then the first `limit` in the manifest's order."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    d = samples if split is None else samples.where(F.col("split") == split)
    d = d if not ids else d.where(F.col("id").isin(*ids))
    return d if limit is None else d.orderBy("pos").limit(limit)


def scene_hints(logs: DataFrame, keys: list[str], text: str = "value", most: int = C.SCENE_MAX_HINTS) -> DataFrame:
    """keys, time, score of scene changes in filter logs (a whole log a row): the `most` strongest, to be read in time order.

    A score belongs to the last time before it, a time to the first score after it; scores
    without one and values that are no numbers are left out, and a time that is no number
    takes the place of the one before.
    """
    lines = logs.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    part = lambda pattern: F.nullif(F.regexp_extract("line", pattern + number, 1), F.lit("")).try_cast("double")
    d = lines.withColumn("t", F.when(F.contains("line", F.lit("pts_time:")), F.struct(part(r"pts_time:\s*").alias("at")))).withColumn("s", part(r"lavfi\.scene_score=\s*"))
    w = Window.partitionBy(*keys).orderBy("pos")
    d = d.withColumn("time", F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["at"]).withColumn("_n", F.count("t").over(w))
    first = Window.partitionBy(*keys, "_n").orderBy("pos")
    d = d.where("s IS NOT NULL AND time IS NOT NULL").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    d = d.select(*keys, fixed(F.col("time")).alias("time"), fixed(F.col("s"), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "time"))
    return d.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def data_url(mime: Column, content: Column) -> Column:
    """Bytes as a data URL; null where they exceed the upload limit."""
    url = F.concat(F.lit("data:"), F.coalesce(mime, F.lit("video/mp4")), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
    return F.when(F.length(content) <= C.MAX_UPLOAD_BYTES, url)


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, content of files; the digest is computed where the file is read."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def folder_fingerprints(files: DataFrame, folder: Column) -> DataFrame:
    """folder, n_files, sha256: one digest over a folder's files (name: the path in the folder, sha256), by name.

    Digested are, of each file, the length of the name in eight bytes, the name and the
    file's digest. One digest needs its input in one place: a folder's names and digests
    are one row, the files' contents aren't.
    """
    name = F.encode("name", "utf-8")
    item = F.struct("name", F.concat(F.lpad(F.hex(F.octet_length(name)), 16, "0"), F.hex(name), F.upper("sha256")).alias("t"))
    g = files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_list(item)).alias("_items"))
    return g.select("folder", "n_files", F.sha2(F.unhex(F.array_join(F.transform("_items", lambda i: i["t"]), "")), 256).alias("sha256"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """pos and the fields of a source catalog's items; an unknown version raises."""
    d = _of_version(spark.read.schema(CATALOG).json(path, multiLine=True), "catalog")
    return d.select(F.posexplode("items").alias("pos", "i")).select("pos", "i.*")


def demo_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A demo run's document as one row: what was asked and answered, and how the answer was verified."""
    return spark.read.schema(BASELINE).json(path, multiLine=True)


def demo_events(baseline: DataFrame) -> DataFrame:
    """source, pos, time, start, end (seconds of the clock times), visual, audio, relation of a demo run's events."""
    d = baseline.select("source", F.posexplode("result.events").alias("pos", "e")).select("source", "pos", "e.*")
    ends = F.split("time", "-")
    return d.select("source", "pos", "time", clock_seconds(F.get(ends, 0)).alias("start"), clock_seconds(F.get(ends, 1)).alias("end"), "visual", "audio", "relation")


def demo_levels(baseline: DataFrame) -> DataFrame:
    """source, second, mean_db of a demo run's verification."""
    return baseline.select("source", F.posexplode("verification.audio_mean_db_by_second").alias("second", "mean_db"))


FIELD = "struct<value:string>"
FILE_INFO = f"title string, imageinfo array<struct<descriptionurl:string,url:string,size:bigint,width:int,height:int,mime:string,sha1:string,extmetadata:struct<LicenseShortName:{FIELD},LicenseUrl:{FIELD},Artist:{FIELD},Credit:{FIELD},DateTimeOriginal:{FIELD}>>>"


def file_infos(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """`answers` with title, urls, size, type and licence fields of file descriptions in JSON, free of markup."""
    i = F.col("_p.imageinfo")[0]
    meta = {"license": "LicenseShortName", "license_url": "LicenseUrl", "artist": "Artist", "credit": "Credit", "date_time_original": "DateTimeOriginal"}
    d = answers.withColumn("_p", F.from_json(answer, FILE_INFO))
    plain = {"description_url": "descriptionurl", "download_url": "url", "size": "size", "width": "width", "height": "height", "mime": "mime", "sha1": "sha1"}
    d = d.withColumn("canonical_title", F.col("_p.title")).withColumns({k: i[v] for k, v in plain.items()})
    return d.withColumns({k: clean_html(i["extmetadata"][v]["value"]) for k, v in meta.items()}).drop("_p")
