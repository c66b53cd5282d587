"""The driver's tables read as logical tables of the event analytics, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DURATION = 120.0


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def R(x: str, digits: int = 3) -> str:
    """Rounding in SQL as in `fixed`."""
    unit = f"{10**digits}.0::DOUBLE"
    return f"(floor(({x}) * {unit} + 0.5::DOUBLE) / {unit})"


def IOU(s1: str, e1: str, s2: str, e2: str) -> str:
    return f"(CASE WHEN greatest({e1}, {e2}) - least({s1}, {s2}) > 0 THEN greatest(0.0::DOUBLE, least({e1}, {e2}) - greatest({s1}, {s2})) / (greatest({e1}, {e2}) - least({s1}, {s2})) ELSE 0.0::DOUBLE END)"


def PART(s1: str, e1: str, s2: str, e2: str) -> str:
    return f"(CASE WHEN least({e1} - {s1}, {e2} - {s2}) > 0 THEN greatest(0.0::DOUBLE, least({e1}, {e2}) - greatest({s1}, {s2})) / least({e1} - {s1}, {e2} - {s2}) ELSE 0.0::DOUBLE END)"


def SAME(s1: str, e1: str, s2: str, e2: str) -> str:
    short, long_ = f"least({e1} - {s1}, {e2} - {s2})", f"greatest({e1} - {s1}, {e2} - {s2})"
    return f"({short} > 0 AND ({IOU(s1, e1, s2, e2)} >= 0.5::DOUBLE OR ({PART(s1, e1, s2, e2)} >= 0.8::DOUBLE AND {long_} / (CASE WHEN {short} > 0 THEN {short} ELSE 1.0::DOUBLE END) <= 2.0::DOUBLE)))"


def CONF(x: str) -> str:
    return R(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN coalesce({x}, 0.0::DOUBLE) > 1 AND coalesce({x}, 0.0::DOUBLE) <= 100 THEN coalesce({x}, 0.0::DOUBLE) / 100.0::DOUBLE ELSE coalesce({x}, 0.0::DOUBLE) END))")


def CLOCK(x: str) -> str:
    m = f"floor(greatest({x}, 0.0::DOUBLE) / 60.0::DOUBLE)"
    return f"printf('%02d:%05.2f', {m}::INTEGER, {R(f'greatest({x}, 0.0::DOUBLE) - 60.0::DOUBLE * {m}', 2)})"


FRAMES = f"""frames AS (SELECT user_id AS vid, event_id AS fid, event_type AS label, {R('value / 500.0::DOUBLE', 4)} AS score,
  {R("date_diff('microseconds', TIMESTAMP '2024-01-01', ts)::DOUBLE / 21600000000.0::DOUBLE")} AS st FROM events),
f AS (SELECT *, st + 0.96::DOUBLE AS en FROM frames)"""
PROPOSALS = f"""p AS (SELECT vid, fid, label AS cand, st, {R('st + 0.4::DOUBLE + (fid % 7)::DOUBLE * 0.2::DOUBLE')} AS en, score AS conf FROM f)"""
SIDES = """t AS (SELECT vid, floor(st / 20.0::DOUBLE)::BIGINT AS grp, fid, st, en FROM p WHERE cand = 'purchase'),
c AS (SELECT vid, floor(st / 20.0::DOUBLE)::BIGINT AS grp, fid, st, en FROM p WHERE cand = 'click')"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detector frame: vid, fid, label, score, start, end; six hours of the event table are one second."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("double")
    d = e.select(F.col("user_id").alias("vid"), F.col("event_id").alias("fid"), F.col("event_type").alias("label"), fixed(F.col("value") / 500.0, 4).alias("score"), fixed(micros / F.lit(21600000000.0)).alias("start"))
    return d.withColumn("end", F.col("start") + 0.96)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, stable_id (the frame), candidate_id (the label), start, end, confidence."""
    d = frames(spark, sf_dir)
    end = fixed(F.col("start") + 0.4 + (F.col("fid") % 7).cast("double") * 0.2)
    return d.select("vid", F.col("fid").alias("stable_id"), F.col("label").alias("candidate_id"), "start", end.alias("end"), F.col("score").alias("confidence"))


def truth_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both with vid, grp, pos, start, end: purchases are the truth, clicks the predictions."""
    d = proposals(spark, sf_dir).withColumn("grp", F.floor(F.col("start") / 20.0)).withColumnRenamed("stable_id", "pos")
    d = d.select("vid", "grp", "pos", "start", "end", "candidate_id")
    return d.where("candidate_id = 'purchase'").drop("candidate_id"), d.where("candidate_id = 'click'").drop("candidate_id")


def by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as candidates of three sources: origin and input_pos added."""
    origin = F.when(F.col("label").isin("error", "click"), "audio").when(F.col("label") == "view", "visual_fallback").otherwise("visual_change")
    return frames(spark, sf_dir).withColumn("origin", origin).withColumn("input_pos", F.col("fid"))


MODAL = """m AS (SELECT *, CASE WHEN label IN ('error', 'click') THEN 'audio' WHEN label = 'view' THEN 'visual_fallback' ELSE 'visual_change' END AS origin,
  CASE WHEN label IN ('error', 'click') THEN 0 WHEN label = 'view' THEN 1 ELSE 2 END AS cls FROM f)"""
