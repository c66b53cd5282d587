"""Candidates of a visual scan: a model's answer normalised, merged, selected and padded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import as_confidence, fixed, range_label
from .islands import merge_with_evidence
from .selection import top_k


def scanned(answers: DataFrame, keys: list[str], duration: Column, answer: str = "answer", least: float = C.MIN_VISUAL_CONFIDENCE) -> DataFrame:
    """keys, input_pos, start, end, score, evidence of the entries of VARIANT answers' `candidates` that are sure enough and not empty within the source."""
    listed = F.schema_of_variant(F.try_variant_get(answer, "$.candidates", "variant")).startswith("ARRAY")
    many = F.when(F.coalesce(listed, F.lit(False)), F.try_variant_get(answer, "$.candidates", "array<variant>"))
    d = answers.withColumn("_duration", duration).select(*keys, "_duration", F.posexplode(many).alias("input_pos", "v"))
    number = lambda name: F.try_variant_get("v", f"$.{name}", "double")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.col("_duration"), x))
    d = d.where(F.schema_of_variant("v").startswith("OBJECT")).withColumn("_s", number("start")).withColumn("_e", number("end"))
    d = d.where("_s IS NOT NULL AND _e IS NOT NULL").withColumn("score", as_confidence(number("confidence"))).where(F.col("score") >= least)
    d = d.withColumn("_s", clamp(F.col("_s"))).withColumn("_e", clamp(F.col("_e"))).where("_e > _s")
    text = F.trim(F.coalesce(F.try_variant_get("v", "$.visual_evidence", "string"), F.lit("")))
    return d.select(*keys, "input_pos", fixed(F.col("_s")).alias("start"), fixed(F.col("_e")).alias("end"), "score", text.alias("evidence"))


def visual_candidates(answers: DataFrame, keys: list[str], duration: Column, padding: float = C.VISUAL_PADDING, most: int = C.MAX_CANDIDATES, answer: str = "answer") -> DataFrame:
    """keys, start, end, score, evidence, origin, label: overlapping entries merged, the best ones selected, then padded.

    `duration` is a column of `answers`; it has to be one of the keys or depend on them alone.
    """
    d = answers.select(*keys, duration.alias("_duration"), answer)
    merged = merge_with_evidence(scanned(d, [*keys, "_duration"], F.col("_duration"), answer), [*keys, "_duration"])
    best = top_k(merged, keys, most, F.desc("score"), F.asc("start"))
    best = best.withColumn("start", fixed(F.greatest(F.lit(0.0), F.col("start") - padding))).withColumn("end", fixed(F.least(F.col("_duration"), F.col("end") + padding)))
    return best.select(*keys, "start", "end", "score", "evidence", F.lit("visual_fallback").alias("origin"), range_label(F.col("start"), F.col("end")).alias("label"))
