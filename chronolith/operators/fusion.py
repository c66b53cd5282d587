"""Cross-modal fusion: a fold of visual candidates into the audio ones, in the order of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import fixed, iou
from .selection import budgets

ITEM = "struct<start:double,end:double,score:double,origin:string,audio_score:double,visual_score:double,evidence:string,pos:bigint>"


def _merge(a: Column, v: Column) -> Column:
    text = F.trim(F.coalesce(v["evidence"], F.lit("")))
    return F.struct(
        fixed(F.least(a["start"], v["start"])).alias("start"),
        fixed(F.greatest(a["end"], v["end"])).alias("end"),
        F.greatest(a["score"], v["score"]).alias("score"),
        F.lit("audio_visual").alias("origin"),
        F.coalesce(a["audio_score"], a["score"]).alias("audio_score"),
        v["score"].alias("visual_score"),
        F.when(text != "", text).otherwise(a["evidence"]).alias("evidence"),
        a["pos"].alias("pos"),
    ).cast(ITEM)


def fuse(candidates: DataFrame, keys: list[str], most: int = C.MAX_CANDIDATES, pos: str = "input_pos", evidence: str | None = None) -> DataFrame:
    """keys, start, end, score, origin, audio_score, visual_score, evidence, pos of each group's fused candidates.

    Each visual candidate (remote ones first, by score) widens the audio candidate
    that it overlaps best at that moment, from the fusion IoU on (the first of
    equals); else it stands for itself and isn't matched by later ones.
    """
    picked = budgets(candidates, keys, most, pos=pos)
    item = F.struct(
        F.col("class").alias("c"), (-F.col("score")).alias("o"), F.col(pos).cast("long").alias("p"),
        F.struct("start", "end", "score", "origin", F.lit(None).cast("double").alias("audio_score"), F.lit(None).cast("double").alias("visual_score"), (F.col(evidence) if evidence else F.lit(None)).cast("string").alias("evidence"), F.col(pos).cast("long").alias("pos")).cast(ITEM).alias("x"),
    )
    g = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    seeds = F.transform(F.filter("items", lambda i: i["c"] == 0), lambda i: i["x"])
    later = F.transform(F.filter("items", lambda i: i["c"] > 0), lambda i: i["x"])

    def step(acc: Column, v: Column) -> Column:
        shares = F.transform(acc, lambda a: F.when(a["origin"].isin("audio", "audio_visual"), iou(a["start"], a["end"], v["start"], v["end"])).otherwise(F.lit(-1.0)))
        best = F.array_max(shares)
        at = F.array_position(shares, best)
        merged = F.transform(acc, lambda a, i: F.when(i + 1 == at, _merge(a, v)).otherwise(a))
        return F.when(F.coalesce(best, F.lit(-1.0)) >= C.FUSION_IOU, merged).otherwise(F.concat(acc, F.array(v)))

    fused = F.aggregate(later, seeds, step)
    return g.select(*keys, F.explode(fused).alias("x")).select(*keys, "x.*")
