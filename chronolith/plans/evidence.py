"""The whole event pipeline as one plan per stage: frames to padded, numbered, deduplicated events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import as_confidence
from ..operators import confirmation, dedupe, fusion, islands, padding, selection

CANDIDATE = ["start", "end", "score", "origin", "input_pos"]


def audio_candidates(frames: DataFrame, keys: list[str], duration: Column | float, threshold: float = C.AUDIO_THRESHOLD) -> DataFrame:
    """Islands of frames (frame_idx, start, end, score, top_label) over the threshold."""
    return islands.merge_islands(islands.over_threshold(frames, threshold), keys, C.AUDIO_MERGE_GAP, C.AUDIO_PADDING, duration)


def candidates(audio: DataFrame, visual: DataFrame, scene_hints: DataFrame, keys: list[str], duration: Column, most: int = C.MAX_CANDIDATES) -> DataFrame:
    """Fused, window-sized candidates of three sources: audio and visual intervals, and scene changes that neither covers.

    Every step is keyed alike, so what is partitioned by the keys once stays so.
    """
    a = audio.select(*keys, "start", "end", "score", F.lit("audio").alias("origin"), F.col("input_pos").cast("long").alias("input_pos"))
    v = visual.select(*keys, "start", "end", "score", F.lit("visual_fallback").alias("origin"), F.col("input_pos").cast("long").alias("input_pos"))
    both = a.unionByName(v)
    hints = selection.uncovered_hints(scene_hints, both, keys)
    scenes = selection.greedy_nms(selection.scene_intervals(hints, duration), keys, most, "input_pos").select(*keys, F.explode("kept").alias("x"))
    s = scenes.select(*keys, "x.start", "x.end", "x.score", F.lit("visual_change").alias("origin"), F.col("x.pos").cast("long").alias("input_pos"))
    fused = fusion.fuse(both.unionByName(s), keys, most)
    return selection.split_windows(fused.withColumnRenamed("pos", "candidate_index"))


def events(answers: DataFrame, keys: list[str], duration: Column, min_confidence: float = C.MIN_CONFIDENCE, pad: float = C.EVENT_PADDING, read: Callable[[Column], Column] = as_confidence) -> tuple[DataFrame, DataFrame]:
    """Clips and decisions from answered candidates (keys, candidate_id, cand_start, cand_end, answer VARIANT).

    `read` makes a confidence of an answer's number.
    Clips: one per cluster, numbered in time order, padded within its neighbours.
    Decisions: what became of every proposal, rejected ones included, in decision_order:
    accepted ones by length, confidence, start, end and id, then the others by candidate.
    """
    own = [*keys, "candidate_id"]
    asked = answers.withColumn("clip_duration", F.greatest(F.lit(0.0), F.col("cand_end") - F.col("cand_start")))
    local = confirmation.first_events(confirmation.distinct_events(confirmation.local_events(asked, own, read=read), own), own)
    local = local.join(answers.select(*own, "cand_start", "cand_end"), own)
    judged = confirmation.proposals(local, duration, min_confidence)
    ok = judged.where("status = 'accepted'").select(*keys, "candidate_id", "occurrence_index", "core.start", "core.end", "confidence")
    ok = ok.withColumn("stable_id", confirmation.stable_id(F.col("candidate_id"), F.col("occurrence_index"), F.col("start"), F.col("end")))
    clustered = dedupe.cluster_cores(ok, keys)
    clips = padding.pad_cores(clustered.where("status = 'representative'"), keys, duration, pad)
    late = F.struct(F.lit(None).cast("double").alias("d"), (-F.col("confidence")).alias("c"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("e"), F.lit(None).cast("string").alias("id"))
    rank = F.struct((F.col("end") - F.col("start")).alias("d"), (-F.col("confidence")).alias("c"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("stable_id").alias("id"))
    rejected = judged.where("status <> 'accepted'").select(*keys, "candidate_id", F.lit(None).cast("string").alias("stable_id"), "confidence", "status", F.lit(None).cast("int").alias("cluster_id"), F.lit(1).alias("_late"), late.alias("_rank"))
    decisions = clustered.select(*keys, "candidate_id", "stable_id", "confidence", "status", "cluster_id", F.lit(0).alias("_late"), rank.alias("_rank")).unionByName(rejected)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_late", "_rank", "candidate_id"))
    return clips, decisions.withColumn("decision_order", order).drop("_late", "_rank")
