import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import confirmation, dedupe, fusion, islands, matching, metrics, padding, reviews, selection


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_islands_merge_and_take_the_last_best_label(spark):
    d = frame(spark, [(0, 1.0, 1.96, 0.6, "Glass"), (1, 1.48, 2.44, 0.8, "Shatter"), (2, 8.0, 9.0, 0.05, "Glass")], "frame_idx int, start double, end double, score double, top_label string").withColumn("vid", F.lit(1))
    got = islands.merge_islands(islands.over_threshold(d), ["vid"], duration=10.0).collect()
    assert [(r.start, r.end, r.score, r.top_label, r.frame_count, r.time) for r in got] == [(0.5, 2.94, 0.8, "Shatter", 2, "00:00.50")]


def test_island_gap_is_inclusive(spark):
    d = frame(spark, [(0, 0.0, 1.0), (1, 1.5, 2.0), (2, 2.75, 3.0)], "frame_idx int, start double, end double").withColumn("vid", F.lit(1))
    assert [r.island for r in islands.island_ids(d, ["vid"], 0.5).orderBy("frame_idx").collect()] == [1, 1, 2]


def test_evidence_is_folded_once(spark):
    d = frame(spark, [(0, 0.0, 3.0, 0.8, "crack"), (1, 1.0, 2.0, 0.7, ""), (2, 2.0, 4.0, 0.9, "rack"), (3, 2.5, 3.0, 0.1, "fall")], "input_pos int, start double, end double, score double, evidence string").withColumn("vid", F.lit(1))
    assert [(r.start, r.end, r.score, r.evidence) for r in islands.merge_with_evidence(d, ["vid"]).collect()] == [(0.0, 4.0, 0.9, "crack；fall")]


CANDIDATE = "input_pos long, start double, end double, score double, origin string"


def fused(spark, rows, most=3):
    d = frame(spark, rows, CANDIDATE).withColumn("vid", F.lit(1))
    return [(r.start, r.end, r.origin) for r in fusion.fuse(d, ["vid"], most).orderBy("start").collect()]


def test_fusion(spark):
    assert fused(spark, [(0, 10.0, 13.0, 0.4, "audio"), (1, 9.5, 13.5, 0.9, "visual_fallback"), (2, 2.0, 5.0, 0.8, "visual_fallback")]) == [(2.0, 5.0, "visual_fallback"), (9.5, 13.5, "audio_visual")]
    assert fused(spark, [(0, 15.0, 18.0, 0.4, "audio"), (1, 3.0, 19.0, 0.9, "visual_fallback")]) == [(3.0, 19.0, "visual_fallback"), (15.0, 18.0, "audio")]
    assert fused(spark, [(0, 1.0, 2.0, 0.5, "visual_fallback"), (1, 1.0, 2.0, 0.4, "visual_fallback")]) == [(1.0, 2.0, "visual_fallback")] * 2


def test_scene_changes_have_their_own_budget(spark):
    rows = [(i, 10.0 * i, 10.0 * i + 1, 0.9 - i / 100, "visual_fallback") for i in range(4)] + [(10 + i, 100.0 + 10 * i, 101.0 + 10 * i, 0.3, "visual_change") for i in range(3)]
    got = fused(spark, rows)
    assert [o for _, _, o in got].count("visual_fallback") == 3 and [s for s, _, o in got if o == "visual_change"] == [100.0, 110.0]


def test_split_windows(spark):
    d = frame(spark, [(3.0, 19.0, 8.0), (1.0, 9.0, 2.0)], "start double, end double, focus_time double")
    got = [tuple(r) for r in selection.split_windows(d).orderBy("start").select("start", "end", "segment_index", "segment_count", "parent_start", "focus_time").collect()]
    assert got == [(1.0, 9.0, None, None, None, 2.0), (3.0, 11.0, 1, 3, 3.0, 8.0), (7.0, 15.0, 2, 3, 3.0, 4.0), (11.0, 19.0, 3, 3, 3.0, 0.0)]
    with pytest.raises(ValueError):
        selection.split_windows(d, 8.0, 8.0)


def test_scene_candidates(spark):
    hints = frame(spark, [(1, 11.785, 0.4), (1, 3.0, 0.9), (1, 30.0, 0.1)], "vid int, time double, score double")
    left = selection.uncovered_hints(hints, frame(spark, [(1, 2.0, 2.6)], "vid int, start double, end double"), ["vid"])
    got = selection.scene_intervals(left, F.lit(40.0)).collect()
    assert [(r.start, r.end, r.focus_time) for r in got] == [(11.535, 13.785, 0.25)]


def test_nms(spark):
    hints = frame(spark, [(1, i, t, s) for i, (t, s) in enumerate([(5.0, 0.9), (5.4, 0.8), (11.0, 0.7), (11.1, 0.6), (20.0, 0.3)])], "vid int, pos int, time double, score double")
    d = selection.greedy_nms(selection.scene_intervals(hints, F.lit(40.0)), ["vid"], 2, "pos")
    assert [x["start"] for x in d.first().kept] == [4.75, 10.75]


PROPOSAL = "stable_id string, candidate_id string, start double, end double, confidence double"


def clusters(spark, rows):
    d = dedupe.cluster_cores(frame(spark, rows, PROPOSAL).withColumn("vid", F.lit(1)), ["vid"])
    return {r.stable_id: (r.cluster_id, r.status) for r in d.collect()}


def test_dedupe(spark):
    got = clusters(spark, [("wide", "a", 1.0, 2.0, 0.9), ("tight", "b", 1.0, 1.8, 0.6)])
    assert got == {"tight": (0, "representative"), "wide": (0, "duplicate_suppressed")}
    got = clusters(spark, [("x", "a", 1.0, 2.0, 0.9), ("y", "a", 1.0, 2.0, 0.6)])
    assert {v[1] for v in got.values()} == {"representative"}
    chain = clusters(spark, [("a", "1", 0.0, 1.0, 0.9), ("b", "2", 0.3, 1.3, 0.9), ("c", "3", 0.6, 1.6, 0.9)])
    assert chain["a"][0] == chain["b"][0] != chain["c"][0]
    bridge = clusters(spark, [("a", "1", 0.0, 1.0, 0.9), ("c", "2", 0.6, 1.6, 0.9), ("b", "3", 0.25, 1.35, 0.9)])
    assert bridge["b"] == (None, "ambiguous_bridge_suppressed")


def test_dedupe_ignores_the_order_of_rows(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", str(rng.randrange(4)), s := round(rng.uniform(0, 6), 3), round(s + rng.uniform(0.3, 1.5), 3), round(rng.random(), 3)) for i in range(14)]
    first = clusters(spark, rows)
    for _ in range(3):
        rng.shuffle(rows)
        assert clusters(spark, rows) == first
    own = {}
    for name, cand, *_ in rows:
        if first[name][0] is not None:
            assert cand not in own.setdefault(first[name][0], set())
            own[first[name][0]].add(cand)


def test_padding(spark):
    d = frame(spark, [("a", 1.0, 2.0), ("b", 3.0, 4.0), ("c", 5.0, 6.0)], "stable_id string, start double, end double").withColumn("vid", F.lit(1))
    got = {r.stable_id: (r.clip_start, r.clip_end, r.conflicts, r.number) for r in padding.pad_cores(d, ["vid"], 10.0, 3.0).collect()}
    assert got == {"a": (0.0, 2.5, [], 1), "b": (2.5, 4.5, [], 2), "c": (4.5, 9.0, [], 3)}
    d = frame(spark, [("a", 1.0, 3.5), ("b", 3.0, 4.0), ("c", 3.8, 6.0)], "stable_id string, start double, end double").withColumn("vid", F.lit(1))
    got = {r.stable_id: (r.clip_start, r.clip_end, r.conflicts) for r in padding.pad_cores(d, ["vid"], 10.0, 3.0).collect()}
    assert got["b"] == (3.0, 4.0, ["previous_core_overlap", "next_core_overlap"])


def test_adjacent_groups_are_pairs(spark):
    d = frame(spark, [(i, float(i), i + 0.9, o) for i, o in enumerate(["audio", "visual_change", "audio", "audio", "other", "visual_fallback"])], "n int, start double, end double, origin string").withColumn("vid", F.lit(1))
    got = [r.group_id for r in padding.adjacent_groups(d, ["vid"], 0.5, "n").orderBy("n").collect()]
    assert got == [1, 1, 2, 3, 4, 5]


ANSWER = "candidate string, clip_duration double, raw string"


def local(spark, raw, duration=10.0):
    d = frame(spark, [("c", duration, raw)], ANSWER).withColumn("answer", F.try_parse_json("raw"))
    e = confirmation.first_events(confirmation.distinct_events(confirmation.local_events(d, ["candidate"]), ["candidate"]), ["candidate"])
    return [(r.event_start, r.event_end, r.confidence, r.reason) for r in e.orderBy("event_start").collect()]


def test_local_events(spark):
    many = '{"confidence": 80, "reason": "top", "events": [{"event_start": "1", "event_end": 1.4, "confidence": 0.9, "reason": "own"}, {"event_start": 1, "event_end": 1.4, "confidence": 0.95}, 5, {"event_start": 3, "event_end": 2}, {"start": -0.2, "end": 0.5}]}'
    assert local(spark, many) == [(0.0, 0.5, 0.8, "top"), (1.0, 1.4, 0.95, "top")]
    assert local(spark, '{"event_start": 2, "event_end": 10.2, "confidence": 0.7}') == [(2.0, 10.0, 0.7, "")]
    assert local(spark, '{"event_start": 2, "event_end": 3, "events": []}') == []
    assert local(spark, '{"event_start": 2, "event_end": 3, "events": "no"}') == []
    assert len(local(spark, '{"events": [' + ",".join(f'{{"event_start": {i / 4}, "event_end": {i / 4 + 0.1}}}' for i in range(20)) + "]}")) == 6


def test_matching_prefers_count_then_weight():
    assert matching.best_matching([(0, 0, 900), (0, 1, 800), (1, 0, 700)]) == [(0, 1), (1, 0)]
    rng = random.Random(5)
    for _ in range(200):
        edges = [(a, b, rng.randrange(1, 100)) for a in range(rng.randrange(1, 5)) for b in range(rng.randrange(1, 5)) if rng.random() < 0.6]
        best = (0, 0)
        for n in range(len(edges) + 1):
            for pick in itertools.combinations(edges, n):
                if len({e[0] for e in pick}) == len({e[1] for e in pick}) == n:
                    best = max(best, (n, sum(e[2] for e in pick)))
            if n > 4:
                break
        weight = {(a, b): w for a, b, w in edges}
        got = matching.best_matching(edges)
        assert (len(got), sum(weight[p] for p in got)) == best


def test_matching_of_many(spark):
    t = frame(spark, [(1, i, 10.0 * i, 10.0 * i + 5) for i in range(12)], "id int, pos int, start double, end double")
    p = frame(spark, [(1, i, 4.0 * i, 4.0 * i + 5) for i in range(30)], "id int, pos int, start double, end double")
    m = matching.match(matching.iou_edges(t, p, ["id"]), ["id"])
    assert m.count() == 12 and m.select("p_pos").distinct().count() == 12


def test_coverage_is_one_to_one(spark):
    t = frame(spark, [(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)], "id int, pos int, start double, end double")
    p = frame(spark, [(1, 0, 0.0, 5.0)], "id int, pos int, start double, end double")
    assert matching.matching_size(matching.coverage_edges(t, p, ["id"]), ["id"]).first().matches == 1


def test_metrics_of_nothing_are_null(spark):
    d = frame(spark, [], "status string, expected boolean, predicted boolean")
    r = metrics.confusion(d).first()
    assert (r.total, r.precision, r.accuracy) == (0, None, None)


def test_metrics(spark):
    d = frame(spark, [("ok", True, True), ("ok", False, True), ("ok", True, False), ("ok", False, False), ("error", True, False)], "status string, expected boolean, predicted boolean")
    r = metrics.confusion(d).first()
    assert (r.total, r.errors, r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1, r.accuracy) == (5, 1, 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)


def test_review_widens_once(spark):
    review = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("event_present", "complete", "confidence", "needs_more_before", "needs_more_after"), v, strict=True)])
    d = frame(spark, [(3.0, 4.0, 2.5, 4.5)], "clip_start double, clip_end double, min_start double, max_end double")
    got = reviews.reviewed(d.withColumn("review1", review(True, False, 0.9, False, False)).withColumn("review2", review(True, True, 0.9, False, False)), padding=10.0).first()
    assert (got.final_start, got.final_end, got.retried, got.status) == (2.5, 4.5, True, "completed")
    got = reviews.reviewed(d.withColumn("review1", review(False, False, 0.9, True, True)).withColumn("review2", review(True, True, 0.9, False, False))).first()
    assert (got.retried, got.status) == (False, "model_review_failed")
