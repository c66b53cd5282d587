"""Registered queries: frames, islands, selections, folds, dedupe, padding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clip_bounds, clock, fixed, iou, overlap_fraction, padded_bounds, range_label, same_core, source_core, tolerant_bounds, valid_interval
from ..operators import dedupe, fusion, islands, padding, selection
from ..streaming.sessions import sessions
from .stand_ins import CLOCK, DURATION, FRAMES, IOU, MODAL, PART, PROPOSALS, SAME, R, by_modality, frames, proposals, query, table


@query(f"WITH {FRAMES} SELECT vid, fid, label, score, st AS start, en AS \"end\" FROM f")
def s_frames(spark, sf):
    return frames(spark, sf)


@query(f"WITH {FRAMES} SELECT vid, fid, label, score, st AS start, en AS \"end\" FROM f WHERE score >= 0.1::DOUBLE")
def f_threshold(spark, sf):
    return islands.over_threshold(frames(spark, sf))


ISLANDS = f"""WITH {FRAMES}, k AS (SELECT * FROM f WHERE score >= 0.05::DOUBLE),
r AS (SELECT *, max(en) OVER (PARTITION BY vid ORDER BY st, fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
n AS (SELECT *, (sum(CASE WHEN reach IS NULL OR st > reach + 0.24::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY st, fid ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM r)"""


@query(ISLANDS + " SELECT vid, fid, island FROM n")
def w_islands(spark, sf):
    d = islands.over_threshold(frames(spark, sf), 0.05)
    return islands.island_ids(d, ["vid"], 0.24, "fid").select("vid", "fid", "island")


@query(ISLANDS + f""", g AS (SELECT vid, island, min(st) AS s, max(en) AS e, max(score) AS sc, max_by(label, struct_pack(a := score, b := fid)) AS top_label, count(*)::BIGINT AS frame_count FROM n GROUP BY ALL),
o AS (SELECT *, {R('greatest(0.0::DOUBLE, s - 0.5::DOUBLE)')} AS start, {R('least(120.0::DOUBLE, e + 0.5::DOUBLE)')} AS "end" FROM g)
SELECT vid, island, start, "end", {R('sc', 4)} AS score, top_label, frame_count, {CLOCK('start')} AS time FROM o""")
def a_island_agg(spark, sf):
    d = islands.over_threshold(frames(spark, sf), 0.05).withColumnRenamed("label", "top_label")
    return islands.merge_islands(d, ["vid"], 0.24, 0.5, DURATION, "fid")


@query(f"""WITH {FRAMES}, o AS (SELECT *, lag(en) OVER w AS pe FROM f WHERE score >= 0.05::DOUBLE WINDOW w AS (PARTITION BY vid ORDER BY st, fid)),
g AS (SELECT *, (sum(CASE WHEN pe IS NULL OR st > pe + 0.24::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY st, fid ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM o),
m AS (SELECT vid, island, label, {R('max(score)', 4)} AS score FROM g GROUP BY vid, island, label)
SELECT vid, island, string_agg(label || '=' || printf('%.4f', score), ';' ORDER BY label) AS label_scores FROM m GROUP BY vid, island""")
def a_island_labels(spark, sf):
    """Frames of one length begin and end in the same order, so the end before is the farthest one so far."""
    d = islands.over_threshold(frames(spark, sf), 0.05).withColumn("label_scores", F.create_map("label", "score")).withColumnRenamed("label", "top_label")
    m = F.transform(F.array_sort(F.map_entries("label_scores")), lambda e: F.format_string("%s=%.4f", e["key"], e["value"]))
    return islands.merge_islands(d, ["vid"], 0.24, 0.5, DURATION, "fid").select("vid", "island", F.array_join(m, ";").alias("label_scores"))


@query("""WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*)::BIGINT AS n FROM b GROUP BY user_id, s""")
def w_session_batch(spark, sf):
    return sessions(table(spark, sf, "events"), "6 hours")


@query(f"""WITH {FRAMES}, o AS (SELECT vid, label, max(score) AS score FROM f GROUP BY ALL) SELECT vid, label, {R('score', 4)} AS score FROM o""")
def a_label_max(spark, sf):
    return islands.label_maxima(frames(spark, sf), ["vid"]).select("vid", F.explode("label_scores").alias("label", "score"))


CLASSES = """WITH x AS (SELECT vec_id AS frame, unnest(range(len(embedding)))::INTEGER AS class, unnest(embedding) AS v FROM embeddings),
c AS (SELECT class, max(v) AS score, arg_min(frame, struct_pack(a := -v, b := frame)) AS frame FROM x GROUP BY class)"""


@query(CLASSES + " SELECT class, score, frame, frame::DOUBLE * 0.48::DOUBLE AS time FROM c")
def a_class_max(spark, sf):
    return islands.class_maxima(table(spark, sf, "embeddings"), [], "vec_id", "embedding")


@query(CLASSES + " SELECT class, score, frame, frame::DOUBLE * 0.48::DOUBLE AS time FROM c ORDER BY score DESC, class DESC LIMIT 10")
def h_top10_classes(spark, sf):
    return a_class_max(spark, sf).orderBy(F.desc("score"), F.desc("class")).limit(10)


@query("""WITH x AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding) AS v FROM embeddings)
SELECT vec_id, arg_max('class ' || pos, struct_pack(a := v, b := -pos)) AS top_label, max(v) AS score FROM x GROUP BY vec_id""")
def a_frame_argmax(spark, sf):
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("label_pos", "score"))
    return islands.frame_argmax(long.withColumn("label", F.concat(F.lit("class "), F.col("label_pos").cast("string"))), ["vec_id"])


PAIRS = f"""WITH {FRAMES}, {PROPOSALS}, q AS (SELECT vid, fid, st AS s1, en AS e1, lead(st) OVER w AS s2, lead(en) OVER w AS e2 FROM p WINDOW w AS (PARTITION BY vid ORDER BY st, fid))"""


def _pairs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("vid").orderBy("start", "stable_id")
    d = proposals(spark, sf).withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w)).where("s2 IS NOT NULL")
    return d, (F.col("start"), F.col("end"), F.col("s2"), F.col("e2"))


@query(PAIRS + f" SELECT vid, fid, {IOU('s1', 'e1', 's2', 'e2')} AS iou FROM q WHERE s2 IS NOT NULL")
def p_iou_pairs(spark, sf):
    d, b = _pairs(spark, sf)
    return d.select("vid", F.col("stable_id").alias("fid"), iou(*b).alias("iou"))


@query(PAIRS + f" SELECT vid, fid, {PART('s1', 'e1', 's2', 'e2')} AS overlap FROM q WHERE s2 IS NOT NULL")
def p_overlap_pairs(spark, sf):
    d, b = _pairs(spark, sf)
    return d.select("vid", F.col("stable_id").alias("fid"), overlap_fraction(*b).alias("overlap"))


@query(PAIRS + f" SELECT vid, fid, {SAME('s1', 'e1', 's2', 'e2')} AS same FROM q WHERE s2 IS NOT NULL")
def p_same_core(spark, sf):
    d, b = _pairs(spark, sf)
    return d.select("vid", F.col("stable_id").alias("fid"), same_core(*b).alias("same"))


LOCAL = f"""WITH {FRAMES}, {PROPOSALS}, q AS (SELECT vid, fid, st AS cs, {R('st + 2.25::DOUBLE')} AS ce, (fid % 11)::DOUBLE * 0.25::DOUBLE - 0.5::DOUBLE AS ls, (fid % 13)::DOUBLE * 0.25::DOUBLE AS le, conf FROM p)"""


def _local(spark, sf):
    d = proposals(spark, sf).select("vid", F.col("stable_id").alias("fid"), F.col("start").alias("cs"), fixed(F.col("start") + 2.25).alias("ce"), "confidence")
    d = d.withColumn("ls", (F.col("fid") % 11).cast("double") * 0.25 - 0.5).withColumn("le", (F.col("fid") % 13).cast("double") * 0.25)
    return d, (F.col("cs"), F.col("ce"), F.col("ls"), F.col("le"), F.lit(DURATION))


CORE = f"""{LOCAL}, k AS (SELECT *, ls >= 0 AND le <= ce - cs AND le > ls AS fits, {R('greatest(0.0::DOUBLE, least(120.0::DOUBLE, cs + ls))')} AS s, {R('greatest(0.0::DOUBLE, least(120.0::DOUBLE, cs + le))')} AS e FROM q)"""


@query(CORE + """ SELECT vid, fid, s AS start, e AS "end" FROM k WHERE fits AND e > s""")
def p_source_core(spark, sf):
    d, b = _local(spark, sf)
    return d.withColumn("core", source_core(*b)).where("core IS NOT NULL").select("vid", "fid", "core.*")


def _tolerant_sql(last: str) -> str:
    inside = lambda x: f"greatest(0.0::DOUBLE, least(ce - cs, {x}))"
    at = lambda x: R(f"greatest(0.0::DOUBLE, least(120.0::DOUBLE, cs + {inside(x)}))")
    return LOCAL + f""", a AS (SELECT *, {at('ls')} AS s, {at('le')} AS e FROM q), b AS (SELECT *, ls >= -0.25::DOUBLE AND le <= ce - cs + 0.25::DOUBLE AND le > ls AND e > s AS refined FROM a),
c AS (SELECT vid, fid, CASE WHEN refined THEN s ELSE cs END AS start, CASE WHEN refined THEN e ELSE ce END AS "end", refined FROM b) {last}"""


@query(_tolerant_sql('SELECT vid, fid, start, "end", refined FROM c'))
def p_tolerant_bounds(spark, sf):
    d, b = _local(spark, sf)
    return d.select("vid", "fid", tolerant_bounds(*b).alias("b")).select("vid", "fid", "b.*")


@query(_tolerant_sql(f"""SELECT vid, fid, {R('greatest(0.0::DOUBLE, start - 1.0::DOUBLE)')} AS start, {R('least(120.0::DOUBLE, "end" + 1.0::DOUBLE)')} AS "end" FROM c WHERE refined"""))
def p_padded_bounds(spark, sf):
    d, b = _local(spark, sf)
    d = d.withColumn("b", tolerant_bounds(*b)).where("b.refined")
    return d.select("vid", "fid", padded_bounds(F.col("b"), F.lit(1.0), F.lit(DURATION)).alias("p")).select("vid", "fid", "p.*")


@query(CORE + """ SELECT vid, fid, CASE WHEN conf < 0.55::DOUBLE THEN 'low_confidence' WHEN NOT (fits AND e > s) THEN 'invalid_event_core' ELSE 'accepted' END AS status FROM k""")
def f_reject_split(spark, sf):
    from ..operators.confirmation import proposals as classify

    d, _ = _local(spark, sf)
    d = d.withColumnsRenamed({"cs": "cand_start", "ce": "cand_end", "ls": "event_start", "le": "event_end"})
    return classify(d, F.lit(DURATION)).select("vid", "fid", "status")


@query(f"""WITH {FRAMES}, {MODAL}, r AS (SELECT vid, fid, origin, cls, row_number() OVER (PARTITION BY vid, cls ORDER BY score DESC, fid) AS rank FROM m)
SELECT vid, fid, origin, rank::INTEGER AS rank FROM r WHERE rank <= CASE cls WHEN 2 THEN 2 ELSE 3 END""")
def h_topk_budgets(spark, sf):
    return selection.budgets(by_modality(spark, sf), ["vid"]).select("vid", "fid", "origin", "rank")


@query(f"""WITH {FRAMES}, {MODAL} SELECT vid, fid, origin, score, CASE WHEN cls = 0 THEN score END AS audio_score, CASE WHEN cls > 0 THEN score END AS visual_score FROM m""")
def u_union_modalities(spark, sf):
    d = by_modality(spark, sf).select("vid", "fid", "origin", "score")
    a = d.where("origin = 'audio'").withColumn("audio_score", F.col("score"))
    return a.unionByName(d.where("origin <> 'audio'").withColumn("visual_score", F.col("score")), allowMissingColumns=True)


UNCOVERED = f"""WITH {FRAMES}, {MODAL}, u AS (SELECT vid, fid, score, st FROM m h WHERE cls = 2 AND NOT EXISTS (SELECT 1 FROM m c WHERE c.cls < 2 AND c.vid = h.vid AND h.st BETWEEN c.st - 0.5::DOUBLE AND c.en + 0.5::DOUBLE))"""


def _uncovered(spark, sf):
    m = by_modality(spark, sf)
    hints = m.where("origin = 'visual_change'").select("vid", "fid", "score", F.col("start").alias("time"))
    return selection.uncovered_hints(hints, m.where("origin <> 'visual_change'"), ["vid"])


@query(UNCOVERED + " SELECT vid, fid, score, st AS time FROM u")
def j_uncovered_scene(spark, sf):
    return _uncovered(spark, sf)


SCENE = f"""{UNCOVERED}, b AS (SELECT vid, fid, score, greatest(0.0::DOUBLE, st - 0.25::DOUBLE) AS s0, least(120.0::DOUBLE, st + 2.0::DOUBLE) AS e0, st FROM u WHERE score >= 0.2::DOUBLE AND st BETWEEN 0 AND 120),
i AS (SELECT vid, fid, {R('least(1.0::DOUBLE, score)', 4)} AS score, {R('s0')} AS s, {R('e0')} AS e, {R('st - s0')} AS focus FROM b WHERE e0 > s0)"""


@query(SCENE + f""", l AS (SELECT vid, list([struct_pack(o := -score, pos := fid, score := score, s := s, e := e)] ORDER BY -score, fid) AS items FROM i GROUP BY vid),
k AS (SELECT vid, list_reduce(items, lambda acc, x: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda a: {IOU('a.s', 'a.e', 'x[1].s', 'x[1].e')} >= 0.5::DOUBLE OR {PART('a.s', 'a.e', 'x[1].s', 'x[1].e')} >= 0.8::DOUBLE)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l),
z AS (SELECT vid, unnest(kept) AS x FROM k) SELECT vid, x.pos AS fid, x.score AS score, x.s AS start, x.e AS "end" FROM z""")
def l_scene_nms(spark, sf):
    d = selection.scene_intervals(_uncovered(spark, sf), F.lit(DURATION))
    d = selection.greedy_nms(d, ["vid"], 3, "fid")
    return d.select("vid", F.explode("kept").alias("x")).select("vid", F.col("x.pos").alias("fid"), "x.score", "x.start", "x.end")


@query(f"""WITH {FRAMES}, {MODAL}, r AS (SELECT *, row_number() OVER (PARTITION BY vid, cls ORDER BY score DESC, fid) AS rank FROM m),
p AS (SELECT * FROM r WHERE rank <= CASE cls WHEN 2 THEN 2 ELSE 20 END),
i AS (SELECT vid, list(struct_pack(s := st, e := en, score := score, origin := origin, a := NULL::DOUBLE, v := NULL::DOUBLE, pos := fid) ORDER BY -score, fid) FILTER (cls = 0) AS seeds,
  list([struct_pack(s := st, e := en, score := score, origin := origin, a := NULL::DOUBLE, v := NULL::DOUBLE, pos := fid)] ORDER BY cls, -score, fid) FILTER (cls > 0) AS later FROM p GROUP BY vid),
w AS (SELECT vid, list_reduce(list_concat([coalesce(seeds, [])], coalesce(later, [])), lambda acc, x:
  CASE WHEN coalesce(list_max(list_transform(acc, lambda k: CASE WHEN k.origin IN ('audio', 'audio_visual') THEN {IOU('k.s', 'k.e', 'x[1].s', 'x[1].e')} ELSE -1.0::DOUBLE END)), -1.0::DOUBLE) >= 0.5::DOUBLE
  THEN list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda k: CASE WHEN k.origin IN ('audio', 'audio_visual') THEN {IOU('k.s', 'k.e', 'x[1].s', 'x[1].e')} ELSE -1.0::DOUBLE END),
      list_max(list_transform(acc, lambda k: CASE WHEN k.origin IN ('audio', 'audio_visual') THEN {IOU('k.s', 'k.e', 'x[1].s', 'x[1].e')} ELSE -1.0::DOUBLE END)))
    THEN struct_pack(s := {R('least(k.s, x[1].s)')}, e := {R('greatest(k.e, x[1].e)')}, score := greatest(k.score, x[1].score), origin := 'audio_visual', a := coalesce(k.a, k.score), v := x[1].score, pos := k.pos) ELSE k END)
  ELSE list_concat(acc, x) END) AS fused FROM i),
z AS (SELECT vid, unnest(fused) AS x FROM w)
SELECT vid, x.pos AS pos, x.s AS start, x.e AS "end", x.score AS score, x.origin AS origin, x.a AS audio_score, x.v AS visual_score FROM z""")
def l_fuse(spark, sf):
    d = fusion.fuse(by_modality(spark, sf), ["vid"], most=20, pos="input_pos")
    return d.select("vid", "pos", "start", "end", "score", "origin", "audio_score", "visual_score")


@query(f"""WITH {FRAMES}, q AS (SELECT vid, fid, st AS s, {R('st + 0.5::DOUBLE + (fid % 40)::DOUBLE * 0.5::DOUBLE')} AS e, (fid % 5)::DOUBLE * 0.5::DOUBLE AS focus FROM f),
n AS (SELECT *, CASE WHEN e - s <= 8.0::DOUBLE THEN 1 ELSE ceil((e - s - 1.0::DOUBLE) / 7.0::DOUBLE)::INTEGER END AS n FROM q),
u AS (SELECT *, unnest(range(n))::INTEGER AS i FROM n),
r AS (SELECT *, CASE WHEN i = n - 1 THEN e - 8.0::DOUBLE ELSE s + ((e - s - 8.0::DOUBLE) / nullif(n - 1, 0)::DOUBLE) * i END AS raw FROM u),
o AS (SELECT *, CASE WHEN n = 1 THEN s ELSE {R('raw')} END AS a, CASE WHEN n = 1 THEN e WHEN i = n - 1 THEN {R('e')} ELSE {R('raw + 8.0::DOUBLE')} END AS b FROM r)
SELECT vid, fid, a AS start, b AS "end", CASE WHEN n > 1 THEN {R('s')} END AS parent_start, CASE WHEN n > 1 THEN {R('e')} END AS parent_end, CASE WHEN n > 1 THEN i + 1 END AS segment_index, CASE WHEN n > 1 THEN n END AS segment_count,
  CASE WHEN n = 1 THEN focus ELSE {R('greatest(0.0::DOUBLE, least(8.0::DOUBLE, s + focus - a))')} END AS focus_time FROM o""")
def l_split_windows(spark, sf):
    d = frames(spark, sf).select("vid", "fid", "start", fixed(F.col("start") + 0.5 + (F.col("fid") % 40).cast("double") * 0.5).alias("end"), ((F.col("fid") % 5).cast("double") * 0.5).alias("focus_time"))
    return selection.split_windows(d)


@query(f"""WITH {FRAMES}, k AS (SELECT *, label || ' ' || (fid % 3) AS evidence FROM f),
r AS (SELECT *, max(en) OVER (PARTITION BY vid ORDER BY st, fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
n AS (SELECT *, (sum(CASE WHEN reach IS NULL OR st > reach THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY st, fid ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM r),
g AS (SELECT vid, island, min(st) AS start, max(en) AS "end", max(score) AS score, list_concat([''], list(evidence ORDER BY st, fid)) AS texts FROM n GROUP BY ALL)
SELECT vid, island, start, "end", score, list_reduce(texts, lambda acc, x: CASE WHEN x = '' OR contains(acc, x) THEN acc WHEN acc = '' THEN x ELSE acc || '；' || x END) AS evidence FROM g""")
def l_evidence(spark, sf):
    d = frames(spark, sf).withColumn("evidence", F.concat("label", F.lit(" "), (F.col("fid") % 3).cast("string"))).withColumnRenamed("fid", "input_pos")
    return islands.merge_with_evidence(d, ["vid"])


DEDUPE = f"""WITH {FRAMES}, {PROPOSALS}, l AS (SELECT vid, list_concat([[]::STRUCT(s DOUBLE, e DOUBLE, id BIGINT, cand VARCHAR, cid INTEGER)[]], list([struct_pack(s := st, e := en, id := fid, cand := cand, cid := 0::INTEGER)] ORDER BY en - st, -conf, st, en, fid)) AS items FROM p GROUP BY vid),
k AS (SELECT vid, list_reduce(items, lambda acc, x: list_concat(acc, list_transform([list_filter(list_distinct(list_transform(list_filter(acc, lambda m: m.cid <> -1), lambda m: m.cid)),
   lambda c: NOT list_contains(list_transform(list_filter(acc, lambda m: m.cid <> -1 AND (m.cand = x[1].cand OR NOT {SAME('m.s', 'm.e', 'x[1].s', 'x[1].e')})), lambda m: m.cid), c))],
   lambda o: struct_pack(s := x[1].s, e := x[1].e, id := x[1].id, cand := x[1].cand, cid := CASE WHEN len(o) = 1 THEN o[1] WHEN len(o) > 1 THEN -1 ELSE len(list_distinct(list_transform(list_filter(acc, lambda m: m.cid <> -1), lambda m: m.cid)))::INTEGER END)))) AS done FROM l),
u AS (SELECT vid, unnest(done) AS x, unnest(range(len(done))) AS pos FROM k),
d AS (SELECT vid, x.id AS stable_id, x.cand AS candidate_id, x.s AS start, x.e AS "end", nullif(x.cid, -1) AS cluster_id, pos FROM u),
z AS (SELECT *, CASE WHEN cluster_id IS NULL THEN 'ambiguous_bridge_suppressed' WHEN pos = min(pos) OVER (PARTITION BY vid, cluster_id) THEN 'representative' ELSE 'duplicate_suppressed' END AS status FROM d)"""


@query(DEDUPE + ' SELECT vid, stable_id, candidate_id, start, "end", cluster_id, status FROM z')
def l_dedupe_decisions(spark, sf):
    return dedupe.cluster_cores(proposals(spark, sf), ["vid"]).drop("confidence")


@query(DEDUPE + """ SELECT vid, cluster_id, count(*)::BIGINT AS members, max(CASE WHEN status = 'representative' THEN stable_id END) AS representative FROM z WHERE cluster_id IS NOT NULL GROUP BY vid, cluster_id""")
def l_dedupe_clusters(spark, sf):
    d = dedupe.cluster_cores(proposals(spark, sf), ["vid"]).where("cluster_id IS NOT NULL")
    return d.groupBy("vid", "cluster_id").agg(F.count(F.lit(1)).alias("members"), F.max(F.when(F.col("status") == "representative", F.col("stable_id"))).alias("representative"))


PADDING = f"""WITH {FRAMES}, {PROPOSALS}, q AS (SELECT *, row_number() OVER w AS number, lag(en) OVER w AS pe, lead(st) OVER w AS ns FROM p WINDOW w AS (PARTITION BY vid ORDER BY st, en, fid)),
b AS (SELECT *, coalesce(pe > st, false) AS xb, coalesce(ns < en, false) AS xa, CASE WHEN pe IS NULL THEN 0.0::DOUBLE WHEN pe > st THEN st ELSE (pe + st) / 2.0::DOUBLE END AS lo,
  CASE WHEN ns IS NULL THEN 120.0::DOUBLE WHEN ns < en THEN en ELSE (en + ns) / 2.0::DOUBLE END AS hi FROM q)"""


@query(PADDING + f""" SELECT vid, fid AS stable_id, number::INTEGER AS number, {R('greatest(lo, st - 1.0::DOUBLE)')} AS clip_start, {R('least(hi, en + 1.0::DOUBLE)')} AS clip_end, {R('lo')} AS min_start, {R('hi')} AS max_end,
  concat_ws(',', CASE WHEN xb THEN 'previous_core_overlap' END, CASE WHEN xa THEN 'next_core_overlap' END) AS conflicts FROM b""")
def w_padding(spark, sf):
    d = padding.pad_cores(proposals(spark, sf), ["vid"], DURATION)
    return d.select("vid", "stable_id", "number", "clip_start", "clip_end", "min_start", "max_end", F.array_join("conflicts", ",").alias("conflicts"))


CLIPS = f"""WITH {FRAMES}, {MODAL}, q AS (SELECT vid, fid, origin, st, en, st - lag(en) OVER w AS gap, lag(origin) OVER w AS po FROM m WINDOW w AS (PARTITION BY vid ORDER BY st, en, fid)),
b AS (SELECT *, coalesce(gap >= 0 AND gap <= 0.5::DOUBLE AND (origin = 'audio') <> (po = 'audio'), false) AS fits FROM q),
c AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY vid ORDER BY st, en, fid ROWS UNBOUNDED PRECEDING) AS run FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY vid, run ORDER BY st, en, fid) - 1 AS idx FROM c),
g AS (SELECT *, (sum(CASE WHEN idx % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY st, en, fid ROWS UNBOUNDED PRECEDING))::BIGINT AS group_id FROM d)"""


@query(CLIPS + " SELECT vid, fid, group_id FROM g")
def w_adjacent_groups(spark, sf):
    return padding.adjacent_groups(by_modality(spark, sf), ["vid"], 0.5, "fid").select("vid", "fid", "group_id")


@query(CLIPS + """, k AS (SELECT *, count(*) OVER (PARTITION BY vid, group_id) = 2 AND group_id % 2 = 0 AS merged FROM g),
z AS (SELECT *, CASE WHEN merged THEN 0 ELSE fid END AS part FROM k)
SELECT vid, group_id, min(st) AS start, max(en) AS "end", bool_or(merged) AS merged, count(*)::BIGINT AS members FROM z GROUP BY vid, group_id, part""")
def l_consolidate(spark, sf):
    groups = padding.adjacent_groups(by_modality(spark, sf), ["vid"], 0.5, "fid")
    decisions = groups.select("vid", "group_id").distinct().select("vid", "group_id", (F.col("group_id") % 2 == 0).alias("same"), F.lit(1).alias("count"), F.lit(0.9).alias("confidence"))
    return padding.consolidate(groups.select("vid", "group_id", "start", "end"), ["vid"], decisions)


@query(f"WITH {FRAMES}, {MODAL} SELECT vid, fid, CASE origin WHEN 'audio' THEN 'audio' ELSE 'visual' END AS modalities FROM m")
def p_modalities(spark, sf):
    return by_modality(spark, sf).select("vid", "fid", F.array_join(padding.modalities(F.col("origin")), ",").alias("modalities"))


@query(f"""WITH {FRAMES}, q AS (SELECT vid, fid, CASE WHEN fid % 3 = 0 THEN 'error' ELSE 'completed' END AS status, st - 1.0::DOUBLE AS s, st + (fid % 4)::DOUBLE - 1.0::DOUBLE AS e FROM f)
SELECT vid, fid, s AS start, e AS "end" FROM q WHERE status = 'completed' AND s >= 0 AND e > s""")
def p_clip_bounds(spark, sf):
    status = F.when(F.col("fid") % 3 == 0, "error").otherwise("completed")
    d = frames(spark, sf).select("vid", "fid", clip_bounds(status, F.col("start") - 1.0, F.col("start") + (F.col("fid") % 4).cast("double") - 1.0).alias("b"))
    return d.where("b IS NOT NULL").select("vid", "fid", "b.*")


@query(f"""WITH {FRAMES} SELECT vid, fid, st - 1.0::DOUBLE >= 0 AND st + (fid % 4)::DOUBLE - 1.0::DOUBLE > st - 1.0::DOUBLE AS valid FROM f""")
def p_interval_check(spark, sf):
    return frames(spark, sf).select("vid", "fid", valid_interval(F.col("start") - 1.0, F.col("start") + (F.col("fid") % 4).cast("double") - 1.0).alias("valid"))


@query(f"WITH {FRAMES} SELECT vid, fid, {CLOCK('st * 10.0::DOUBLE')} AS time FROM f")
def p_format_time(spark, sf):
    return frames(spark, sf).select("vid", "fid", clock(F.col("start") * 10.0).alias("time"))


@query(f"WITH {FRAMES} SELECT vid, fid, printf('%.2f-%.2f', {R('st', 2)}, {R('en', 2)}) AS label FROM f")
def p_range_label(spark, sf):
    return frames(spark, sf).select("vid", "fid", range_label(F.col("start"), F.col("end")).alias("label"))


@query(f"WITH {FRAMES} SELECT vid, fid, {R('st / 120.0::DOUBLE * 100.0::DOUBLE')} AS left_percent, {R('greatest(en - st, 0.2::DOUBLE) / 120.0::DOUBLE * 100.0::DOUBLE')} AS width_percent FROM f")
def p_timeline(spark, sf):
    d = frames(spark, sf)
    width = F.greatest(F.col("end") - F.col("start"), F.lit(0.2))
    return d.select("vid", "fid", fixed(F.col("start") / DURATION * 100.0).alias("left_percent"), fixed(width / DURATION * 100.0).alias("width_percent"))


@query(f"""WITH {FRAMES}, b AS (SELECT *, floor(st / 2.0::DOUBLE)::BIGINT AS bucket FROM f) SELECT vid, bucket, min(st) AS time FROM b GROUP BY ALL""")
def s_sparse_sample(spark, sf):
    d = frames(spark, sf).withColumnRenamed("start", "time")
    return selection.sample_sparsely(d, ["vid"]).select("vid", "bucket", "time")


@query(f"""WITH {FRAMES} SELECT vid, floor(st)::BIGINT AS second, {R('avg(score * -60.0::DOUBLE)', 1)} AS mean_db, count(*)::BIGINT AS n FROM f GROUP BY ALL""")
def a_mean_per_second(spark, sf):
    # Added up in the table's order, as SQL on one thread does: a sum in another order can put a tie on its other side.
    at = ["_metadata.file_path", "_metadata.row_index"]
    d = frames(spark, sf).select("vid", F.floor("start").alias("second"), (F.col("score") * -60.0).alias("db"), *at)
    w = Window.partitionBy("vid", "second").orderBy("file_path", "row_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("vid", "second", fixed(F.avg("db").over(so_far), 1).alias("mean_db"), F.count(F.lit(1)).over(so_far).alias("n"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    return d.where("_last").drop("_last")
