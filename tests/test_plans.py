import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronolith.operators import runs
from chronolith.plans import evaluation, stand_ins
from chronolith.sources import adapters, readers, sinks
from chronolith.streaming.sessions import event_stream, sessions, write_sessions

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cells(rows, columns):
    def one(x):
        return round(x, 9) if isinstance(x, float) else x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(stand_ins.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    d = stand_ins.QUERIES[name](spark, DATA)
    c = duck.execute(stand_ins.ORACLE_SQL[name])
    columns = [x[0] for x in c.description]
    assert sorted(columns) == sorted(d.columns)
    assert cells([tuple(r) for r in d.collect()], d.columns) == cells(c.fetchall(), columns)


def duck_over(d):
    """DuckDB over a folder's tables, read in their order (one thread)."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}{'/*.parquet' if os.path.isdir(f'{d}/{t}') else ''}'")
    return con


def write_table(d, name, sql):
    """A table of DuckDB's SQL in a folder, in one file."""
    duckdb.connect().execute(f"COPY ({sql}) TO '{d}/{name}.parquet'")


def test_end_to_end_keeps_scores_above_one(spark, tmp_path):
    frames = [(0, 0.2, 7, "error", 520.0), (1, 9.4, 7, "error", 530.0), (2, 30.0, 7, "view", 700.0), (3, 31.0, 8, "click", 300.0), (4, 50.0, 8, "view", 100.0), (5, 70.0, 8, "error", 50000.0)]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_microseconds({int(t * 21.6e9)}), {vid}, '{kind}', {value}::DOUBLE, '{{}}')" for i, t, vid, kind, value in frames)
    write_table(tmp_path, "events", f"SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)")
    d = stand_ins.QUERIES["e2e_pipeline"](spark, str(tmp_path))
    c = duck_over(tmp_path).execute(stand_ins.ORACLE_SQL["e2e_pipeline"])
    columns = [x[0] for x in c.description]
    assert cells([tuple(r) for r in d.collect()], d.columns) == cells(want := c.fetchall(), columns)
    assert sorted(r[columns.index("confidence")] for r in want) == [0.6, 1.04, 1.06, 1.4, 100.0]


def test_mean_per_second_adds_up_in_the_tables_order(spark, tmp_path):
    values = [(196.5, 473.2, 114.05), (304.2, 102.55, 12.0), (276.25, 299.3, 465.7), (72.25, 255.8, 428.2), (82.1, 124.35, 182.3), (437.0, 142.4, 49.35)]
    (tmp_path / "events.parquet").mkdir()
    for part, which in (("b", (1, 2)), ("a", (0,))):
        rows = ", ".join(f"({10 - i}, TIMESTAMP '2024-01-01', {vid}, 'click', {v[i]}::DOUBLE, '{{}}')" for vid, v in enumerate(values) for i in which)
        write_table(tmp_path / "events.parquet", part, f"SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = stand_ins.QUERIES["a_mean_per_second"](spark, str(tmp_path)).select("vid", "second", "mean_db", "n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert sorted(map(tuple, got)) == sorted(duck_over(tmp_path).execute(stand_ins.ORACLE_SQL["a_mean_per_second"]).fetchall())


def test_pages_are_cleaned_of_the_sqls_entities_only(spark, tmp_path):
    pages = ["token = &quot<p>x</p>", "&quot;&#39;&lt;&amp;lt;&ampgt; &copy; &copy=1 &middot", "caf&eacute; &#233; &AMP;", "&am<b>p;", "a<\nb>c<>d<", "\xa0\t a \x0b\x0c\r\n", "\x1c\x85\u2003a\u2003\x1f", " \u0301a\u0301 ", "a\x01b", "&nbsp;&nbsp;a&nbsp;", "", "<p></p>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = stand_ins.QUERIES["p_clean_html"](spark, str(tmp_path)).collect()
    want = duck_over(tmp_path).execute(stand_ins.ORACLE_SQL["p_clean_html"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and dict(want)[0] == "token = &quotx"


def best_matchings(edges):
    """All matchings of (true event, prediction, weight, errors) rows with most pairs and, among those, most weight."""
    found = [[]]
    for t in {e[0] for e in edges}:
        found += [[*m, e] for m in found for e in edges if e[0] == t and all(e[1] != x[1] for x in m)]
    value = lambda m: (len(m), sum(e[2] for e in m))
    return [m for m in found if value(m) == max(map(value, found))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_mean_errors_are_of_all_matched_pairs(spark, duck):
    groups = {}
    for vid, grp, t, p, t_start, t_end, p_start, p_end, iou in duck.execute("SELECT vid, grp, t_pos, p_pos, t_start, t_end, p_start, p_end, iou FROM (" + stand_ins.ORACLE_SQL["j_match_edges"] + ")").fetchall():
        groups.setdefault((vid, grp), []).append((t, p, round(iou * 1e9), (iou, abs(p_start - t_start), abs(p_end - t_end)), p_start - 0.5 <= t_start and p_end + 0.5 >= t_end))
    best = [best_matchings(g) for g in groups.values()]
    assert max(map(len, groups.values())) > 1 and all(len(b) == 1 for b in best)
    pairs = [e[3] for b in best for e in b[0]]
    got = stand_ins.QUERIES["a_mean_errors"](spark, DATA).first()
    covered = sum(e[4] for b in best for e in b[0])
    assert got.n == len(pairs) and stand_ins.QUERIES["a_coverage_rates"](spark, DATA).first().complete_coverage_rate_on_matched == pytest.approx(covered / len(pairs), abs=1e-4)
    assert (got.mean_iou, got.mean_start_error, got.mean_end_error) == pytest.approx(tuple(sum(x) / len(pairs) for x in zip(*pairs, strict=True)), abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_evidence_is_of_all_frames(spark):
    want, reach = [], {}
    for f in sorted(stand_ins.frames(spark, DATA).collect(), key=lambda f: (f.vid, f.start, f.fid)):
        if f.vid not in reach or f.start > reach[f.vid]:
            want.append([f.vid, f.start, f.end, f.score, ""])
        x, text = want[-1], f"{f.label} {f.fid % 3}"
        x[2:4] = max(x[2], f.end), max(x[3], f.score)
        x[4] = x[4] if text in x[4] else "；".join(filter(None, [x[4], text]))
        reach[f.vid] = max(reach.get(f.vid, 0.0), f.end)
    got = stand_ins.QUERIES["l_evidence"](spark, DATA).select("vid", "start", "end", "score", "evidence").collect()
    assert sorted(map(list, got)) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_manifest_selection_is_of_all_sources(spark, duck):
    sources = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    got = [r.pos for r in stand_ins.QUERIES["f_manifest_select"](spark, DATA).collect()]
    assert len(got) == 25 and not {sources[i] for i in got} <= {"src1", "src2", "src3"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sessions_on_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i + (40 if i > 20 else 0))) for i in range(40)]
    late = [(9, dt.datetime(2024, 2, 1))]  # moves the watermark past everything else
    a = spark.createDataFrame(rows, "user_id long, ts timestamp")
    a.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, "user_id long, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    s = event_stream(spark, str(tmp_path / "in"), a, 1)
    for _ in range(2):
        write_sessions(s, "30 minutes", "1 day", str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("user_id <> 9").collect()}
    assert got == {tuple(r) for r in sessions(a, "30 minutes").collect()}


def test_manifest(spark, tmp_path):
    m = {"version": 1, "root": "/m", "default_event": "glass", "samples": [{"id": "a", "path": "a.mp4", "expected": True, "events": [{"start": 1, "end": 2}]}, {"id": "b", "path": "/b.mp4", "expected": False, "event": "door", "split": "test"}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    d = readers.manifest(spark, str(tmp_path / "m.json"))
    assert [(r.id, r.path, r.event) for r in d.orderBy("pos").collect()] == [("a", "/m/a.mp4", "glass"), ("b", "/b.mp4", "door")]
    assert readers.manifest_problems(d).count() == 0 and readers.checked(d).count() == 2
    assert [r.id for r in readers.selected(d, split="test").collect()] == ["b"]
    with pytest.raises(Exception, match="repeated id"):
        readers.checked(d.unionByName(d)).collect()
    m["version"] = 2
    (tmp_path / "n.json").write_text(json.dumps(m))
    with pytest.raises(Exception, match="version 1"):
        readers.manifest(spark, str(tmp_path / "n.json")).collect()


def test_configuration_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("index,mid,display_name\n0,/m/1,Glass\n1,/m/2,\"Chink, clink\"\n")
    assert [tuple(r) for r in readers.class_map(spark, str(tmp_path / "c.csv")).collect()] == [(0, "Glass"), (1, "Chink, clink")]
    (tmp_path / "e.json").write_text(json.dumps({"events": [{"name": "x", "aliases": ["y"], "yamnet_labels": ["Glass"]}, {"name": "z", "detector_labels": ["Tap"]}]}))
    assert [r.detector_labels for r in readers.event_config(spark, str(tmp_path / "e.json")).collect()] == [["Glass"], ["Tap"]]
    (tmp_path / "k.json").write_text(json.dumps({"version": 1, "items": [{"id": "i", "expected": True}]}))
    assert readers.catalog(spark, str(tmp_path / "k.json")).first().id == "i"


def test_scene_log(spark):
    text = "frame pts_time:1.25\nlavfi.scene_score=0.3\nframe pts_time:2.5\nlavfi.scene_score=0.8\nlavfi.scene_score=x\nframe pts_time:3.75\nlavfi.scene_score=0.5"
    d = readers.scene_hints(spark.createDataFrame([(1, text), (2, "lavfi.scene_score=0.9")], "vid int, value string"), ["vid"], most=2)
    assert [(r.time, r.score) for r in d.orderBy("time").collect()] == [(2.5, 0.8), (3.75, 0.5)]


def test_adapters_retry_and_keep_errors(spark):
    calls, waits = [], []

    def flaky(row):
        calls.append(row)
        if len(calls) < 2:
            raise adapters.RetryableError("busy", after=3.0)
        return {"ok": True}

    assert adapters.with_retries(flaky, {}, 2, sleep=waits.append) == ({"ok": True}, 2) and 3.0 <= waits[0] <= 3.25
    with pytest.raises(ValueError):
        adapters.with_retries(lambda row: (_ for _ in ()).throw(ValueError("no")), {}, 3)
    d = adapters.answered(spark.createDataFrame([(0.0, 4.0, 0.9), (0.0, None, 0.9)], "start double, end double, score double"), adapters.StubModel)
    good, bad = d.orderBy(F.col("end").isNull()).collect()
    assert json.loads(good.answer)["events"][0]["event_start"] == 1.0 and good.error is None
    assert bad.answer is None or bad.error is None


def test_cache_entries(spark, tmp_path):
    path = str(tmp_path / "cache")
    entries = lambda v: spark.createDataFrame([("k", v)], "key string, payload string")
    sinks.append_entries(entries("old"), path)
    sinks.append_entries(entries("new"), path)
    assert sinks.latest_entries(spark, path, "key").first().payload == "new"
    one, other = spark.range(1).select(runs.identity(a=F.lit(1), b=F.lit(None)), runs.identity(a=F.lit(1), b=F.lit(""))).first()
    assert one != other


def test_evaluation(spark):
    report = "id string, status string, visual_error string, results array<struct<status:string,start:double,end:double,clip_start:double,clip_end:double>>"
    reports = spark.createDataFrame([("a", "completed", None, [("completed", 1.0, 2.0, 0.0, 3.0)]), ("b", "no_candidate", None, []), ("c", "completed", None, [("error", None, None, None, None)])], report)
    samples = spark.createDataFrame([("a", True, [(1.0, 2.2)]), ("b", False, []), ("c", True, [(1.0, 2.0)])], "id string, expected boolean, events array<struct<start:double,end:double>>")
    classes, temporal, strict = (d.first() for d in evaluation.score(evaluation.results_of(reports, samples)))
    assert (classes.total, classes.errors, classes.tp, classes.tn, classes.accuracy) == (3, 1, 1, 1, 1.0)
    assert (temporal.n_truth, temporal.tp, temporal.complete_coverage_recall, temporal.mean_iou, strict.tp) == (1, 1, 1.0, 0.8333, 1)


def test_resume(spark):
    s = spark.createDataFrame([("a",), ("b",)], "id string")
    done = spark.createDataFrame([("a", "ok"), ("b", "error")], "id string, status string")
    settings = spark.createDataFrame([("version", "4")], "key string, value string")
    assert [r.id for r in evaluation.resume(s, done, settings, settings).collect()] == ["b"]
    with pytest.raises(Exception, match="version"):
        evaluation.resume(s, done, settings, settings.withColumn("value", F.lit("5"))).collect()


def test_resume_with_media(spark):
    s = spark.createDataFrame([("a",), ("b",)], "id string")
    done = spark.createDataFrame([("a", "ok")], "id string, status string")
    media = lambda digest: spark.createDataFrame([("a", "p", digest)], "id string, path string, sha256 string")
    settings = lambda stage, **more: runs.run_settings(spark, stage, {"sha256": "m"}, {"x": 1}, {"sha256": "l"}, {"model": "r", "base_url": "http://u/", **more})
    assert [r.id for r in evaluation.resume(s, done, settings("full"), settings("full", base_url="http://u"), media("1"), media("1")).collect()] == ["b"]
    for old, new, a, b in ((settings("full"), settings("audio"), "1", "1"), (settings("full"), settings("full", model="q"), "1", "1"), (settings("full"), settings("full"), "1", "2")):
        with pytest.raises(Exception, match="stage|remote_model|media changed"):
            evaluation.resume(s, done, old, new, media(a), media(b)).collect()
    assert "remote_model" not in [r.key for r in settings("audio").collect()]
    assert [(r.id, r.sha256) for r in runs.merged_media(media("1"), media("2")).collect()] == [("a", "2")]


def test_cached_scans(spark):
    rows = [(1, "i", '{"candidates": []}'), (1, "i", '{"candidates": 3}'), (1, "i", "no"), (2, "i", '{"candidates": []}'), (1, "j", '{"candidates": []}'), (1, "i", None)]
    d = spark.createDataFrame(rows, "version int, identity string, answer string")
    assert runs.cached_scans(d, 1, F.lit("i")).count() == 1
