import io
import json
import urllib.error
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import prompts
from chronolith.operators import visual
from chronolith.sources import http, media_tools, readers, sinks
from chronolith.sources.adapters import RetryableError, with_retries


class Reply(io.BytesIO):
    def __enter__(self):
        return self


def failing(code, headers=None):
    def opener(request, timeout):
        raise urllib.error.HTTPError("u", code, "no", headers or {}, io.BytesIO(b"text"))

    return opener


def test_chat_model():
    seen = []

    def opener(request, timeout):
        seen.append(json.loads(request.data))
        return Reply(json.dumps({"choices": [{"message": {"content": [{"text": "a"}, {"x": 1}, {"text": "b"}]}}]}).encode())

    assert http.ChatModel("http://x", "m", "k", opener=opener)({"media_url": "data:", "prompt": "p"}) == {"text": "a\nb"}
    assert seen[0]["model"] == "m"
    with pytest.raises(RetryableError) as e:
        http.ChatModel("http://x", "m", "k", opener=failing(429, {"Retry-After": "7"}))({"media_url": "", "prompt": ""})
    assert e.value.after == 7.0
    with pytest.raises(RuntimeError, match="status 400"):
        http.ChatModel("http://x", "m", "k", opener=failing(400))({"media_url": "", "prompt": ""})


def test_asked_delay():
    assert http.asked_delay("-3") == 0.0 and http.asked_delay("soon") is None and http.asked_delay(None) is None
    assert http.asked_delay("Fri, 01 Mar 2024 12:00:30 GMT", now=1709294400.0) == 30.0


def test_download(tmp_path):
    sizes = iter([b"abc", b"abcde"])
    path = str(tmp_path / "f")
    get = http.Download(opener=lambda request, timeout: Reply(next(sizes)))
    assert with_retries(get, {"url": "http://x", "path": path, "size": 5}, 3, sleep=lambda s: None) == ({"path": path, "size": 5}, 2)
    with pytest.raises(RuntimeError, match="more than"):
        http.Download(2, opener=lambda request, timeout: Reply(b"abc"))({"url": "http://x", "path": path + "2"})
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


class Broken(Reply):
    def read(self, n=-1):
        raise ConnectionResetError("reset")


def test_what_breaks_while_it_is_read_is_tried_again(tmp_path):
    path, waits = str(tmp_path / "f"), []
    replies = iter([Broken(b""), Reply(b"abcd")])
    assert http.fetch("http://x", path, 4, opener=lambda request, timeout: next(replies), sleep=waits.append) == {"path": path, "size": 4}
    assert len(waits) == 1 and 1.0 <= waits[0] <= 1.25
    replies = iter([urllib.error.HTTPError("u", 429, "no", {"Retry-After": "900"}, io.BytesIO()), Reply(b"abcd")])

    def opener(request, timeout):
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert http.fetch("http://x", path, 4, opener=opener, sleep=waits.append)["size"] == 4 and 30.0 <= waits[1] <= 30.25
    with pytest.raises(RuntimeError, match="outside"):
        http.fetch("http://x", path, 0, opener=opener)


@pytest.mark.parametrize("body", [b"no json", b"{}", b'{"choices": []}', b'{"choices": [{"message": {"content": " "}}]}', b'{"choices": [{"message": {"content": [{"x": 1}]}}]}'])
def test_unreadable_answers_are_tried_again(body):
    seen = []

    def opener(request, timeout):
        seen.append(json.loads(request.data))
        return Reply(body)

    with pytest.raises(RetryableError):
        http.ChatModel("http://x", "m", "k", opener=opener)({"media_url": "http://v", "prompt": "p"})
    assert seen[0]["temperature"] == 0
    with pytest.raises(RuntimeError, match="more than"):
        http.ChatModel("http://x", "m", "k", opener=opener, most_bytes=2)({"media_url": "data:video/mp4;base64,QUJD", "prompt": "p"})


def test_detector(spark, tmp_path):
    path = str(tmp_path / "a.wav")
    with wave.open(path, "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(16000)
        f.writeframes(np.array([[16384, 0], [-16384, -16384]], "<i2").tobytes())
    model = lambda x: np.array([[x[0], 0.05, 0.25], [0.0, 0.01, 0.0]])
    answer = media_tools.Detector(model)({"path": path})
    assert answer == {"scores": [[0.25, 0.05, 0.25], [0.0, 0.01, 0.0]]}
    d = spark.createDataFrame([(1, json.dumps(answer))], "vid int, answer string")
    (r,) = media_tools.detector_frames(d, ["vid"], [("Shatter", 2), ("Glass", 0), ("Tap", 1)]).collect()
    assert (r.frame_idx, r.start, r.end, r.score, r.top_label, r.label_scores) == (0, 0.0, 0.96, 0.25, "Shatter", {"Glass": 0.25, "Shatter": 0.25, "Tap": 0.05})
    with pytest.raises(RuntimeError, match="Hz"):
        media_tools.Detector(model, 8000)({"path": path})


def test_catalog_and_demo_documents(spark, tmp_path):
    c, b = tmp_path / "c.json", tmp_path / "b.json"
    item = {"id": "a", "file_title": "File:A", "filename": "a.webm", "source_group": "g", "derivative_size": 5, "local_existing": True, "expected": False}
    c.write_text(json.dumps({"version": 1, "items": [item]}))
    (r,) = readers.catalog(spark, str(c)).collect()
    assert (r.pos, r.id, r.source_group, r.derivative_size, r.local_existing, r.clip_start) == (0, "a", "g", 5, True, None)
    sinks.write_items(readers.catalog(spark, str(c)), str(tmp_path / "out"))
    assert [x.id for x in readers.catalog(spark, str(tmp_path / "out")).collect()] == ["a"]
    c.write_text(json.dumps({"version": 2, "items": [item]}))
    with pytest.raises(Exception, match="version 1"):
        readers.catalog(spark, str(c)).collect()
    b.write_text(json.dumps({"source": "s", "result": {"summary": "x", "events": [{"time": "00:02-01:03", "visual": "v"}]}, "verification": {"audio_mean_db_by_second": [-51.2, -50.6]}}))
    d = readers.demo_baseline(spark, str(b))
    assert [(e.start, e.end, e.visual, e.audio) for e in readers.demo_events(d).collect()] == [(2.0, 63.0, "v", None)]
    assert [(x.second, x.mean_db) for x in readers.demo_levels(d).collect()] == [(0, -51.2), (1, -50.6)]


def test_scene_times_that_are_no_numbers(spark):
    log = "pts_time:1.0\npts_time:N/A\nlavfi.scene_score=0.9\npts_time:2\nlavfi.scene_score=x\nlavfi.scene_score=0.5\nlavfi.scene_score=0.8"
    assert [(r.time, r.score) for r in readers.scene_hints(spark.createDataFrame([(1, log)], "vid int, value string"), ["vid"]).collect()] == [(2.0, 0.5)]


def test_a_cache_that_cannot_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    d = spark.createDataFrame([("k", "v")], "key string, value string")
    assert sinks.try_append(d, str(tmp_path / "cache")) is None and sinks.latest_entries(spark, str(tmp_path / "cache"), "key").count() == 1
    assert sinks.try_append(d, str(tmp_path / "file" / "below"))


def test_commands():
    assert media_tools.cut_command("a", "b", 1.0, 0.01)[-1] == "b" and "0.100" in media_tools.cut_command("a", "b", 1.0, 0.01)
    with pytest.raises(ValueError):
        media_tools.cut_command("a", "b", -1.0, 1.0)
    with pytest.raises(RuntimeError, match="not installed"):
        media_tools.run(["no-such-tool-here"])


def test_prompts(spark):
    hints = F.array(F.struct(F.lit(2.5).alias("time"), F.lit(0.4).alias("score")), F.struct(F.lit(1.0).alias("time"), F.lit(0.9).alias("score")))
    d = spark.range(1).select(prompts.scan_prompt(F.lit("glass"), hints), prompts.confirmation_prompt(F.lit("glass"), F.lit("note")), prompts.review_prompt(F.lit("glass"), F.lit(1.0), F.lit(2.0))).first()
    assert "1.000 s、2.500 s" in d[0] and "“glass”" in d[1] and "between 1.00 and 2.00" in d[2]
    parts = F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end")), F.struct(F.lit(3.0).alias("start"), F.lit(4.5).alias("end")))
    c = spark.range(1).select(prompts.consolidation_prompt(F.lit("glass"), parts), prompts.scan_prompt(F.lit("glass"), F.slice(hints, 1, 0), sounds=hints)).first()
    assert "1.00-2.00 s、3.00-4.50 s" in c[0] and "same_occurrence" in c[0] and "Jumps" not in c[1] and "it: 1.000 s、2.500 s." in c[1]


def test_file_infos(spark):
    page = {"title": "File:A", "imageinfo": [{"url": "http://d", "descriptionurl": "http://p", "size": 5, "mime": "video/webm", "sha1": "s", "extmetadata": {"Artist": {"value": "<b>B &amp; C</b>"}}}]}
    opener = lambda request, timeout: Reply(json.dumps({"query": {"pages": [page]}}).encode())
    answer = http.FileInfo("http://x", opener=opener)({"title": "File:A"})
    r = readers.file_infos(spark.createDataFrame([(json.dumps(answer),)], "answer string")).first()
    assert (r.canonical_title, r.download_url, r.size, r.artist, r.license) == ("File:A", "http://d", 5, "B & C", "")
    gone = lambda request, timeout: Reply(json.dumps({"query": {"pages": [{"missing": True}]}}).encode())
    with pytest.raises(RuntimeError, match="no such file"):
        http.FileInfo("http://x", opener=gone)({"title": "x"})


def test_visual_candidates(spark):
    raw = '{"candidates": [{"start": 1, "end": 2, "confidence": 80, "visual_evidence": "a"}, {"start": 1.5, "end": 3, "confidence": 0.7, "visual_evidence": "b"}, {"start": 8, "end": 9, "confidence": 0.1}, {"start": "x", "end": 2, "confidence": 1}, {"start": 6, "end": 7, "confidence": 0.5}, 4]}'
    d = spark.createDataFrame([(1, raw), (2, '{"candidates": "no"}'), (3, "{}")], "vid int, raw string").withColumn("answer", F.try_parse_json("raw"))
    got = visual.visual_candidates(d, ["vid"], F.lit(10.0), padding=1.0).orderBy("start").collect()
    assert [(r.vid, r.start, r.end, r.score, r.evidence) for r in got] == [(1, 0.0, 4.0, 0.8, "a；b"), (1, 5.0, 8.0, 0.5, "")]
