import math

import pytest
from pyspark.sql import functions as F

from chronolith.functions import as_bool, as_confidence, canonical_json, clean_html, clock, iou, json_object, json_object_or_summary, overlap_fraction, padded_bounds, ratio, required_interval, required_text, retry_after_seconds, safe_name, same_core, source_core, tolerant_bounds


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_confidence(spark):
    cases = [(87.0, 0.87), (250.0, 1.0), (-3.0, 0.0), (1.0, 1.0), (math.nan, 0.0), (math.inf, 0.0), (None, 0.0), (0.12345, 0.123)]
    got = values(spark, [(a,) for a, _ in cases], "x double", as_confidence(F.col("x")))
    assert [g[0] for g in got] == [b for _, b in cases]


def test_bool(spark):
    cases = [("是", True), (" YES ", True), ("no", False), (None, False), ("1", True), ("", False)]
    assert [g[0] for g in values(spark, [(a,) for a, _ in cases], "x string", as_bool(F.col("x")))] == [b for _, b in cases]


def test_interval_measures(spark):
    b = [F.col(c) for c in "abcd"]
    rows = [(0.0, 2.0, 1.0, 3.0), (0.0, 10.0, 4.0, 5.0), (0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 1.0, 1.0)]
    got = values(spark, rows, "a double, b double, c double, d double", iou(*b), overlap_fraction(*b), same_core(*b))
    assert got == [(pytest.approx(1 / 3), 0.5, False), (0.1, 1.0, False), (0.0, 0.0, False), (0.0, 0.0, False)]


def test_same_core_needs_similar_lengths(spark):
    b = [F.col(c) for c in "abcd"]
    got = values(spark, [(0.0, 2.0, 0.0, 1.0), (0.0, 1.9, 1.0, 1.95), (0.0, 3.0, 1.0, 2.0)], "a double, b double, c double, d double", same_core(*b))
    assert [g[0] for g in got] == [True, True, False]


def test_source_core_has_no_tolerance(spark):
    b = [F.col(c) for c in "abcde"]
    rows = [(10.0, 20.0, 1.0, 1.5, 60.0), (10.0, 20.0, -0.1, 1.0, 60.0), (10.0, 20.0, 9.0, 10.1, 60.0), (10.0, 20.0, 4.0, 4.0, 60.0), (10.0, 20.0, math.nan, 1.0, 60.0), (10.0, 20.0, None, 1.0, 60.0)]
    got = values(spark, rows, "a double, b double, c double, d double, e double", source_core(*b))
    assert [tuple(g[0]) if g[0] else None for g in got] == [(11.0, 11.5)] + [None] * 5


def test_tolerant_bounds_fall_back_to_the_candidate(spark):
    b = [F.col(c) for c in "abcde"]
    rows = [(10.0, 20.0, -0.2, 10.2, 60.0), (10.0, 20.0, -0.3, 4.0, 60.0)]
    got = values(spark, rows, "a double, b double, c double, d double, e double", tolerant_bounds(*b), padded_bounds(tolerant_bounds(*b), F.lit(1.0), F.lit(20.5)))
    assert [tuple(g[0]) for g in got] == [(10.0, 20.0, True), (10.0, 20.0, False)]
    assert tuple(got[0][1]) == (9.0, 20.5)


def test_text_forms(spark):
    got = values(spark, [(75.5,), (-1.0,), (6000.25,)], "x double", clock(F.col("x")))
    assert [g[0] for g in got] == ["01:15.50", "00:00.00", "100:00.25"]
    got = values(spark, [(" a--b 2 ",), ("!!",), ("玻璃 破碎",)], "x string", safe_name(F.col("x")))
    assert [g[0] for g in got] == ["a_b_2", "event", "玻璃_破碎"]
    assert values(spark, [("<b>A &amp; B</b> ",), (None,)], "x string", clean_html(F.col("x"))) == [("A & B",), ("",)]


def test_json_object(spark):
    rows = [('{"a": 1}',), ('```json\n{"a": 2}\n```',), ('say {"a": 3} end',), ("[1]",), ("none",), ('{"a": NaN}',), (None,)]
    got = values(spark, rows, "x string", F.try_variant_get(json_object(F.col("x")), "$.a", "int"), json_object(F.col("x")).isNotNull())
    assert got == [(1, True), (2, True), (3, True), (None, False), (None, False), (None, True), (None, False)]
    got = values(spark, [("hello",)], "x string", F.try_variant_get(json_object_or_summary(F.col("x")), "$.summary", "string"))
    assert got == [("hello",)]


def test_ratio_and_retry_after(spark):
    assert values(spark, [(1, 3), (1, 0)], "a int, b int", ratio(F.col("a"), F.col("b"))) == [(0.3333,), (None,)]
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    rows = [("2.5",), ("-4",), ("Fri, 01 Mar 2024 12:00:30 GMT",), ("Fri, 01 Mar 2024 11:00:00 GMT",), ("soon",), (None,)]
    assert [g[0] for g in values(spark, rows, "x string", retry_after_seconds(F.col("x"), now))] == [2.5, 0.0, 30.0, 0.0, None, None]


def test_entities_and_dates(spark):
    cases = [("caf&eacute; &#233;&#xe9; &amp;lt; &nbsp;", "café éé &lt;"), ("<i>a</i>&hellip;", "a…")]
    assert values(spark, [(a,) for a, _ in cases], "x string", clean_html(F.col("x"))) == [(b,) for _, b in cases]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        now = F.lit("2024-03-01T12:00:00Z").cast("timestamp")
        dates = [("Fri, 01 Mar 2024 12:00:30 GMT", 30.0), ("Fri, 1 Mar 2024 14:00:30 +0200", 30.0), ("01 Mar 2024 12:00:05", 5.0), ("Fri, 01-Mar-2024 11:00:00 GMT", 0.0), ("7", 7.0), ("soon", None), (None, None)]
        assert values(spark, [(a,) for a, _ in dates], "x string", retry_after_seconds(F.col("x"), now)) == [(b,) for _, b in dates]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_canonical_json_and_required_values(spark):
    assert values(spark, [('{"b": 1.0, "a": [1e-7, "é"]}',), (None,)], "x string", canonical_json(F.col("x"))) == [('{"a":[1e-07,"é"],"b":1.0}',), (None,)]
    d = spark.createDataFrame([(1.0, 2.0)], "s double, e double")
    assert tuple(d.select(required_interval(F.col("s"), F.col("e"), "core")).first()[0]) == (1.0, 2.0)
    with pytest.raises(Exception, match="core is no valid interval"):
        d.select(required_interval(F.col("e"), F.col("s"), "core")).collect()
    with pytest.raises(Exception, match="no text"):
        spark.sql("SELECT array(named_struct('text', ' ')) AS p").select(required_text(F.col("p"))).collect()
