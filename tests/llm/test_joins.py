"""N-gram join, components, nearest neighbours and the pipeline: against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import components, mixing, neighbours, ngram_join, shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_join(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(links[i])))
    return sorted(out, key=repr)


def near_copies(rng, n):
    rows = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 5, 8, 40, 200]))]
        for _ in range(rng.choice([1, 1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def joined(spark, rows, **more):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("own"))
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(d, **more).collect()), key=repr)


def test_join_equals_brute_force(spark, monkeypatch):
    rows = near_copies(random.Random(1), 60) + [(900, None), (901, ""), (902, "..."), (None, "a b c d e f"), (None, "a b c d e f"), (903, "a b c d e f"), (904, "Long " * 30_000), (905, "long " * 20_000)]
    assert joined(spark, rows) == brute_join(rows)


def test_join_of_a_hot_group_in_stripes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STRIPE", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert joined(spark, rows) == brute_join(rows)


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], DOCS)).count() == 0


def test_depth_is_shortened_until_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        d = ngram_join.depth_for(0.8, recall)
        assert 1 - (1 - 0.8**d) ** 32 >= recall > 1 - (1 - 0.8 ** (d + 1)) ** 32
        levels = ngram_join.levels_of(d)
        assert levels[0] == 14 and levels[-1] == d and levels == sorted(set(levels), reverse=True)


def test_shortening_stops_by_what_was_found():
    enough = lambda bands, depth: ngram_join.enough(bands, depth, 0.8, 0.9999, 32)
    assert enough({}, 6) and enough({0: 9}, 6) and not enough({}, 14) and not enough({9: 5_000}, 14) and not enough({}, 10)
    assert enough({}, 8) and enough({9: 20_000}, 8) and not enough({9: 20_000, 0: 1}, 8) and not enough({1: 1}, 8)


def test_prefixes_agree_with_minima():
    rng = random.Random(5)
    grams = [ngram_join.shingles(" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(60))) for _ in range(3)]
    grams.append(np.unique(np.r_[grams[0][:-2], grams[1][:2]]))
    values = [ngram_join.minima(g, 8, 11) for g in grams]
    assert all((v == ngram_join.minima(g, 8, 11, block=7)).all() for v, g in zip(values, grams, strict=True))
    t = pa.table({c: pa.array([ngram_join.labels(v, 3)[i] for v in values], pa.list_(pa.int64())) for i, c in enumerate(("keys", "deep"))})
    for level, keys in zip((11, 6, 3), ngram_join._prefixes(t, 8, 3, [11, 6, 3]), strict=True):
        for i in range(4):
            for j in range(4):
                if (values[i][:, :level] == values[j][:, :level]).all(axis=1).any():
                    assert ((values[i][:, :level] == values[j][:, :level]).all(axis=1) <= (keys[i] == keys[j])).all()
    assert (np.array(values[0]) == np.array(values[3])).mean() > 0.8


def test_join_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (2, a + " more"), (1, b), (3, b + " more"), (4, c), (4, c), (4, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_grams, r.class_id, r.n_links, r.class_key) for r in ngram_join.join(d).collect())
    assert [x[:4] for x in got] == [(1, 36, 1, 1), (1, 36, 1, 1), (2, 37, 1, 1), (3, 37, 1, 1), (4, 36, 4, 2), (4, 36, 4, 2), (4, 36, 4, 2)]
    assert len({x[4] for x in got}) == 3 and got[2][4] != got[3][4]


def test_join_of_one_id_on_many_texts(spark):
    rng = random.Random(6)
    rows = [(7, " ".join(f"w{rng.randrange(9000)}" for _ in range(30))) for _ in range(300)] + [(8, "a b c d e f g"), (9, "a b c d e f g")]
    got = joined(spark, rows)
    assert [x for x in got if x[0] != 7] == [(8, 8, 1), (9, 8, 1)] and sum(x == (7, 7, 0) for x in got) == 300


def test_links_and_edges_are_stored_in_few_files(spark, monkeypatch):
    stored = {"links": [], "edges": []}

    def counted(df, name):
        out = shared.cut(df, name)
        stored.get(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    monkeypatch.setattr(components, "cut", counted)
    rows = near_copies(random.Random(8), 60)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        assert joined(spark, rows) == brute_join(rows)
        assert stored["links"] and set(stored["links"]) == {1} and len(stored["edges"]) > 1 and set(stored["edges"]) == {1}
        monkeypatch.setattr(shared, "FILE_ROWS", 16)
        stored["links"].clear(), stored["edges"].clear()
        assert joined(spark, rows) == brute_join(rows)
        assert max(stored["links"]) > 1 and max(stored["edges"]) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (200, 199)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_neighbours(rows, k=5, every=50):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(fine):
        if q % every == 0:
            s = sorted((-round(float(fine[q] @ v / np.linalg.norm(fine[q]) / np.linalg.norm(v)), 12), i) for i, v in fine.items() if i != q)[:k]
            out += [(q, r, i) for r, (_, i) in enumerate(s, 1)]
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[3][1]]), (203, None), (204, [0.0] * 8), (205, [float("nan")] + [1.0] * 7), (206, [None] + [1.0] * 7), (207, []), (None, [1.0] * 8), (208, [float("inf")] * 8)]
    rows += [(i, rows[50][1]) for i in range(300, 320)]
    d = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(d).collect())
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_neighbours(single)


def test_neighbours_of_huge_and_tiny_vectors_and_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((130, 6))
    rows = [(i, (v * 10.0 ** [0, 200, -200, 300][i % 4]).tolist()) for i, v in enumerate(x)]
    short = [(1000 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((9, 3)))]
    ids = [(2000, x[0].tolist()), (2000, x[1].tolist()), (2000, x[1].tolist()), (0, x[7].tolist())]  # one id on two vectors; repeated rows
    d = spark.createDataFrame(rows + short + ids, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(d).collect())
    want = []
    for group, by_id in ((rows + ids, {}), (short, {})):
        for i, v in group:
            by_id.setdefault(i, []).append(np.array(v) / np.abs(v).max())
        for q in (i for i in by_id if i % 50 == 0):
            asks = np.array(min(v for i, v in group if i == q))
            asks = asks / np.abs(asks).max()
            cos = lambda v: float(v @ asks / np.linalg.norm(v) / np.linalg.norm(asks))  # noqa: B023, E731
            s = sorted((-round(max(map(cos, vs)), 12), i) for i, vs in by_id.items() if i != q)[:5]
            want += [(q, r, i) for r, (_, i) in enumerate(s, 1)]
    assert got == sorted(want)


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(8)
    c = neighbours.unit(rng.standard_normal((3000, 64)))
    q = neighbours.unit(c[:40] + 0.3 * rng.standard_normal((40, 64)))
    i, j = neighbours.scan(q, c, 6)
    whole = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    best = np.argsort(whole, axis=1)[:, :6]
    kept = [set(j[i == k].tolist()) for k in range(40)]
    hits = sum(len(kept[k] & set(best[k].tolist())) for k in range(40))
    assert hits >= 0.95 * 240 and len(j) < 0.2 * whole.size
    bound = np.sort(whole, axis=1)[:, 2] + 1e-9
    i, j = neighbours.scan(q, c, 6, bound)
    assert (whole[i, j] <= bound[i] * (1 + 1e-6)).all()
    few = neighbours.scan(q[:2], c[:3], 6)
    assert few[0].tolist() == [0, 0, 0, 1, 1, 1]


def test_neighbours_of_one_row_and_none(spark):
    d = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.search(d).count() == 0 and neighbours.search(d.limit(0)).count() == 0
    two = spark.createDataFrame([(50, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in neighbours.search(two).collect()] == [(50, 1, 1)]


def test_neighbours_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(6)]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(d).collect()}
    want = {(q, i) for q, _, i in brute_neighbours(rows)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 6000)] + rng.standard_normal((6000, 32))).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(d).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        own = {r.vec_id for r in got if r.query_id == q}
        assert len(own) == 5
        hits += len(own & set(np.argsort(-s)[:5].tolist()))
        total += 5
    assert hits / total >= 0.9


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = {"en": "the and with from this that river stone".split(), "fr": "été où déjà français être rivière".split()}
    text = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice(["", "s", "er"]) + str(rng.choice("abcdefgh")) for _ in range(n))
    rows = []
    for i in range(120):
        k = rng.choice(["en", "fr"])
        rows.append((i, "\n".join(text(k, rng.randrange(5, 30)) for _ in range(3)) + ("\nshared by many documents" if i % 4 == 0 else ""), k, f"s{i % 3}", 0))
    rows += [(200, rows[1][1], "en", "s0", 0), (201, rows[1][1] + " more", "en", "s1", 0), (202, None, "en", "s0", 0), (203, "", "en", "s0", 0), (204, "12 34", None, "s0", 0), (205, rows[2][1], "en", None, 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_pipeline(spark, corpus):
    folder, rows = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.cut(stage(spark, docs, folder), "test")
        kept.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
    columns = [c.split(" ")[0] for c in DOCS.split(", ")]
    assert all(c == columns for _, c, _ in kept[:-1])
    ids = [{r["doc_id"] for r in rows_} for _, _, rows_ in kept]
    assert ids[0] == {r[0] for r in rows} - {202, 203, 204}
    lines = [line for r in kept[1][2] for line in r["text"].split("\n")]
    assert lines.count("shared by many documents") == 1 and ids[1] == ids[0]
    assert ids[2] == ids[1] - {200, 201, 205}
    sizes = {r["doc_id"]: len(r["text"].split()) for r in kept[2][2]}
    total = sum(sizes.values())
    mixed = sum(len(r["text"].split()) for r in kept[3][2])
    assert abs(mixed - 1.5 * total) <= 3 and ids[3] <= ids[2]
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3][2])
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in kept[4][2]) and len(kept[4][2]) == len(kept[3][2])
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4][2])


def test_line_dedup_stage_loses_no_line(spark):
    common = ["a rather long line that many of the documents share", "and another one, as long, that as many of them share"]
    rows = [(i, "\n".join([*common, f"only {i}"]), "en", "a", 0) for i in range(12)]  # common lines are over nine tenths of each
    rows += [(20, "\n".join(common), "en", "a", 0), (21, common[0] + "\n \t", "en", "a", 0), (22, None, "en", "a", 0)]
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {0: rows[0][1], 22: None} | {i: f"only {i}" for i in range(1, 12)}


def test_near_copies_are_decided_by_row(spark):
    a, b, c, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abce")
    rows = [(1, a), (1, a), (2, a + " more"), (2, b), (3, c), (3, e), (None, c), (None, "no copy of this one"), (None, "no copy of this one"), (4, None), (5, b)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_near_copies(spark, d, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (3, e), (None, "no copy of this one"), (4, None)], key=repr)


def test_mix_stage_hands_out_every_token(spark, tmp_path):
    rows = [(None, "a b c d e f g", "en", "s", 0)] * 9 + [(4, "a b c", "en", "s", 0)] * 4 + [(4, "x", "en", "t", 0), (5, None, "en", "t", 0), (6, "", "fr", None, 0), (7, "p q r", "fr", None, 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("_taken", F.lit("own"))
    d.write.parquet(str(tmp_path / "docs"))
    results = []
    for docs in (d, spark.read.parquet(str(tmp_path / "docs"))):
        got = corpus_pipeline.mix_sources(spark, docs, "").collect()
        assert docs.columns == list(got[0].asDict()) and {r["_taken"] for r in got} == {"own"} and all(r.n_chars == len(r.text) for r in got)
        results.append(sorted((str(r.source), str(r.doc_id), r.text) for r in got))
        words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in ("s", "t", None)}
        want = {r.source: math.floor(r.target) for r in mixing.mix(docs).collect()}
        assert words == want
    assert results[0] == results[1]


def test_stages_of_nothing_and_of_clashing_columns(spark):
    none = spark.createDataFrame([], DOCS)
    odd = spark.createDataFrame([(1, "the river runs by the stone", "en", "a", 0, 1, 2, 3)] * 2 + [(None, None, None, None, None, None, None, None)], DOCS + ", score int, N_lines int, _row int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        got = stage(spark, odd, "")
        if name != "bpe":
            assert got.columns == odd.columns
            assert all(r.score == 1 and r["N_lines"] == 2 and r["_row"] == 3 for r in got.collect() if r.doc_id == 1)
        assert got.where("doc_id = 1").count() == (1 if name == "near_copies" else got.where("doc_id = 1").count())


def test_first_words_keep_white_space(spark):
    d = spark.createDataFrame([("  a  b\tc\n d ",)], "text string")
    got = [d.select(corpus_pipeline.first_words(F.col("text"), F.lit(n))).first()[0] for n in (1, 2, 3, 4)]
    assert got == ["  a", "  a  b", "  a  b\tc", "  a  b\tc\n d"]
