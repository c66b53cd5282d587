"""Mixing, BPE, line dedup, media, sharding, license scans, language ID, quality: against brute force, on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import bpe, language, license_scan, line_dedup, media, mixing, quality, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000
ROWS = [
    (1, "Hello world\nSame line\n", "en", "a", 1),
    (1, "Hello world\nSame line\n", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", None),
    (5, "  SAME LINE \t\nÉtéÉ 漢字 12", "fr", "", 3),
    (None, "no id here", None, "a", 1),
    (6, "!!! ??? \n\n", "de", "c", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_equal_iterated_resharing(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {f"s{i}" if i else None: rng.choice([0, 1, 7, 50, 400, 3000]) for i in range(9)}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = brute_targets(sizes)
        assert {r.source for r in got} == set(sizes)
        assert all(math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9) for r in got)


def test_mix_meets_its_budgets(docs):
    got = mixing.mix(docs, slice_rows=2).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.doc_id: r["size"] for r in got}[4] == 40_000 and {r.doc_id: r["size"] for r in got}[2] == 0
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == math.floor(own[0].target)
    again = mixing.mix(docs.repartition(3), slice_rows=3).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)


def test_mix_of_hot_rows_equals_a_line_of_tokens(spark):
    rows = [(None, "a b c", "en", "s", 0)] * 400 + [(7, f"w{i} x", "en", "s", 0) for i in range(50)] + [(None, None, None, "s", 0)] * 90 + [(i, "one two three four", "en", "t", 0) for i in range(30)]
    d = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("own")).withColumn("slice", F.lit(1)).withColumn("Taken", F.lit(-1))
    got = mixing.mix(d.repartition(5), slice_rows=16, carry=["lang", "key", "slice", "Taken"]).collect()
    assert got[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken", "source", "token_start", "lang", "key", "slice"} and {r.key for r in got} == {"own"}
    assert sorted((str(r.doc_id), r["size"], r.source, r.lang) for r in got) == sorted((str(i), len((t or "").split()), s, k) for i, t, k, s, _ in rows)
    for s in "st":
        own = sorted((r.token_start, r["size"], r.taken) for r in got if r.source == s and r["size"])
        ends = [a + n for a, n, _ in own]
        assert [a for a, _, _ in own] == [0, *ends[:-1]]
        budget = math.floor(next(r.target for r in got if r.source == s))
        epochs, rest = divmod(budget, ends[-1])
        assert all(t == epochs * n + min(max(rest - a, 0), n) for a, n, t in own) and sum(t for *_, t in own) == budget


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    return path, tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(tokenizer):
    path, lib = tokenizer
    spec = open(path, "rb").read()
    encoder, decoder = bpe.Encoder(spec), bpe.Decoder(spec)
    rng = random.Random(4)
    letters = "aabcdeehilnorstt  \n\t'é漢1.,!<|endoftext|>\x1c "
    texts = ["", "<|endoftext|>", "a<|endoftext|>b", "x" * 5000, "  ", "don't  stop\n\n", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000))]
    texts += [f"a{c} {c}{c}1 {c} b" for c in map(chr, [*range(0x400), *range(0x2000, 0x2100), 0x3000])]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = encoder.encode(t)
        assert ids == e.ids and decoder.decode(ids) == t


def test_automaton_accepts_only_what_merges_make():
    vocab = {bytes([b]): b for b in range(97, 100)} | {b"ab": 1, b"abc": 2, b"aa": 3, b"bc": 4, b"aaa": 5}
    merges = [(b"a", b"a"), (b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"aa", b"a")]
    machine = bpe.Automaton(vocab, merges)

    def by_merging(word):
        parts = [bytes([b]) for b in word]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return tuple(vocab[p] for p in parts)

    rng = random.Random(1)
    for _ in range(500):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        assert machine.encode(w) == by_merging(w)


def test_bpe_columns(docs, none, tokenizer):
    path, lib = tokenizer
    d = docs.withColumn("ids", F.lit("taken")).withColumn("decoded", F.lit(0))
    got = bpe.decode(bpe.encode(d, path), path).collect()
    for r in got:
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    both = bpe.encode_and_decode(d, path).collect()
    assert sorted(map(str, both)) == sorted(map(str, got)) and bpe.encode_and_decode(none, path).count() == 0
    assert bpe.encode(none, path).count() == 0


def brute_lines(rows, least):
    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    seen = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    return sorted((str(i), len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for i, t, *_ in rows)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_line_dedup_equals_brute_force(docs, least):
    got = line_dedup.line_dedup(docs.withColumn("n_lines", F.lit("own")), least).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.text or "") for r in got) == brute_lines(ROWS, least)


def test_line_dedup_can_keep_the_first(spark, none):
    rows = [(i, f"only {i}\nshared  \nSHARED", "en", "a", 0) for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS), 3, keep_first=True).collect()}
    assert got == {0: "only 0\nshared  ", 1: "only 1", 2: "only 2", 3: "only 3"}
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("keep", [False, True])
def test_line_dedup_of_hot_and_cold_keys(spark, monkeypatch, keep):
    rng = random.Random(12)
    line = lambda: rng.choice(["everywhere", " EVERYWHERE ", f"cold {rng.randrange(60)}", f"only {rng.random()}", ""])
    rows = [(rng.choice([None, 3, i]), "\n".join(line() for _ in range(rng.randrange(1, 6))), "en", "a", 0) for i in range(300)]
    rows += rows[:20]  # repeated rows
    d = spark.createDataFrame(rows, DOCS).withColumn("lines", F.lit("own")).withColumn("runs", F.lit(0)).withColumn("N_Dropped", F.lit("x"))
    who = lambda i, t: ("text", t) if i is None else i
    seen, hot = {}, line_dedup.hot_hashes
    for i, t, *_ in rows:
        for x in t.split("\n"):
            seen.setdefault(x.strip().lower(), set()).add(who(i, t))
    for share in (1 / 512, 1 / 4, 2.0):
        monkeypatch.setattr(line_dedup, "hot_hashes", lambda lines, share=share: hot(lines, share))
        got = line_dedup.line_dedup(d, 5, keep_first=keep).collect()
        assert all(r.lines == "own" and r.runs == 0 for r in got) and "N_Dropped" not in got[0].asDict()
        common = {k for k, v in seen.items() if k and len(v) >= 5}
        if not keep:
            assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), "\n".join(x for x in t.split("\n") if x.strip().lower() not in common)) for i, t, *_ in rows)
        else:
            left = {}
            for r in got:
                for x in set(r.text.split("\n")):
                    left.setdefault(x.strip().lower(), []).append((r.doc_id, r.text))
            assert all(len({who(*x) for x in left[k]}) >= 1 for k in common) and sum(len(set(left[k])) for k in common) == len(common)


def test_keep_bitmaps_are_runs(spark):
    rows = [(i, "x\na%d\nb%d\nx\nx\nc%d" % (i, i, i), "en", "a", 0) for i in range(3)]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, DOCS), 3).first()
    assert got.n_dropped == 3 and [tuple(r) for r in got.kept_runs] == [(1, 2), (5, None)]


def test_media_round_trip(docs, none):
    got = media.media_columns(media.pack(docs.withColumn("codec", F.lit(1))), digests=True).collect()
    for r in got:
        data = (r.text or "").encode()
        want = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.codec == "raw " and r.n_samples == len(want) // 576 and r.n_keyframes == -(-r.n_samples // 8)
        assert all(bytes(r.media[k.start : k.end]) == want[8 * i * 576 :][:576] for i, k in enumerate(r.keyframes))
    assert media.media_columns(media.pack(none)).count() == 0


def test_media_survives_damage(spark):
    whole = media.container(media.pad(b"abc" * 1000))
    rng = random.Random(6)
    cut = [whole[: rng.randrange(len(whole))] for _ in range(40)] + [bytes(rng.randrange(256) if rng.random() < 0.02 else b for b in whole) for _ in range(40)] + [b"", None]
    d = media.media_columns(spark.createDataFrame([(x,) for x in cut], "media binary"))
    assert d.count() == len(cut)
    assert media.media_columns(spark.createDataFrame([(None,)], "media binary")).first().codec is None


def test_media_tables_of_other_writers():
    """32-bit offsets, samples of different sizes, several chunks, no stss, a 64-bit mdhd."""
    import struct

    sizes, payload = [3, 5, 2, 7], bytes(range(17))
    stbl = media.box(
        b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"sowt", bytes(28))), media.full_box(b"stts", struct.pack(">5I", 2, 1, 10, 3, 20)),
        media.full_box(b"stsc", struct.pack(">7I", 2, 1, 1, 1, 2, 3, 1)), media.full_box(b"stsz", struct.pack(">6I", 0, 4, *sizes)), media.full_box(b"stco", struct.pack(">3I", 2, 8, 11)),
    )
    mdhd = media.full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, 1000, 70, 0, 0), version=1)
    data = media.box(b"mdat", payload) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    (t,) = media.parse(data)
    assert (t["codec"], t["timescale"], t["duration"]) == ("sowt", 1000, 70)
    assert t["starts"].tolist() == [8, 11, 16, 18] and len(t["sync"]) == 4 and media.payload_of(data, t) == payload


def track(*tables, ident=1, entries=b"raw "):
    import struct

    stbl = media.box(b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(entries, bytes(28))), *tables)
    mdhd = media.full_box(b"mdhd", struct.pack(">4I2H", 0, 0, 10, 5, 0, 0))
    tkhd = media.full_box(b"tkhd", struct.pack(">5I", 0, 0, ident, 0, 0) + bytes(60))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, media.box(b"minf", stbl)))


def test_media_with_impossible_counts_gets_nulls(spark):
    import struct

    huge = 0xFFFFFFFF
    stsc = media.full_box(b"stsc", struct.pack(">4I", 1, 1, 2, 1))
    stco = media.full_box(b"stco", struct.pack(">2I", 1, 8))
    size = lambda n, each=1: media.full_box(b"stsz", struct.pack(">2I", each, n))
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    whole = lambda *tables: media.box(b"mdat", b"abcdefgh") + media.box(b"moov", track(*tables))
    cases = [
        whole(size(huge), stsc, stco),
        whole(size(2), media.full_box(b"stsc", struct.pack(">4I", huge, 1, 2, 1)), stco),
        whole(size(2), media.full_box(b"stsc", struct.pack(">4I", 1, huge, 2, 1)), stco),
        whole(size(2, 500), stsc, stco),  # beyond the file
        whole(size(2), stsc, media.full_box(b"co64", struct.pack(">IQ", 1, (1 << 64) - 8))),
        whole(size(2), stsc, media.full_box(b"stco", struct.pack(">I", huge))),
        nested,
        media.box(b"mdat", bytes(800)) + media.box(b"moov", *(track(size(700), stsc, stco) for _ in range(90))),
        media.box(b"moov", track(size(0), stsc, stco)) + media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", struct.pack(">I", 1)), *(media.full_box(b"trun", struct.pack(">I", huge)) for _ in range(3)))),
        whole(media.full_box(b"stz2", struct.pack(">2I", 7, 2), b"ab"), stsc, stco),
    ]
    good = whole(size(2), media.full_box(b"stsc", struct.pack(">4I", 1, 1, huge, 1)), stco)  # a chunk may have room for more
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*cases, good])], "i int, media binary")
    got = sorted((r.i, r.codec, r.n_samples) for r in media.media_columns(d, digests=True).collect())
    assert got == [(i, None, None) for i in range(len(cases))] + [(len(cases), "raw ", 2)]


def test_media_compact_sizes_and_fragments():
    import struct

    stsc, stco = media.full_box(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), media.full_box(b"stco", struct.pack(">2I", 1, 8))
    for width, table in ((4, bytes([0x31, 0x20])), (8, bytes([3, 1, 2])), (16, struct.pack(">3H", 3, 1, 2))):
        data = media.box(b"mdat", b"abcdef") + media.box(b"moov", track(media.full_box(b"stz2", struct.pack(">2I", width, 3), table), stsc, stco))
        (t,) = media.parse(data)
        assert t["sizes"].tolist() == [3, 1, 2] and media.payload_of(data, t) == b"abcdef"
    none = [media.full_box(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [media.full_box(b"stsz", struct.pack(">2I", 0, 0))]
    trex = media.box(b"mvex", media.full_box(b"trex", struct.pack(">5I", 7, 1, 4, 2, 0x10000)))
    head = media.box(b"moov", track(*none, ident=7), trex)

    def moof(shift):
        first = media.full_box(b"trun", struct.pack(">Ii", 2, shift) + struct.pack(">I", 0), flags=0x5)  # defaults; the first is a sync sample
        second = media.full_box(b"trun", struct.pack(">I", 2) + struct.pack(">6I", 9, 3, 0, 9, 1, 0x10000), flags=0x700)
        return media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", struct.pack(">I", 7), flags=0x20000), first, second))

    data = head + moof(len(moof(0)) + 8) + media.box(b"mdat", b"abcdefgh")
    (t,) = media.parse(data)
    assert media.payload_of(data, t) == b"abcdefgh" and t["sizes"].tolist() == [2, 2, 3, 1]
    assert t["sync"].tolist() == [0, 2] and (t["duration"], t["timescale"]) == (4 + 4 + 9 + 9, 10)
    stray = bytearray(data)
    stray[data.index(b"trun") + 12 : data.index(b"trun") + 16] = struct.pack(">i", 1 << 30)
    with pytest.raises(ValueError):
        media.parse(bytes(stray))


def test_hilbert_visits_neighbours():
    for d, bits in ((2, 3), (3, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        order = points[np.argsort(sharding.hilbert_index(points, bits))]
        assert sorted(sharding.hilbert_index(points, bits).tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [1, 3, 40])
def test_shards_are_even_and_gapless(docs, none, n):
    got = sharding.document_shards(docs, n).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"rows"}
    counts = [sum(r.shard == k for r in got) for k in range(n)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(counts[k])) for k in range(n))
    assert all(r["size"] == len((t or "").encode()) + 16 for r in got for i, t, *_ in ROWS if i == r.doc_id)
    assert sharding.document_shards(none, n).count() == 0


def test_shards_equal_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, rng.choice(["", None, "same text", "x" * rng.randrange(400)]), rng.choice(["en", "en", "fr", None]), rng.choice("aaab"), 0) for i in range(500)] + [(7, "same text", "en", "a", 0)] * 40
    got = sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.document_shards(spark.createDataFrame(rows, DOCS).repartition(3), 7).collect())
    size = lambda t: len((t or "").encode()) + 16
    first = lambda v: (v is not None, v or "")
    columns = [[first(r[2]) for r in rows], [first(r[3]) for r in rows], [size(r[1]) for r in rows]]
    cells = [[sum(other < v for other in c) * 256 // len(rows) for v in c] for c in columns]
    curve = sharding.hilbert_index(np.array(cells).T, 8).tolist()
    order = sorted(range(len(rows)), key=lambda i: (curve[i], zlib.crc32((rows[i][1] or "").encode()), rows[i][0]))
    want, at = [], 0
    for k in range(7):
        n = len(rows) // 7 + (k < len(rows) % 7)
        want += [(str(rows[i][0]), zlib.crc32((rows[i][1] or "").encode()), k, slot) for slot, i in enumerate(order[at : at + n])]
        at += n
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and sorted(x[2:] for x in got) == sorted(x[2:] for x in want)


def test_shards_of_clashing_columns(spark):
    d = spark.createDataFrame([(i, i % 3, "v", 1, 2, 3, 4) for i in range(20)], "place int, slice int, value string, n int, Shard int, `a.b` int, c0 int")
    got = sharding.hilbert_shards(d, ["place", "slice"], ["value", "c0"], 4)
    assert got.columns == ["place", "slice", "value", "n", "a.b", "c0", "curve", "shard", "slot"]
    rows = got.collect()
    assert sorted(r.place for r in rows) == list(range(20)) and all(r.slice == r.place % 3 and r.n == 1 and r.c0 == 4 for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(4) for i in range(5)]


def test_shards_can_be_pruned(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(3000), rng.choice("abcd"), rng.choice(["s%02d" % k for k in range(20)]), 0) for i in range(2000)]
    d = sharding.document_shards(spark.createDataFrame(rows, DOCS), 40)
    assert sharding.prunable(d, "source", "s07").where("skipped").count() > 20
    assert sharding.prunable(d, "size", 100).where("skipped").count() > 10


def test_license_places_equal_brute_force(spark, none):
    texts = ["CC BY cc-by, CC by by cc", "General Public License general public licence", "all rights all rights reserved reserved", "", None, "Licensed under CC BY-NC 4.0.\nAll Rights Reserved", LONG + "cc by", "ccby cc  by é cc\nby"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    for r in license_scan.scan(d).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        want = sorted((i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r.n_words == len(w) and sorted((b.start, b.label) for b in r.base) == want
    assert license_scan.scan(none).count() == 0


def test_license_spans(spark):
    mit = next(t for k, t in license_scan.TEMPLATES if k == "mit" and len(t) > 100)
    part = mit.split()
    changed = " ".join(part[:40] + ["xx"] + part[42:])
    rows = [(1, "before " + mit + " after"), (2, changed), (3, " ".join(part[:10])), (4, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: {s.label: s for s in r.spans} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["mit"].share == 1.0 and got[1]["mit"].start == 1
    assert 0.9 < got[2]["mit"].share < 1 and not got[3] and set(got[4]) == {"apache-2.0"}


def test_license_ends_inside_a_longer_match(spark):
    short = "Licensed under the Apache License, Version 2.0"
    texts = [short + ". The river runs", short + ' (the "License"); read it well', "Under the Apache License, Version 2.0. The river", short + ". " + short + " the river", short + ".", "Apache License, Version 2.0. The river"]
    got = {r.doc_id: sorted((s.start, s.end, s.covered) for s in r.spans if s.label == "apache-2.0") for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [(0, 8, 8)], 1: [(0, 8, 8)], 2: [(0, 7, 7)], 3: [(0, 8, 8), (8, 16, 8)], 4: [(0, 8, 8)], 5: [(0, 5, 5)]}


def test_whole_templates_are_found_wherever_they_stand():
    rng = random.Random(11)
    hidden = 0
    for _ in range(300):
        templates = [[rng.choice("abc") for _ in range(rng.randrange(4, 7))] for _ in range(3)]
        templates += [[*rng.choice("abc"), *rng.choice(templates), *rng.choice(["", "a", "ab"])] for _ in range(3)]
        machine = license_scan.SuffixAutomaton(templates, [])
        text = [w for _ in range(4) for w in [*rng.choice(templates), *rng.choice(["", "a", "d"])]]
        ends = []
        _, matches = machine.stream(text, ends)
        before, spans = machine.spans(matches), machine.spans(matches, ends)
        for k, t in enumerate(templates):
            for i in range(len(text) - len(t) + 1):
                if text[i : i + len(t)] == t:
                    found = lambda spans: any(s[0] == k and s[1] < i + len(t) and i < s[2] and s[3] == len(t) for s in spans)  # noqa: B023, E731
                    assert found(spans)
                    hidden += not found(before)
        assert all(any(s[0] == b[0] and s[1] <= b[1] and b[2] <= s[2] and s[3] >= b[3] for s in spans) for b in before)
    assert hidden


def brute_chains(text, templates, least, gap):
    """Maximal matches by comparing everywhere, then chains in template order, one template at a time."""
    longest = [max((n for k in templates for e in range(1, len(k) + 1) for n in [next((n for n in range(min(e, i), 0, -1) if k[e - n : e] == text[i - n : i]), 0)]), default=0) for i in range(1, len(text) + 1)]
    maximal = [(i, n) for i, n in enumerate(longest, 1) if n >= least and (i == len(text) or longest[i] <= n)]
    out = []
    for t, words in enumerate(templates):
        chain = None
        for end, n in maximal:
            ends = [e for e in range(n, len(words) + 1) if words[e - n : e] == text[end - n : end]]
            if not ends:
                continue
            start = end - n
            if chain and 0 <= start - chain["end"] <= gap and (fit := [e for e in ends if 0 <= e - n - chain["at"] <= gap]):
                chain |= {"end": end, "covered": chain["covered"] + n, "at": min(fit)}
            elif chain and start < chain["end"] and n <= chain["covered"]:
                pass
            else:
                if chain:
                    out.append((t, chain["start"], chain["end"], chain["covered"]))
                chain = {"start": start, "end": end, "covered": n, "at": min(ends)}
        if chain:
            out.append((t, chain["start"], chain["end"], chain["covered"]))
    return sorted(out)


def test_chains_equal_brute_force():
    rng = random.Random(21)
    for _ in range(150):
        templates = [[rng.choice("abcdef") for _ in range(rng.randrange(4, 16))] for _ in range(4)]
        machine = license_scan.SuffixAutomaton(templates, [])
        text = []
        for _ in range(4):
            part = list(rng.choice(templates))
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice("abcxyz")
            text += part + [rng.choice("xyz")] * rng.randrange(4)
        _, matches = machine.stream(text)
        assert sorted(machine.spans(matches)) == brute_chains(text, templates, license_scan.MIN_MATCH, license_scan.MAX_GAP)


def test_license_ties_and_many_equal_rows(spark):
    both = (("one", "first second third fourth fifth"), ("two", "first second third fourth fifth"), ("two", "first second third fourth fifth sixth"))
    d = spark.createDataFrame([(i % 3, "x first second third fourth fifth y", 1) for i in range(300)], "doc_id long, text string, spans int")
    got = license_scan.scan(d, templates=both).collect()
    assert len(got) == 300 and {tuple(sorted((s.label, s.start, s.covered, s.share) for s in r.spans)) for r in got} == {(("one", 1, 5, 1.0), ("two", 1, 5, 5 / 6), ("two", 1, 5, 1.0))}


def test_matching_statistics_equal_brute_force():
    rng = random.Random(9)
    templates = [[rng.choice("abc") for _ in range(rng.randrange(3, 12))] for _ in range(6)]
    machine = license_scan.SuffixAutomaton(templates, [["a", "b"], ["b"]])
    inside = {tuple(t[i:j]) for t in [*templates, ["a", "b"], ["b"]] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        text = [rng.choice("abcd") for _ in range(30)]
        best = [max((n for n in range(1, i + 1) if tuple(text[i - n : i]) in inside), default=0) for i in range(1, 31)]
        ends = [(i, n) for i, n in enumerate(best, 1) if n >= license_scan.MIN_MATCH and (i == 30 or best[i] <= n)]
        found, matches = machine.stream(text)
        assert [(e, n) for e, n, _ in matches] == ends
        assert sorted(found) == sorted((p, i) for p, w in enumerate((["a", "b"], ["b"])) for i in range(30) if text[i : i + len(w)] == w)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = language.codewords(n)
        assert not (np.abs(code.sum(0)) == n).any()
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 4 else 4)


def test_language_is_learned_and_flagged(spark, none):
    words = {"en": "the and with from this that", "fr": "été où déjà français être", "de": "über straße schön müssen"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(20)), k, "a", 0) for i in range(150) for k in [rng.choice(sorted(words))]]
    rows += [(1000, None, "en", "a", 0), (1001, "12 !!", "en", "a", 0), (1002, "", None, "a", 0), (1003, "über straße schön", None, "a", 0), (None, "the and this", None, "a", 0), (1004, "été où " * 30_000, None, "b", 0)]
    got = language.identify(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own"))).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 150)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= r.score <= 1 for r in got) and by[1000].ambiguous
    assert language.identify(none).count() == 0
    assert language.identify(spark.createDataFrame(rows[:1], DOCS).withColumn("lang", F.lit(None).cast("string"))).first().lang_pred == "und"


def test_language_sample_bounds_rows_and_keeps_languages(spark, monkeypatch):
    english = [(None, f"the and with this that w{i}", "en", "a", 0) for i in range(600)]
    hot = [(7, f"über straße schön müssen w{i}", "de", "a", 0) for i in range(300)]
    same = [(9, "uno dos tres cuatro", "es", "a", 0)] * 200
    french = [(i, f"été où déjà français w{i}", "fr", "a", 0) for i in range(40, 90)]
    d = spark.createDataFrame(english + hot + same + french, DOCS)
    seen = []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda x, y, languages: seen.append((len(x), np.bincount(y).tolist(), languages)) or fit(x, y, languages))
    got = language.predict(d, language.train(d, per_language=20, most_rows=60)).collect()
    assert seen == [(60, [15] * 4, ["de", "en", "es", "fr"])] and all(r.lang_pred == r.lang for r in got)


def test_codeword_decoding_equals_brute_force():
    rng = np.random.default_rng(4)
    names = list("abcdefg")
    code = language.codewords(7)
    trust = rng.random(code.shape)
    model = language.Coder(names, code, np.zeros((language.DIM, code.shape[1])), np.zeros(code.shape[1]), trust / trust.sum(axis=1, keepdims=True))
    for _ in range(50):
        m = rng.standard_normal(code.shape[1]) * 3
        loss = [sum(model.trust[k][b] * math.log(1 + math.exp(-code[k][b] * m[b])) for b in range(code.shape[1])) for k in range(7)]
        low = sorted(loss)
        name, score = model.decode(m)
        assert name == names[loss.index(low[0])] and math.isclose(score, 1 - low[0] / low[1], abs_tol=1e-9)
    assert model.decode(np.zeros(code.shape[1]))[1] < 1e-9  # a tie of all
    clean = model.decode(code[3] * 9.0)
    flipped = code[3] * 9.0
    flipped[0] *= -1
    assert clean[0] == "d" and model.decode(flipped)[0] == "d"  # one wrong bit is corrected


def test_language_ties_and_many_equal_rows(spark):
    same = [(i % 5, "alpha beta gamma", "en" if i % 2 else "fr", "a", 0) for i in range(200)]
    got = language.identify(spark.createDataFrame(same, DOCS)).collect()
    assert len(got) == 200 and len({r.lang_pred for r in got}) == 1 and all(r.score < 0.01 and r.ambiguous for r in got)


def test_held_out(spark):
    d = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in d)


def test_ordinal_grades(spark, docs, none):
    rng = random.Random(5)
    text = lambda g: " ".join(rng.choice({0: "awful trash", 1: "plain middling", 2: "fine lucid"}[g].split() + ["the", "of"]) for _ in range(30))
    rows = [(i, text(i % 3)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(d, d.select("doc_id", (F.col("doc_id") % 3).alias("grade")), 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.grade(d.withColumn("keep", F.lit("own")), model).collect()
    assert all(r.keep == (r.doc_id % 3 == 2) and round(r.expected_grade) == r.doc_id % 3 for r in got)
    assert quality.grade(docs, model).count() == len(ROWS) and quality.grade(none, model).count() == 0
    assert quality.train(d, d.limit(0).withColumn("grade", F.lit(1)), 3) is None
    assert quality.grade(docs, None).where("keep").count() == len(ROWS)


def test_quality_sample_bounds_rows(spark, monkeypatch):
    text = {0: "awful trash", 1: "plain middling", 2: "fine lucid"}
    rows = [(1, f"{text[0]} w{i}") for i in range(500)] + [(i, f"{text[i % 3]} w{i}") for i in range(2, 60)] + [(70, None), (71, "fine " * 50_000)] + [(72, "fine lucid")] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 0)] * 40 + [(i, i % 3) for i in range(2, 60)] + [(70, 0), (71, 2), (72, 2), (None, 1), (3, None), (4, 9)], "doc_id long, grade int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, grades, n: seen.append(len(rows)) or fit(rows, grades, n))
    assert quality.train(d, ratings, 3, most_rows=100) is not None
    assert quality.train(d, ratings.where("doc_id > 1"), 3, most_rows=10_000) is not None
    assert seen == [100, 58 + 2 + 30]


def brute_loss(rows, grades, weight, cuts, decay):
    total = 0.0
    for cells, g in zip(rows, grades, strict=True):
        z = sum(weight[c] for c in cells)
        at_most = lambda j: 0.0 if j < 0 else 1.0 if j == len(cuts) else 1 / (1 + math.exp(z - cuts[j]))  # noqa: B023, E731
        total -= math.log(at_most(g) - at_most(g - 1))
    return total / len(rows) + decay / (2 * len(rows)) * sum(w * w for w in weight.values())


def test_ordinal_fit_is_at_the_least_loss():
    rng = random.Random(8)
    rows = [sorted(rng.sample(range(12), rng.randrange(1, 5))) for _ in range(120)]
    grades = np.array([min(2, max(0, round(sum(r) / 18 + rng.uniform(-0.7, 0.7)))) for r in rows])
    model = quality.fit(rows, grades, 3, rounds=3000, step=0.02)
    weight, cuts = {c: float(model.weight[c]) for c in range(12)}, [float(x) for x in model.thresholds]
    best = brute_loss(rows, grades, weight, cuts, 1.0)
    for c in range(12):
        for d in (-1e-3, 1e-3):
            assert brute_loss(rows, grades, weight | {c: weight[c] + d}, cuts, 1.0) > best - 1e-9
    for j in range(2):
        for d in (-1e-3, 1e-3):
            assert brute_loss(rows, grades, weight, [x + d * (i == j) for i, x in enumerate(cuts)], 1.0) > best - 1e-9
    above = model.above(rows[0])
    z = sum(weight[c] for c in rows[0])
    assert all(math.isclose(a, 1 / (1 + math.exp(t - z))) for a, t in zip(above, cuts, strict=True))
