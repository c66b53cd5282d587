"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents are sets of word 5-grams; documents with equal sets are one class. Each of
`TREES` prefix tries labels a set with DEEPEST MinHash values. The labels of all tries
are range-sorted, so a subtree is a run of rows that share a prefix; one look at the
neighbours in the run tells which sets meet another one at all, at the shortest prefix
that can be needed (`depth_for`: there a pair just at the similarity threshold shares a
prefix in some trie with the target probability). The others, nearly all, go no further.

Pairs that meet are told apart by the longest prefix that they share in any trie, and
handled from the deepest level to the shortest. After each level the exact similarities
of its links say whether the prefix must be shortened further: it stops once `recall`
is reached for every similarity that occurs (`enough`). The shortest level meets the
target for all pairs.

A pair that meets in several tries is handled in the first one. A large subtree is dealt
into stripes by rows and by n-grams; pairs of stripes are separate cells of work, so no
task holds more than two stripes of one. Joins of tables that
grow with the documents are merge joins whatever their size, so a plan that is measured
on little is the plan that runs on much. Exact similarities give each set's number of
links; only these numbers and a spanning forest of the links leave a cell, never pairs.
To count M sets' links among each other takes M * M / 2 comparisons: they are spread
over cells, not saved. Components of the forests are the result's classes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .media import _pieces
from .shared import cut, discard, files, tidy

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
TREES = 32
DEEPEST = 14
#: Bounds of a stripe: sets, and n-grams of them all (a single longer set is a stripe's only one or shares it by chance).
STRIPE = 512
STRIPE_GRAMS = 1 << 18
BANDS = 10
MISSED = 0.1
PAIRS = 1 << 15
WORD = re.compile(r"\w+")
HASHES_KEPT = 200_000


class _Hashes(dict):
    """64-bit hashes of words, remembered for the most recent ones."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HASHES_KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hash_of = _Hashes().__getitem__


def reached(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair of this similarity shares a prefix of `depth` values in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(similarity: float, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of this similarity meets with probability `recall`: the shortest one ever needed."""
    return next((d for d in range(deepest, 1, -1) if reached(similarity, d, trees) >= recall), 1)


def levels_of(shortest: int, deepest: int = DEEPEST) -> list[int]:
    """The prefix lengths that are tried, longest first."""
    return sorted({max(shortest, d) for d in (deepest, (deepest + shortest) // 2, (deepest + 3 * shortest) // 4, shortest)}, reverse=True)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different word n-grams; words are lower-cased runs of letters, digits and _.

    Fewer than n words are one n-gram; no words: none.
    """
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def digest(grams: np.ndarray) -> bytes:
    """16 bytes that name a set of n-grams."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def minima(grams: np.ndarray, trees: int, depth: int, block: int = 512) -> np.ndarray:
    """The set's MinHash values (trees x depth, uint32)."""
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, 1 << 32, (2, trees * depth), np.uint32)
    a |= np.uint32(1)
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out, room = np.full(trees * depth, 0xFFFFFFFF, np.uint32), np.empty((min(block, len(x)), trees * depth), np.uint32)
    for at in range(0, len(x), block):  # a block of n-grams against all permutations stays in cache
        part = x[at : at + block, None]
        z = room[: len(part)]
        np.multiply(part, a, out=z)
        np.add(z, b, out=z)
        np.minimum(out, z.min(axis=0), out=out)
    return out.reshape(trees, depth)


def _number(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def labels(values: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each trie's label as two longs: a key of the first `shortest` values, different for each trie, and a byte of each further one (eight at most)."""
    h = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for level in values.T[:shortest]:
        h = (h ^ level.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    more = np.zeros((len(values), 8), np.uint8)
    more[:, : values.shape[1] - shortest] = (values[:, shortest:] * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return h.view(np.int64), more.view(">i8").ravel().astype(np.int64)


def signatures(docs: DataFrame, n: int, trees: int, shortest: int, deepest: int) -> DataFrame:
    """doc_id, text_hash, name (a digest of the set; null without words), n_grams, keys and deep (all tries' labels)."""

    def run(batches):
        for b in _pieces(batches, 512):
            names, sizes, keys, deep = [], [], [], []
            for x in b.column("text").to_pylist():
                g = shingles(x, n)
                sizes.append(len(g))
                names.append(digest(g) if len(g) else None)
                key, more = labels(minima(g, trees, deepest), shortest) if len(g) else (None, None)
                keys.append(key), deep.append(more)
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, long), pa.array(deep, long)], ["doc_id", "text_hash", "name", "n_grams", "keys", "deep"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(run), "doc_id long, text_hash long, name binary, n_grams long, keys array<long>, deep array<long>")


def meeting(sorted_labels: DataFrame) -> DataFrame:
    """The rows (tree, key, set) of sorted labels that share trie and shortest prefix with a neighbour.

    The first and the last row of a partition always stay: their neighbours are in another one.
    """

    def run(batches):
        held, before = None, True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            same = np.all([_number(t, c)[1:] == _number(t, c)[:-1] for c in ("tree", "key")], axis=0)
            if len(same):
                yield from t.slice(0, len(same)).filter(pa.array(np.r_[before, same[:-1]] | same)).to_batches()
                before = bool(same[-1])
            held = t.slice(t.num_rows - 1)
        if held is not None:
            yield from held.to_batches()

    return sorted_labels.select("tree", "key", "set").mapInArrow(tidy(run), "tree int, key long, set long")


CELL = ["tree", "key", "i", "j"]


def whole_cells(batches, rows: int = 2048) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells from batches sorted by cell and side, and the first row of each cell."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([_number(t, c)[1:] != _number(t, c)[:-1] for c in CELL], axis=0)
        return np.flatnonzero(new)

    held: list[pa.Table] = []
    for b in _pieces(batches, rows):
        held.append(pa.Table.from_batches([b]))
        t = pa.concat_tables(held)
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
            held = [t.slice(at[-1])]
    if held and sum(x.num_rows for x in held):
        t = pa.concat_tables(held)
        yield t, starts(t)


def _pairs(t: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the cells' pairs: of any two rows, or of two stripes one of each; about PAIRS at a time."""
    side, own = _number(t, "side"), _number(t, "i") == _number(t, "j")
    p, q, n = [], [], 0
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
        edge = lo + int((side[lo:hi] == 0).sum())
        for x in range(lo, hi - 1 if own[lo] else edge):
            y = np.arange(x + 1 if own[lo] else edge, hi)
            p.append(np.full(len(y), x)), q.append(y)
            n += len(y)
            if n >= PAIRS:
                yield np.concatenate(p), np.concatenate(q)
                p, q, n = [], [], 0
    if n:
        yield np.concatenate(p), np.concatenate(q)


def _lists(t: pa.Table, name: str, trees: int) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, trees)


def _prefixes(t: pa.Table, trees: int, shortest: int, levels: list[int]) -> list[np.ndarray]:
    """For each level a key of every row's prefix in every trie (rows x trees)."""
    h, deep = _lists(t, "keys", trees).view(np.uint64), _lists(t, "deep", trees).view(np.uint64)
    out, done = {shortest: h}, shortest
    for d in sorted(levels):
        for k in range(done - shortest, d - shortest):
            level = deep >> np.uint64(56 - 8 * k) & np.uint64(0xFF)
            h = (h ^ (level + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
            h = h ^ (h >> np.uint64(32))
        out[d], done = h, d
    return [out[d] for d in levels]


def needed(t: pa.Table, first: np.ndarray, trees: int, shortest: int, levels: list[int], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs that their cell handles, and the number of the deepest level at which they meet in any trie.

    A pair is handled in the first trie in which it meets, if the sets' sizes allow the similarity.
    """
    prefix, tree, size = _prefixes(t, trees, shortest, levels), _number(t, "tree"), _number(t, "n_grams")
    for p, q in _pairs(t, first):
        for at in range(0, len(p), PAIRS):
            a, b = p[at : at + PAIRS], q[at : at + PAIRS]
            fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
            a, b = a[fits], b[fits]
            here = (prefix[-1][a] == prefix[-1][b]).argmax(axis=1) == tree[a]
            a, b = a[here], b[here]
            level = np.full(len(a), len(levels) - 1)
            for k in range(len(levels) - 2, -1, -1):
                level[(prefix[k][a] == prefix[k][b]).any(axis=1)] = k
            yield a, b, level


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams of all pairs, by products of 0/1 matrices over blocks of n-grams."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    col_a, col_b = np.searchsorted(both, flat_a), np.searchsorted(both, flat_b)
    in_a, in_b = both[np.minimum(col_a, len(both) - 1)] == flat_a, both[np.minimum(col_b, len(both) - 1)] == flat_b
    row_a, col_a, row_b, col_b = row_a[in_a], col_a[in_a], row_b[in_b], col_b[in_b]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[order_a], col_a[order_a], row_b[order_b], col_b[order_b]
    width = 4096
    for at in range(0, len(both), width):
        i, j = np.searchsorted(col_a, [at, at + width]), np.searchsorted(col_b, [at, at + width])
        w = min(width, len(both) - at)
        m, k = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        m[row_a[i[0] : i[1]], col_a[i[0] : i[1]] - at] = 1
        k[row_b[j[0] : j[1]], col_b[j[0] : j[1]] - at] = 1
        out += m @ k.T
    return out


def common_grams(grams: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Numbers of common n-grams of pairs of sorted sets: by search where pairs are few, by matrices where they're many of few sets."""
    a, at_a = np.unique(p, return_inverse=True)
    b, at_b = np.unique(q, return_inverse=True)
    if len(p) > 4 * (len(a) + len(b)):
        return _common([grams[x] for x in a], [grams[x] for x in b])[at_a, at_b]
    out = np.zeros(len(p))
    for k, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        short, long = (grams[x], grams[y]) if len(grams[x]) <= len(grams[y]) else (grams[y], grams[x])
        out[k] = (long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum()
    return out


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n rows the first row that links lead to."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, root[p], root[q])
        np.minimum.at(new, root[q], root[p])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def enough(bands: dict[int, int], depth: int, similarity: float, recall: float, trees: int) -> bool:
    """Whether prefixes of `depth` values reach the recall, by the links found so far in bands of similarity.

    They do if every band in which a link was found meets at this depth with that
    probability, and the other bands, where none was found, hold less than MISSED pairs
    that don't meet (95 % bound: none of 3 / p pairs would be found with probability 0.05).
    """
    chance = [reached(similarity + (1 - similarity) * k / BANDS, depth, trees) for k in range(BANDS)]
    low = [k for k in range(BANDS) if chance[k] < recall]
    return not any(bands.get(k) for k in low) and sum(3 * (1 - chance[k]) / chance[k] for k in low) < MISSED


def join(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> DataFrame:
    """doc_id, class_id, n_links, n_grams, class_key for every row of `docs` (doc_id, text).

    class_id is the smallest doc_id that links lead to; a link joins documents whose
    sets of word n-grams have a Jaccard similarity of `similarity` or more. n_links
    counts a document's linked documents, equal ones included. Every pair that meets
    in the forest is verified exactly; a pair just at the threshold is missed with
    probability 1 - `recall`, nearer ones far less. Texts without a word (null,
    empty) link to nothing. Rows that repeat a doc_id with an equal set count once
    each in n_links. Rows of one doc_id with different sets are told apart and don't
    link these sets; as two classes may then have the same smallest id, class_key
    (a hash, null for rows without a class) names the class itself. Rows with a null
    doc_id have null class and no links. Extra columns are ignored.
    """
    shortest = depth_for(similarity, recall, trees, deepest)
    deepest = min(deepest, shortest + 8)
    levels = levels_of(shortest, deepest)
    wide = cut(signatures(docs, n, trees, shortest, deepest), "signatures")
    some = wide.where("name IS NOT NULL AND doc_id IS NOT NULL")
    reps = some.groupBy("name").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("keys").alias("keys"), F.first("deep").alias("deep"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("set"), "name", "rep.*", "copies", "n_grams", "keys", "deep"), "sets")
    sig = cut(wide.select("doc_id", "name", "n_grams"), "names")
    discard(wide)
    tries = reps.select("set", "deep", F.posexplode("keys").alias("tree", "key")).select("set", "tree", "key", F.get("deep", "tree").alias("deep"))
    rows = cut(meeting(tries.repartitionByRange("tree", "key", "deep", "set").sortWithinPartitions("tree", "key", "deep")), "meeting")
    full = rows.join(reps.select("set", "n_grams").hint("merge"), "set").groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("grams")).where("members > 1")
    stripes = F.greatest(F.ceil(F.col("members") / STRIPE), F.ceil(F.col("grams") / STRIPE_GRAMS))
    full = full.select("tree", "key", F.least(stripes, "members").cast("int").alias("stripes"))
    member = rows.join(full.hint("merge"), ["tree", "key"]).withColumn("stripe", F.pmod(F.xxhash64("set", "tree"), F.col("stripes")).cast("int"))
    with_other = member.select("set", "tree", "key", "stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("other"))
    member = with_other.select("set", "tree", "key", F.least("stripe", "other").alias("i"), F.greatest("stripe", "other").alias("j"), (F.col("stripe") > F.col("other")).cast("int").alias("side"))
    light = reps.select("set", "n_grams", "copies", "keys", "deep").hint("merge")
    in_cells = lambda d: d.repartition(*CELL).sortWithinPartitions(*CELL, "side", "set")

    def need(batches):
        for t, first in whole_cells(batches):
            used = np.zeros((t.num_rows, len(levels)), bool)
            for p, q, level in needed(t, first, trees, shortest, levels, similarity):
                used[p, level] = used[q, level] = True
            row, level = np.nonzero(used)
            yield from t.select(["set", *CELL, "side"]).take(pa.array(row)).append_column("level", pa.array(level, pa.int32())).to_batches()

    wanted = cut(in_cells(member.join(light, "set")).mapInArrow(tidy(need), "set long, tree int, key long, i int, j int, side int, level int"), "needed")
    ids = wanted.select("set").distinct().join(reps.select("set", "name", "doc_id", "text_hash").hint("merge"), "set")

    def grams_of(batches):
        for b in _pieces(batches, 512):
            g = [shingles(x, n) for x in b.column("text").to_pylist()]
            same = pa.array([digest(x) == y for x, y in zip(g, b.column("name").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("set"), pa.array([x.tobytes() for x in g], pa.binary())], ["set", "grams"]).filter(same)

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(ids.hint("merge"), ["doc_id", "text_hash"])
    grams = texts.select("set", "name", "text").mapInArrow(tidy(grams_of), "set long, grams binary").dropDuplicates(["set"])

    def verify(at):
        def run(batches):
            for t, first in whole_cells(batches, 256):
                size, copies = _number(t, "n_grams"), _number(t, "copies")
                read = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("grams")]
                links, bands, ends = np.zeros(t.num_rows, np.int64), np.zeros(BANDS, np.int64), []
                for p, q, level in needed(t, first, trees, shortest, levels, similarity):
                    p, q = p[level == at], q[level == at]
                    if not len(p):
                        continue
                    common = common_grams(read, p, q)
                    union = size[p] + size[q] - common
                    linked = common >= similarity * union - 1e-6
                    p, q, near = p[linked], q[linked], (common / union)[linked]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    bands += np.bincount(np.clip(((near - similarity) / (1 - similarity + 1e-9) * BANDS).astype(int), 0, BANDS - 1), minlength=BANDS)
                    ends.append((p, q))
                if not links.any():
                    continue
                root = forest(t.num_rows, *map(np.concatenate, zip(*ends, strict=True)))
                row = np.flatnonzero(links)
                out = t.select(["set"]).take(pa.array(row)).append_column("links", pa.array(links[row])).append_column("to", t.column("set").take(pa.array(root[row])))
                none = pa.nulls(len(row), pa.list_(pa.int64()))
                yield from out.append_column("bands", none).to_batches()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bands.tolist()], pa.list_(pa.int64()))], ["set", "links", "to", "bands"])

        return run

    used = {r["level"]: r["count"] for r in wanted.groupBy("level").count().collect()}  # one row a level
    found, bands = None, {}
    if used:
        grams = cut(grams.join(light, "set"), "grams")
    for at, depth in enumerate(levels):
        if at in used:
            heavy = wanted.where(F.col("level") == at).drop("level").join(grams.hint("merge"), "set")
            here = cut(in_cells(heavy).mapInArrow(tidy(verify(at)), "set long, links long, to long, bands array<long>").repartition(files(used[at])), "links")
            for r in here.where("bands IS NOT NULL").select(F.posexplode("bands").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():  # one row a band
                bands[r["k"]] = bands.get(r["k"], 0) + r["x"]
            here = here.where("set IS NOT NULL").drop("bands")
            found = here if found is None else found.unionByName(here)
        if enough(bands, depth, similarity, recall, trees):
            break
    own = reps.select("set", "name", "doc_id", "copies")
    if found is None:
        own = own.withColumns({"root": F.col("set"), "links": F.lit(0).cast("long")})
    else:
        classes = components(found.select(F.col("set").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("set"), "root")
        counts = found.groupBy("set").agg(F.sum("links").alias("links"))
        own = own.join(classes, "set", "left").join(counts, "set", "left").withColumns({"root": F.coalesce("root", "set"), "links": F.coalesce("links", F.lit(0).cast("long"))})
    first = own.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("name").alias("first"))
    own = own.join(first, "root").select("name", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.xxhash64("first").alias("class_key"))
    out = sig.select("doc_id", "name", "n_grams").join(own.hint("merge"), "name", "left")
    alone = F.col("doc_id").isNull() | F.col("name").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"), "n_grams", F.when(~alone, F.col("class_key")).alias("class_key"))
