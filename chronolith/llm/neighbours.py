"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are scaled to length one and rotated by a fixed random rotation, so a prefix
of a vector's dimensions is a random projection of it. They're dealt into lists by
nearest centroid (k-means on a bounded sample); the lists' number grows with the
square root of the rows. A query probes its nearest lists; in a list, partial
distances grow block of columns by block of columns, and a candidate is given up as
soon as a hypothesis test says that its whole distance exceeds the query's k-th best.
The nearest list is scanned first; the bound found there goes with the query to its
other lists. Survivors are scored on the original vectors in double precision.

Equal vectors are one candidate with its smallest ids: only k + 1 of them can appear
in a result, so a vector that makes up a third of the rows costs as much as any
other. Lists are cut into chunks of bounded size, one task's worth each; a task holds
a chunk and streams the queries that probe it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, smallest_hashes

EVERY = 50
K = 5
#: Bounds of the index: lists, and rows a list of the sample that centroids, and the number of probed lists, are fitted on (the sample has LEAST_SAMPLE rows at least).
MOST_LISTS = 16_384
SAMPLE_A_LIST = 16
LEAST_SAMPLE = 8192
#: Candidates in a task, and queries that one task streams past them.
CHUNK = 4096
QUERY_CHUNK = 65_536
BLOCK = 16
#: A candidate goes if its partial distance, scaled up, exceeds the bound by EPSILON / sqrt(dimensions seen).
EPSILON = 2.1
COVER = 0.99
#: Distances computed at once.
CELLS = 1 << 21


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each (an exact product) that brings their largest component near 1, so squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    dim: int
    turn: np.ndarray
    centroids: np.ndarray
    probes: int


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c that is nearest to each row of x, block by block."""
    step = max(1, CELLS // len(c))
    return np.concatenate([(x[a : a + step] @ c.T).argmax(axis=1) for a in range(0, len(x), step)])


def fit(sample: np.ndarray, n_rows: int, k: int = K, cover: float = COVER) -> Index:
    """Centroids by k-means (about sqrt(n_rows) of them, MOST_LISTS at most and SAMPLE_A_LIST sample rows each at least) and the number of lists that holds `cover` of the sample's true neighbours."""
    dim = sample.shape[1]
    turn = rotation(dim)
    x = unit(sample.astype(np.float64)) @ turn
    n = int(max(1, min(MOST_LISTS, np.sqrt(n_rows), len(x) // SAMPLE_A_LIST)))
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(12):
        own = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=n) > 0
        c[full] = unit(sums[full] + 1e-12)
    own = _nearest(x, c)
    q = x[: min(512, len(x))]
    step = max(1, CELLS // len(q))
    best, top = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
    for a in range(0, len(x), step):
        near = q @ x[a : a + step].T
        mine = np.arange(a, min(a + step, len(q)))
        near[mine, mine - a] = -2
        best, top = np.hstack([best, near]), np.hstack([top, np.broadcast_to(np.arange(a, a + near.shape[1]), near.shape)])
        pick = np.argsort(-best, axis=1)[:, :k]
        best, top = np.take_along_axis(best, pick, 1), np.take_along_axis(top, pick, 1)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)  # query x list -> rank of the list
    ranks = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(cover * len(ranks)))]) + 1 if len(ranks) else n
    return Index(dim, turn, c, probes)


def _leads(i: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k pairs with the smallest partial distance, side by side, of every query that has k (i ascends)."""
    order = np.lexsort((part, i))
    first = np.searchsorted(i, i)
    many = np.searchsorted(i, i, "right") - first >= k
    return order[(np.arange(len(i)) - first < k) & many]


def scan(queries: np.ndarray, candidates: np.ndarray, k: int, bound: np.ndarray | None = None, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the adaptive scan keeps, in order of queries: for each query the nearest k candidates within its bound (a squared distance), up to the tests' error, and some more. All are unit and rotated.

    The first block is one product of matrices; later ones are computed for surviving
    pairs only. After each block the whole distances of the k that lead tighten the bound.
    """
    dim, found = candidates.shape[1], []
    bound = np.full(len(queries), np.inf) if bound is None else bound.astype(float)
    step = max(1, CELLS // max(1, len(candidates)))
    head = candidates[:, :block]
    norms = (head * head).sum(axis=1)
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        part = norms + (q[:, :block] ** 2).sum(axis=1)[:, None] - 2 * (q[:, :block] @ head.T)
        top = bound[a : a + step]
        if len(candidates) > k:
            lead = np.argpartition(part, k - 1, axis=1)[:, :k]
            whole = ((candidates[lead] - q[:, None]) ** 2).sum(axis=2).max(axis=1)
            top = np.minimum(top, whole)
        seen = min(dim, block)
        test = lambda seen: 1.0 if seen == dim else (1 + epsilon / np.sqrt(seen)) ** 2 * seen / dim
        i, j = np.nonzero(part <= (top * test(seen) * (1 + 1e-9) + 1e-12)[:, None])
        part = part[i, j]
        for at in range(block, dim, block):
            d = candidates[j, at : at + block] - q[i, at : at + block]
            part = part + np.einsum("ij,ij->i", d, d)
            seen = min(dim, at + block)
            keep = part <= top[i] * test(seen) * (1 + 1e-9) + 1e-12
            i, j, part = i[keep], j[keep], part[keep]
            leads = _leads(i, part, k)
            if len(leads):
                whole = part[leads] if seen == dim else ((candidates[j[leads]] - q[i[leads]]) ** 2).sum(axis=1)
                np.minimum.at(top, i[leads[::k]], whole.reshape(-1, k).max(axis=1))
        keep = part <= top[i] * (1 + 1e-9) + 1e-12 if dim > block else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        found.append((i + a, j))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, in double precision, each row in one order of summation."""
    a, b = scaled(a), scaled(b)
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1)))


def _vectors(column) -> np.ndarray:
    n = len(column)
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _members(df: DataFrame, k: int) -> DataFrame:
    """One row for each different vector: h (two hashes that name it), embedding, ids (its k + 1 smallest). Only k + 1 ids of a vector leave a partition."""
    named = df.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))
    rank = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    ids = named.select("h", "g", "vec_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    ids = ids.groupBy("h", "g").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return named.groupBy("h", "g").agg(F.first("embedding").alias("embedding")).join(ids, ["h", "g"]).select("h", "g", "embedding", "ids")


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of rows with an id and a vector that is neither null, empty nor zero and holds only finite components."""
    e = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return d.where(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


ROW = "list int, chunk int, part int, query_id long, bound double, embedding array<double>, ids array<long>"
FOUND = "query_id long, vec_id long, score double"


def _streamed(k: int, turn: np.ndarray):
    """A function over rows sorted by (list, chunk, part, query_id), candidates (no query_id) first: it holds a chunk and streams its queries."""

    def best(q: np.ndarray, ids: list[int], bound: np.ndarray, x: np.ndarray, turned: np.ndarray, members: list[list[int]]) -> list[tuple[int, int, float]]:
        i, j = scan(unit(q) @ turn, turned, k + 1, bound)
        score, rows = cosine(q[i], x[j]), []
        edges = np.searchsorted(i, np.arange(len(q) + 1))
        for a, lo, hi in zip(ids, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = sorted((-s, v) for s, c in zip(score[lo:hi].tolist(), j[lo:hi].tolist(), strict=True) for v in members[c] if v != a)
            rows += [(a, v, -s) for s, v in own[:k]]
        return rows

    def run(batches):
        cell, held, x, turned, members = None, [], None, None, []
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("list", "chunk", "part")], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                part, own = b.slice(lo, hi - lo), tuple(key[lo].tolist())
                if own != cell:
                    cell, held, x = own, [], None
                cut_at = part.column("query_id").null_count  # candidates come first
                if cut_at:
                    held.append(part.slice(0, cut_at))
                if cut_at == part.num_rows or not held:
                    continue
                if x is None:
                    x = np.concatenate([_vectors(h.column("embedding")) for h in held])
                    turned, members = unit(x) @ turn, [v for h in held for v in h.column("ids").to_pylist()]
                asked = part.slice(cut_at)
                rows = best(_vectors(asked.column("embedding")), asked.column("query_id").to_pylist(), asked.column("bound").to_numpy(), x, turned, members)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def _search_of_one_length(d: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, vec_id, score of what the queries find, several rows a pair; all vectors are of one length."""
    spark = d.sparkSession
    groups = cut(_members(d, k), "vectors")
    n_groups = groups.count()
    size = max(LEAST_SAMPLE, SAMPLE_A_LIST * int(min(MOST_LISTS, np.sqrt(n_groups))))
    lowest = smallest_hashes(groups, F.xxhash64("h"), size)
    sample = lowest.orderBy(F.xxhash64("h"), "g").limit(size).select("embedding").toArrow()
    index = fit(_vectors(sample.column("embedding")), n_groups, k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        m = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest(unit(_vectors(b.column("embedding"))) @ m.turn, m.centroids), pa.int32())], [*b.schema.names, "list"])

    lists = cut(groups.mapInArrow(assign, "h long, g long, embedding array<double>, ids array<long>, list int"), "lists")
    sizes = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}  # one row a list
    chunks = {i: -(-n // CHUNK) for i, n in sizes.items()}

    def probe(first: bool):
        def run(batches):
            m = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                near = unit(_vectors(b.column("embedding"))) @ m.turn @ m.centroids.T
                order = np.argsort(-near, axis=1, kind="stable")
                rows, cells, parts = [], [], []
                for i in range(b.num_rows):
                    seen = got = 0
                    for one in order[i].tolist():
                        if one not in sizes:
                            continue
                        if seen >= m.probes and got > 4 * k:
                            break
                        if first == (seen == 0):
                            n = chunks[one]
                            rows += [i] * n
                            cells += [one] * n
                            parts += range(n)
                        seen, got = seen + 1, got + sizes[one]
                        if first:
                            break
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int32()), *(b.column(c).take(at) for c in ("query_id", "bound", "embedding"))], ["list", "chunk", "query_id", "bound", "embedding"])

        return run

    def pairs(numbers: dict[int, int]) -> Column:
        known = [F.lit(v) for i, n in numbers.items() if n > 1 for v in (i, n)]
        return F.coalesce(F.try_element_at(F.create_map(*known), F.col("list")), F.lit(1)) if known else F.lit(1)

    candidates = lists.withColumn("chunk", F.pmod(F.xxhash64("g", F.lit(3)), pairs(chunks)).cast("int"))

    def asked(queries: DataFrame, first: bool) -> DataFrame:
        probes = queries.mapInArrow(probe(first), "list int, chunk int, query_id long, bound double, embedding array<double>")
        if queries.count() * (1 if first else index.probes) > QUERY_CHUNK:
            probes = cut(probes, "probes")
            counts = probes.groupBy("list", "chunk").count().groupBy("list").agg(F.max("count").alias("n")).collect()  # one row a list
            parts = pairs({r["list"]: -(-r["n"] // QUERY_CHUNK) for r in counts})
        else:
            parts = F.lit(1)
        probes = probes.withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int")).withColumn("ids", F.lit(None).cast("array<long>"))
        held = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        held = held.select("list", "chunk", "part", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("bound"), "embedding", "ids")
        rows = held.unionByName(probes).repartition("list", "chunk", "part").sortWithinPartitions("list", "chunk", "part", F.col("query_id").asc_nulls_first())
        return rows.mapInArrow(_streamed(k, index.turn), FOUND)

    queries = cut(d.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")), "queries")
    near = cut(asked(queries.withColumn("bound", F.lit(float("inf"))), True), "nearest-list")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(F.col("rank") == k)
    kth = kth.select("query_id", (2 - 2 * F.col("score") + F.lit(1e-9)).alias("bound"))
    rest = queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return near.unionByName(asked(rest, False))


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by cosine that are found for each row whose id is divisible by `every`, ties to the smaller id.

    Unusable vectors (see `usable`) take no part. Vectors of different lengths aren't
    compared: each length has an index and neighbours of its own (a few lengths, one after the other).
    Rows that repeat an id with the same vector count once; with different ones the id
    is as near as its nearest, and asks with the smallest. With k candidates or fewer,
    all are returned: probing goes on until the lists hold enough. Very large and very
    small components neither overflow nor vanish. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    d = usable(vectors).withColumn("n", F.size("embedding"))
    found = spark.createDataFrame([], FOUND)
    for r in d.groupBy("n").count().orderBy("n").collect():  # one row a length
        found = found.unionByName(_search_of_one_length(d.where(F.col("n") == r["n"]).drop("n"), k, every))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
