"""One-to-one matching of truth and predictions.

Edges are an equi-join on the group and a bucket of time, with the interval predicate
as residual. A group's edges are cut into runs that no edge links (gaps in time), which
are matched apart. A run with one true event or one prediction is settled by an
aggregate; only the others reach Python, many runs in a batch, one row each. The search
is a successive shortest-path assignment: most matches first, then most IoU.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import contains, iou

SCALE = 1_000_000_000
#: Width of the buckets of time, and how many of them an interval may span; longer ones are few and joined on the group alone.
BUCKET_SECONDS = 60.0
MOST_BUCKETS = 512


def _side(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.col("pos").alias(f"{name}_pos"))


def _pairs(truth: DataFrame, predictions: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Pairs of overlapping or touching intervals of a group that `keep` keeps; each pair is found in the first bucket that both are in."""
    t, p = _side(truth, keys, "t"), _side(predictions, keys, "p")
    long = lambda x: ~F.coalesce(F.col(f"{x}_end") - F.col(f"{x}_start") <= BUCKET_SECONDS * MOST_BUCKETS, F.lit(False))
    at = lambda x, end: F.floor(F.col(f"{x}_{end}") / BUCKET_SECONDS)
    first = lambda x: F.least(at(x, "start"), at(x, "end"))
    dealt = lambda d, x: d.where(~long(x)).withColumn(f"_{x}", first(x)).withColumn("_bucket", F.explode(F.sequence(first(x), at(x, "end"))))
    near = dealt(t, "t").join(dealt(p, "p"), [*keys, "_bucket"]).where(F.col("_bucket") == F.greatest("_t", "_p"))
    near = near.drop("_bucket", "_t", "_p")
    far = t.where(long("t")).join(p, keys).unionByName(t.where(~long("t")).join(p.where(long("p")), keys))
    return near.unionByName(far).where(keep)


def iou_edges(truth: DataFrame, predictions: DataFrame, keys: list[str], least: float = C.MATCH_IOU) -> DataFrame:
    """keys, t_*, p_*, iou of pairs with an IoU of at least `least`. Both sides have start, end, pos."""
    share = iou(F.col("t_start"), F.col("t_end"), F.col("p_start"), F.col("p_end"))
    return _pairs(truth, predictions, keys, share >= least).withColumn("iou", share)


def coverage_edges(truth: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs in which the clip contains the true event."""
    return _pairs(truth, clips, keys, contains(F.col("p_start"), F.col("p_end"), F.col("t_start"), F.col("t_end")))


def best_matching(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of a matching with most pairs and, among those, most weight; edges are (left, right, weight)."""
    out: dict[int, dict[int, int]] = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    while True:
        dist: dict[int, int] = {a: 0 for a in sorted(out) if a not in left}
        came: dict[int, int] = {}
        queue = sorted(dist)
        while queue:  # label-correcting search over alternating paths
            again = []
            for a in queue:
                for b, w in sorted(out[a].items()):
                    if left.get(a) == b:
                        continue
                    d = dist[a] - w
                    c = right.get(b)
                    if c is None:
                        key = -1 - b
                        if d < dist.get(key, SCALE * SCALE):
                            dist[key], came[key] = d, a
                    else:
                        d += out[c][b]
                        if d < dist.get(c, SCALE * SCALE):
                            dist[c], came[c] = d, a
                            again.append(c)
            queue = again
        ends = sorted((dist[k], -1 - k) for k in dist if k < 0)
        if not ends:
            return sorted(left.items())
        b = ends[0][1]
        a = came[-1 - b]
        while True:
            old = left.get(a)
            left[a], right[b] = b, a
            if old is None:
                break
            b, a = old, came[a]


def _runs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, one, edges: a run's edges in order, and if they share an event the best of them."""
    d = edges.withColumns({"_s": F.least("t_start", "p_start"), "_e": F.greatest("t_end", "p_end")})
    w = Window.partitionBy(*keys).orderBy("_s", "_e", "t_pos", "p_pos")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    names = ["t_pos", "p_pos", "t_start", "t_end", "p_start", "p_end", "iou"]
    edge = F.struct(*names)
    weight = F.round(F.col("iou") * SCALE)
    star = (F.min("t_pos") == F.max("t_pos")) | (F.min("p_pos") == F.max("p_pos"))
    best = F.max_by(edge, F.struct(weight, -F.col("t_pos"), -F.col("p_pos")))
    order = F.struct("t_start", "t_end", "t_pos", "p_start", "p_end", "p_pos", weight.cast("long").alias("weight"), "iou")
    return d.groupBy(*keys, "_run").agg(F.when(star, best).alias("one"), F.sort_array(F.collect_list(order)).alias("edges")).drop("_run")


def match(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t_pos, p_pos, t_start, t_end, p_start, p_end, iou, start_error, end_error of each group's best matching."""
    runs = _runs(edges, keys)
    names = ["t_pos", "p_pos", "t_start", "t_end", "p_start", "p_end", "iou"]
    kinds = [f"`{c}` {k}" for c, k in edges.dtypes if c in keys]

    def solve(batches):
        for b in batches:
            row, picked = [], []
            for i, own in enumerate(b.column("edges").to_pylist()):
                chosen = set(best_matching([(e["t_pos"], e["p_pos"], e["weight"]) for e in own]))
                for k, e in enumerate(own):
                    if (e["t_pos"], e["p_pos"]) in chosen:
                        row.append(i), picked.append(k)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int32())) for c in keys), pa.array(picked, pa.int32()), b.column("edges").take(pa.array(row, pa.int32()))], [*keys, "k", "edges"])

    kind = dict(runs.dtypes)["edges"]
    hard = runs.where("one IS NULL").select(*keys, "edges").mapInArrow(solve, ", ".join([*kinds, "k int", f"edges {kind}"]))
    hard = hard.select(*keys, F.get("edges", "k").alias("e")).select(*keys, *(F.col(f"e.{c}") for c in names))
    d = runs.where("one IS NOT NULL").select(*keys, *(F.col(f"one.{c}") for c in names)).unionByName(hard)
    return d.withColumn("start_error", F.abs(F.col("p_start") - F.col("t_start"))).withColumn("end_error", F.abs(F.col("p_end") - F.col("t_end")))


def matching_size(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matches long: the size of a largest one-to-one matching."""
    runs = _runs(edges.withColumn("iou", F.lit(0.0)), keys)
    kinds = [f"`{c}` {k}" for c, k in edges.dtypes if c in keys]

    def solve(batches):
        for b in batches:
            sizes = [len(best_matching([(e["t_pos"], e["p_pos"], 0) for e in own])) for own in b.column("edges").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(sizes, pa.int64())], [*keys, "n"])

    hard = runs.where("one IS NULL").select(*keys, F.transform("edges", lambda e: F.struct(e["t_pos"].alias("t_pos"), e["p_pos"].alias("p_pos"))).alias("edges")).mapInArrow(solve, ", ".join([*kinds, "n long"]))
    each = runs.where("one IS NOT NULL").select(*keys, F.lit(1).cast("long").alias("n")).unionByName(hard)
    return each.groupBy(*keys).agg(F.sum("n").alias("matches"))
