"""Complete-link deduplication of event cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import same_core

AMBIGUOUS = -1


def cluster_cores(proposals: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, stable_id, candidate_id, start, end, confidence, cluster_id, status for every proposal.

    Proposals are taken from the tightest on (then confidence, start, end, id). One
    joins a cluster only if no member comes from the same candidate and it is the
    same occurrence as every member. Exactly one such cluster: it joins, as a
    suppressed duplicate; several: it is an ambiguous bridge and is suppressed
    (cluster_id null); none: it represents a new cluster. Bounds are never united.
    Clusters are numbered from 0 in the order of their representatives.

    The same occurrence means overlap, so a gap in time ends what a proposal can meet:
    each run of overlapping cores is folded apart, as one sorted array in the JVM. The
    windows and the fold share one exchange on the keys.
    """
    length = F.col("end") - F.col("start")
    item = F.struct(length.alias("d"), (-F.col("confidence")).alias("c"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("stable_id").alias("id"), F.col("candidate_id").alias("cand"))
    w = Window.partitionBy(*keys).orderBy(F.least("start", "end"), "stable_id")
    reach = F.max(F.greatest("start", "end")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.least("start", "end") > reach), 1).otherwise(0)
    d = proposals.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    g = d.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = dict(g.dtypes)["items"]
    member = kind.removeprefix("array<").removesuffix(">").removesuffix(">") + ",cid:int>"
    empty = F.array().cast(f"array<{member}>")

    def conflict(m: Column, x: Column) -> Column:
        return (m["cand"] == x["cand"]) | ~same_core(m["s"], m["e"], x["s"], x["e"])

    def step(acc: Column, x: Column) -> Column:
        clusters = F.array_distinct(F.transform(F.filter(acc, lambda m: m["cid"] != AMBIGUOUS), lambda m: m["cid"]))
        against = F.transform(F.filter(acc, lambda m: (m["cid"] != AMBIGUOUS) & conflict(m, x)), lambda m: m["cid"])
        open_ = F.array_except(clusters, against)
        cid = F.when(F.size(open_) == 1, F.element_at(open_, 1)).when(F.size(open_) > 1, F.lit(AMBIGUOUS)).otherwise(F.size(clusters))
        return F.concat(acc, F.array(F.struct(x["d"], x["c"], x["s"], x["e"], x["id"], x["cand"], cid.cast("int")).cast(member)))

    done = g.select(*keys, "_run", F.explode(F.aggregate("items", empty, step)).alias("m"))
    order = F.struct("m.d", "m.c", "m.s", "m.e", "m.id", "m.cand")
    in_run = F.nullif(F.col("m.cid"), F.lit(AMBIGUOUS))
    first = (in_run.isNotNull()) & (F.row_number().over(Window.partitionBy(*keys, "_run", "m.cid").orderBy(order)) == 1)
    d = done.withColumn("_in_run", in_run).withColumn("_first", first)
    number = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    d = d.withColumn("_number", F.when(F.col("_first"), number))
    cluster = F.when(F.col("_in_run").isNotNull(), F.max("_number").over(Window.partitionBy(*keys, "_run", "m.cid")))
    status = F.when(F.col("_in_run").isNull(), "ambiguous_bridge_suppressed").when(F.col("_first"), "representative").otherwise("duplicate_suppressed")
    d = d.withColumn("cluster_id", cluster.cast("int"))
    return d.select(*keys, F.col("m.id").alias("stable_id"), F.col("m.cand").alias("candidate_id"), F.col("m.s").alias("start"), F.col("m.e").alias("end"), (-F.col("m.c")).alias("confidence"), "cluster_id", status.alias("status"))
