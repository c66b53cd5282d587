"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, files


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to the smallest of its neighbours and itself."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = both.join(least, "a")
    new = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component, for edges (a, b) of any type that can be ordered; nodes without edges to others are absent.

    Every round is written to the shared folder, in few files if edges are few (no
    round has more than the one before); the rounds grow with the logarithm of the
    longest path. `edges` are counted first, so they should be stored.
    """
    rows = edges.count()
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().coalesce(files(rows)), "edges")
    before = None
    for _ in range(most_rounds):
        e = cut(_star(_star(e, True), False).coalesce(files(rows)), "edges")
        s = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(s) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, rows = tuple(s), s[0]
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
