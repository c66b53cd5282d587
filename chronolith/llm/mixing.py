"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key of its id and text. Equal rows, which have equal
keys, are one row with a count. Within a source the key's range is cut into equal
slices of some thousand rows (uniform keys need no sampled splitters), slices are
summed, a running sum over the slice sums gives each slice its offset, and a running
sum within the slice gives each document the interval of tokens it covers. A source's
budget then cuts that line of intervals at an exact token; whole epochs repeat every
document first. No task ever holds more than a slice, however large its source is or
however often a row is repeated.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SLICE_ROWS = 8192
KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the same on every run and engine; null counts as ''."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source of `sizes` (source, size, and copies if rows stand for several): n_rows, source_size, sidx, weight, target.

    Weights repeat over the sources in code-point order, null last. Targets sum
    to `share_percent` of all tokens, none above `most` times its source's size:
    with sources ordered by size over weight those at the limit are a prefix,
    found by running sums in exact integers. The window runs over one row per source.
    """
    dec = "decimal(38,0)"
    tokens = F.col("size") * F.col("copies") if "copies" in sizes.columns else F.col("size")
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(tokens).alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    per = per.withColumn("sidx", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sidx") % len(weights) + 1))
    whole = Window.partitionBy()
    order = Window.orderBy((F.col("source_size").cast(dec) * (F.lit(lcm(*weights)) / F.col("weight")).cast("int")).asc(), "sidx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nil = F.lit(0).cast(dec)
    per = (
        per.withColumn("pos", F.row_number().over(order))
        .withColumn("num", F.lit(share_percent).cast(dec) * F.sum("source_size").over(whole) - 100 * most * F.coalesce(F.sum("source_size").over(before).cast(dec), nil))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("source_size").cast(dec) * 100 * most * F.col("rest") <= F.col("weight") * F.col("num"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("pos", "num", "rest"))).over(whole)
    free = (F.col("weight") * level["num"]).cast("double") / (100 * level["rest"]).cast("double")
    return per.select("source", "sidx", "n_rows", "source_size", "weight", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(free).alias("target"))


NAMES = ["doc_id", "size", "source_size", "target", "taken", "source", "token_start"]


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS, slice_rows: int = SLICE_ROWS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, token_start of every row of `docs`.

    `taken` is the number of tokens the mix reads from the row: whole epochs
    times its size, plus its part of the last epoch up to the source's budget
    (the target's whole tokens), so a source's taken tokens equal its budget.
    Null text or no words: size 0, taken 0. A null source is a source. Repeated
    rows count as often as they stand, side by side on their source's line of tokens.
    Only doc_id, text, source and the columns in `carry` are read; the latter (of types
    that can be grouped by) pass through, whatever their names, unless they are named
    like a result column. An empty table gives an empty result. The targets come from
    windows over one row per source.
    """
    carry = [c for c in carry or [] if c.lower() not in NAMES]
    more = [f"c{i}" for i in range(len(carry))]
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key"), *(F.col(f"`{c}`").alias(m) for c, m in zip(carry, more, strict=True)))
    sizes = cut(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    per = cut(source_targets(sizes, weights, share_percent, most), "mix-sources").withColumnRenamed("source", "src")
    slices = F.ceil(F.col("n_rows") / F.lit(slice_rows)).cast("long")
    keyed = sizes.join(per, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    keyed = keyed.withColumn("slice", F.shiftright(F.shiftright("key", KEY_BITS - 32) * slices, 32)).withColumn("tokens", F.col("size") * F.col("copies"))
    sums = keyed.groupBy("sidx", "slice").agg(F.sum("tokens").alias("slice_size"))
    before = Window.partitionBy("sidx").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sidx", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sidx", "slice").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(offsets, ["sidx", "slice"]).withColumn("first", F.col("offset") + F.sum("tokens").over(inside) - F.col("tokens"))
    budget = F.floor("target").cast("long")
    placed = placed.withColumn("epochs", F.coalesce(F.expr("try_divide(floor(target), source_size)").cast("long"), F.lit(0).cast("long")))
    placed = placed.withColumn("left_over", budget - F.col("epochs") * F.col("source_size"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    if (sizes.agg(F.max("copies")).first()[0] or 0) > slice_rows:  # rows that are repeated very often are dealt out in runs before they're written out
        runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / slice_rows))))
        placed = runs.repartition("key", "doc_id", "run")
        copies = F.explode(F.sequence(F.col("run") * slice_rows, F.least(F.col("copies"), (F.col("run") + 1) * slice_rows) - 1))
    out = placed.withColumn("copy", copies).withColumn("token_start", F.col("first") + F.col("copy") * F.col("size"))
    part = F.least(F.greatest(F.col("left_over") - F.col("token_start"), F.lit(0).cast("long")), F.col("size"))
    out = out.withColumn("taken", F.col("epochs") * F.col("size") + part)
    return out.select(*NAMES, *(F.col(m).alias(c) for c, m in zip(carry, more, strict=True)))


ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS key FROM documents),
p AS (SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS sidx FROM s GROUP BY source),
w AS (SELECT *, CASE sidx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * (10 // weight), sidx) AS pos FROM w),
n AS (SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
      sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM o),
f AS (SELECT *, source_size * 200 * rest <= weight * num AS capped FROM n),
l AS (SELECT num, rest FROM f WHERE NOT capped ORDER BY pos LIMIT 1),
t AS (SELECT f.source, f.sidx, f.source_size::BIGINT AS source_size,
      CASE WHEN capped THEN (2 * f.source_size)::DOUBLE ELSE (f.weight * l.num)::DOUBLE / (100 * l.rest)::DOUBLE END AS target FROM f LEFT JOIN l ON true),
k AS (SELECT s.*, t.sidx, t.source_size, t.target, floor(t.target)::BIGINT AS budget
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, (sum(size) OVER (PARTITION BY sidx ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS token_start,
      CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - token_start, 0), size))::BIGINT AS taken, source, token_start
FROM r
"""
