"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to cells of about equally many rows: a value's share of
rows that sort before it, so a source with a third of all rows spans a third of its
axis. Rows are range-sorted by curve index, then text checksum, then id, which splits
even a cell that holds most rows. Ranks over the sorted table come from one row count
per partition, and the order is cut into runs whose counts differ by one at most.
Shards then cover small boxes of the metadata space, which lets a reader prune whole
shards on any of the dimensions. Equal texts with equal metadata lie side by side, so a
group of them is cut only at a shard's edge; equal texts whose metadata differ lie
apart, as the curve goes first and the counts must stay even.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, numbered, renamed

SHARDS = 40
BITS = 8
ROW_BYTES = 16


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Indices on the Hilbert curve of points (n x d unsigned integers below 2**bits), by John Skilling's transposition (2004)."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> b & 1)
    return out


def with_cells(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """`df` with a column cell_<dim> for each dimension: the share of rows with smaller values (null first), in 2**bits steps.

    One row per distinct value is counted and joined back. The running count over
    the values is taken within slices of the values' order and then over the slices,
    so a dimension with as many values as rows isn't sorted in one task.
    """
    for c in dims:
        counts = cut(df.groupBy(F.col(f"`{c}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).repartitionByRange("value").sortWithinPartitions("value").withColumn("slice", F.spark_partition_id()), "cells")
        slices = counts.groupBy("slice").agg(F.sum("n").alias("slice_n"))
        slices = slices.select("slice", F.coalesce(F.sum("slice_n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("slice_n").over(Window.partitionBy()).alias("total"))
        inside = Window.partitionBy("slice").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = counts.join(slices, "slice").select(F.col("value").alias(f"value_{c}"), F.floor((F.col("ahead") + F.sum("n").over(inside) - F.col("n")) * F.lit(1 << bits) / F.col("total")).cast("int").alias(f"cell_{c}"))
        df = df.join(cells, F.col(f"`{c}`").eqNullSafe(F.col(f"value_{c}")), "left").drop(f"value_{c}")
    return df


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return index(*cells)


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """`df` with curve long, shard int and slot long (0, 1, ... within the shard).

    Rows are ordered by curve index over `dims`, then `ties`; shard counts differ by
    one at most (some are empty where there are fewer rows than shards). Null values
    sort first in their dimension; rows equal in all of these are interchangeable.
    Other columns pass through, whatever their names; those named curve, shard or slot
    are replaced. Bytes, not rows, aren't balanced. An empty table gives an empty result.
    """
    d, at = numbered(df)
    dims, order = [at[c.lower()] for c in dims], ["curve", *(at[c.lower()] for c in ties)]
    d = with_cells(d, dims, bits).withColumn("curve", curve_index([F.col(f"cell_{c}") for c in dims], bits)).drop(*(f"cell_{c}" for c in dims))
    d = cut(d, "curve")
    d = cut(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()), "curve-sorted")
    slices = d.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    slices = slices.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("slice").orderBy(*order)) - 1
    d = d.join(slices, "slice").withColumn("place", place)
    small, more = F.expr(f"total div {n_shards}"), F.col("total") % n_shards
    edge = more * (small + 1)
    shard = F.when(F.col("place") < edge, F.expr(f"place div (total div {n_shards} + 1)")).otherwise(more + F.expr(f"try_divide(place - (total % {n_shards}) * (total div {n_shards} + 1), total div {n_shards})").cast("long"))
    d = d.withColumn("shard", shard.cast("int"))
    start = F.when(F.col("shard") <= more, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - more) * small)
    return d.select(*renamed(df, [F.col("curve"), F.col("shard"), F.col("place") - start], ["curve", "shard", "slot"]))


def document_shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve, lang, source of every row of `docs`.

    Size: UTF-8 bytes of the text (null: none) plus 16. Dimensions: lang, source, size.
    """
    d = docs.select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    d = hilbert_shards(cut(d, "shard-rows"), ["lang", "source", "size"], ["text_crc32", "doc_id"], n_shards)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "lang", "source")


def prunable(sharded: DataFrame, column: str, value) -> DataFrame:
    """shard and whether its range of `column` rules out `value`: what a reader with min/max statistics skips."""
    lo, hi = F.min(column), F.max(column)
    return sharded.groupBy("shard").agg((~((lo <= F.lit(value)) & (hi >= F.lit(value)))).alias("skipped"))
