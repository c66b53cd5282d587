"""Line dedup in DataFrame operations only.

Lines are reduced to 128-bit hashes of their keys, which are range-partitioned and
sorted by hash, document and position. Equal keys then lie side by side in one
partition, and windows stream over the sorted run in place: how many documents hold
the key, and which line of it is the first. Keys that make up a noticeable share of
all lines would crowd one partition; a sketch finds them beforehand (few, whatever the
table's size) and they are counted apart, exactly, with partial sums. What comes back is a
keep bitmap per document, compressed to the runs of kept lines; texts are only touched
when a bitmap is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, numbered, renamed

SPACE = " \t\n\x0b\x0c\r"
MIN_DOCS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = ("doc_id", "text_hash")
#: Keys with more than this share of all lines are counted apart; the sketch tracks HOT_TRACKED of them with an error well below the share.
HOT_SHARE = 1 / 512
HOT_TRACKED = 4096


def lines_of(text: Column) -> Column:
    """The text cut at \\n; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, text_hash, pos of every line with a key."""
    d = _rows(docs).select(*ROW, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    d = d.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= 1)
    return cut(d.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *ROW, "pos"), "line-hashes")


def hot_hashes(lines: DataFrame, share: float = HOT_SHARE, tracked: int = HOT_TRACKED) -> list[int]:
    """The values of h1 that may have more than `share` of all lines: no such value is missing, and there are 2 / share at most."""
    r = lines.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {int(2 / share)}, {tracked})").alias("top")).first()
    return [x["item"] for x in r["top"] or [] if x["item"] is not None and x["count"] > share * r["n"]]


def dropped_lines(lines: DataFrame, min_docs: int, keep_first: bool, hot: list[int]) -> DataFrame:
    """doc_id, text_hash, pos of the lines that go."""
    key = ("h1", "h2")
    same_doc = lambda id_, hash_: id_.eqNullSafe(F.col("doc_id")) & (F.col("doc_id").isNotNull() | hash_.eqNullSafe(F.col("text_hash")))
    cold = lines.where(~F.col("h1").isin(hot)) if hot else lines
    cold = cold.repartitionByRange(*key).sortWithinPartitions(*key, *ROW, "pos")
    run = Window.partitionBy(*key).orderBy(*ROW, "pos")
    again = F.coalesce(same_doc(F.lag("doc_id").over(run), F.lag("text_hash").over(run)) & (F.row_number().over(run) > 1), F.lit(False))
    cold = cold.withColumn("again", again).withColumn("place", F.rank().over(run))
    cold = cold.withColumn("n_docs", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy(*key)))
    gone = cold.where((F.col("n_docs") >= min_docs) & ((F.col("place") > 1) if keep_first else F.lit(True))).select(*ROW, "pos")
    if not hot:
        return gone
    warm = lines.where(F.col("h1").isin(hot))
    of = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    by_doc = warm.groupBy(*key, "doc_id", of.alias("of")).agg(F.min(F.struct(*ROW, "pos")).alias("first"))
    keys = by_doc.groupBy(*key).agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs)
    hit = warm.join(cut(keys, "line-keys"), list(key))
    if keep_first:
        hit = hit.where(~F.struct(*ROW, "pos").eqNullSafe(F.col("first")))
    return gone.unionByName(hit.select(*ROW, "pos"))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_dropped, kept_runs for every document that loses a line.

    Keys found in at least `min_docs` documents lose all their lines, or with
    `keep_first` all but the first by document and position. kept_runs is the
    bitmap as runs of kept lines (first line, number of lines); the last run is
    open-ended (null), as the bitmap doesn't need to know the document's length.
    Rows of one doc_id count as one document; rows with a null doc_id count as
    one document per text.
    """
    lines = line_hashes(docs)
    gone = dropped_lines(lines, min_docs, keep_first, hot_hashes(lines))
    gone = gone.groupBy(*ROW).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    run = lambda a, n: F.struct(a.cast("int").alias("start"), n.cast("int").alias("n"))
    before = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.col("gone"), lambda a, b: F.when(b - a > 1, run(a + 1, b - a - 1)))
    runs = F.concat(F.filter(before, lambda x: x.isNotNull()), F.array(run(F.element_at("gone", -1) + 1, F.lit(None))))
    return cut(gone.select(*ROW, F.size("gone").cast("long").alias("n_dropped"), runs.alias("kept_runs")), "line-bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of `docs` with the text that its bitmap leaves, n_lines before and n_dropped (which replace columns of these names).

    A document without a bitmap keeps its text (null stays null). Bitmaps come from a
    table, so their size is known: small ones are broadcast and texts don't move;
    others are the built side of a hash join, so texts aren't sorted.
    """
    d, at = numbered(docs)
    b = bitmaps.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("n_dropped").alias("n"), F.col("kept_runs").alias("runs"))
    large = int(str(b._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > int(docs.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    b = b.hint("shuffle_hash") if large else b
    text = F.col(at["text"])
    d = d.withColumn("own", F.xxhash64(text)).join(b, F.col(at["doc_id"]).eqNullSafe(F.col("d")) & (F.col("own") == F.col("h")), "left").withColumn("lines", lines_of(text))
    kept = F.transform("runs", lambda r: F.slice("lines", r["start"] + 1, F.coalesce(r["n"], F.size("lines"))))
    new = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n"))
    return d.select(*renamed(docs, [F.size("lines").cast("long"), F.coalesce("n", F.lit(0).cast("long"))], ["n_lines", "n_dropped"], {"text": new}))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """`docs` without the lines of common keys, plus n_lines and n_dropped.

    Null and empty texts are one line without a key and stay as they are; a text
    that loses all its lines becomes ''. Extra columns pass through, whatever their
    names, but columns named n_lines or n_dropped are replaced.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_docs, keep_first))


ORACLE_SQL = r"""
WITH l AS (SELECT rid, doc_id, who, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
           FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null ' || md5(text)) AS who, row_number() OVER () AS rid FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT who) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY rid
"""
