"""A training corpus from the documents table, in stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, language, line_dedup, mixing, ngram_join
from chronolith.llm.queries import tokenizer_path
from chronolith.llm.shared import cut, made, release, table

MIN_DOCS = 10


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with another text, and n_chars to match where there is such a column."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """`docs` with its columns that are named like one of `names` under other names, and what selects all of them as they were."""
    taken = {c.lower() for c in docs.columns} | set(names)
    own = []
    for c in docs.columns:
        new = c
        while new.lower() in names or (new != c and new.lower() in taken):
            new += "_"
        taken.add(new.lower())
        own.append(new)
    return docs.toDF(*own), [F.col(f"`{n}`").alias(c) for n, c in zip(own, docs.columns, strict=True)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: not `und` (null text, no letter), not ambiguous between two. Ids play no part, so null and repeated ones don't matter."""
    docs, back = _apart(docs, "lang_pred", "score", "ambiguous")
    found = language.identify(docs)
    return found.where((F.col("lang_pred") != language.UND) & ~F.col("ambiguous")).select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in MIN_DOCS documents stay in the first document only; documents that this leaves without a line with a key go.

    What goes stands in full in other documents: every key keeps its first line, and a document with a kept line stays.
    Rows with one id are one document; rows without an id are one document for each text. Repeated rows keep the same lines.
    """
    docs, back = _apart(docs, "n_lines", "n_dropped")
    bitmaps = line_dedup.keep_bitmaps(docs, MIN_DOCS, keep_first=True)
    out = line_dedup.apply_bitmaps(docs, bitmaps)
    stays = (F.col("n_dropped") == 0) | (F.length(line_dedup.line_key(F.col("text"))) >= 1)
    out = out.where(stays).select(*back)
    return _with_text(out, F.col("text"))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram similarity links: the one with the smallest id, among rows of that id the one with the smallest hash.

    Rows are told apart by a number of their own, not by doc_id: of repeated rows one
    stays, and an id on two texts is decided for each text. Null ids are compared
    too and come after all others. Rows without a word are linked to nothing and stay.
    """
    docs, back = _apart(docs, "_row", "_order", "class_id", "n_links", "n_grams", "class_key")
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = ngram_join.join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "_row")
    ranked = rows.select("_row", order.alias("_order")).join(classes, "_row")
    stays = ranked.groupBy("class_id").agg(F.min("_order").alias("_first")).select(F.col("_first")["_row"].alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*back)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def _rows(docs: DataFrame) -> DataFrame:
    """`docs` with _file and _at, which name a row: its place in the files it was read from, or in a written copy where it wasn't read from files."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return cut(docs.select("*", F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_at")), "rows")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: whole epochs, and the one at a source's budget cut at its last word.

    Rows are told apart by their place, so null and repeated ids and repeated rows each get what the mix gives them.
    """
    columns = docs.columns
    docs, back = _apart(_rows(docs), "_taken", "_size", "_texts", "_one")
    mixed = mixing.mix(docs, carry=["_file", "_at"]).where("taken > 0")
    taken = mixed.select("_file", "_at", F.col("taken").alias("_taken"), F.col("size").alias("_size")).hint("shuffle_hash")
    d = docs.join(taken, ["_file", "_at"])
    part = F.col("_taken") % F.col("_size")
    texts = F.concat(F.array_repeat("text", F.expr("int(_taken div _size)")), F.when(part > 0, F.array(first_words(F.col("text"), part))).otherwise(F.array()))
    d = d.withColumn("_texts", texts).withColumn("_one", F.explode("_texts")).drop("text").withColumnRenamed("_one", "text")
    return _with_text(d.select(*back).select(*columns), F.col("text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, and whether decoding gives the text back."""
    d = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path())
    return d.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_copies", dedup_near_copies),
    ("mix", mix_sources),
    ("bpe", tokenize),
]

#: Neither the similarity forest nor the token automaton can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. A stage's own tables, and the stage before it, are deleted once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    before = made()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, 1)
    return STAGES[-1][1](spark, docs, sf_dir)
