"""Tables cut out of a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a stored table of a few numbers a row that one file may hold.
FILE_ROWS = 1 << 18

_made: list[str] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset: a folder of our own in local mode, where one machine holds all; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="chronolith-"))
        base = _own[0]
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Later stages then start from files that survive a lost executor, and what
    follows isn't computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronolith-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def files(rows: int) -> int:
    """How many partitions, and so files, a table of at most so many short rows is stored in: on local disks each file also starts processes that set its mode."""
    return max(1, -(-rows // FILE_ROWS))


def discard(df: DataFrame) -> None:
    """Delete a table that `cut` wrote and returned; nothing may read it any more."""
    spark, path = df.sparkSession, df._cut_path
    _made.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that `cut` wrote in this process after its first `since`, but for the last `keep`; call it once results are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    return sum(bool(path.getFileSystem(conf).delete(path, True)) for path in map(jvm.org.apache.hadoop.fs.Path, gone))


def made() -> int:
    """How many tables `cut` has written that aren't released."""
    return len(_made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zeros(h: Column) -> Column:
    """Leading zeros of the place of a 64-bit hash among all hashes, 60 at most."""
    place = (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.floor(-F.log2(F.greatest(place, F.lit(2.0**-60)))).cast("int")


def hash_counts(df: DataFrame, h: Column, of: Column | None = None) -> dict:
    """Rows by leading zeros of their hash, for each value of `of`: at most 61 numbers a value."""
    counts: dict = {}
    for r in df.groupBy((F.lit("") if of is None else of).alias("g"), _zeros(h).alias("z")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["g"], {})[r["z"]] = r["n"]
    return counts


def smallest_hashes(df: DataFrame, h: Column, want: int, of: Column | None = None, counts: dict | None = None) -> DataFrame:
    """The rows whose hash `h` is small: at least `want` of them for each value of `of` (all, if fewer), about twice as many at most unless many rows share a hash.

    Rows are counted first, so no value is lost, however few hashes its rows have. What an
    order by the hash with that limit takes is among the rows: such a sample neither sorts
    nor gathers much more than it returns.
    """
    least = {}
    for g, by in (hash_counts(df, h, of) if counts is None else counts).items():
        n, z = 0, 61
        while z > 0 and n < want:
            z -= 1
            n += by.get(z, 0)
        least[g] = z
    if of is None:
        return df.where(_zeros(h) >= least.get("", 0))
    levels = [F.lit(x) for g, z in least.items() for x in (g, z)]
    return df.where(_zeros(h) >= F.element_at(F.create_map(*levels), of)) if levels else df


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns named c0, c1, ..., which clash with none of an operator's own, and what each lower-cased old name became."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {c.lower(): f"c{i}" for i, c in enumerate(df.columns)}


def renamed(old: DataFrame, added: list[Column], names: list[str], changed: dict[str, Column] | None = None) -> list[Column]:
    """What to select from a `numbered` frame: the columns of `old` by their own names, but those named like one of `names`, then `added` by these."""
    new = {n.lower() for n in names}
    back = [(changed or {}).get(c.lower(), F.col(f"c{i}")).alias(c) for i, c in enumerate(old.columns) if c.lower() not in new]
    return back + [a.alias(n) for a, n in zip(added, names, strict=True)]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over a partition's batches; at the partition's end its memory goes back to the system, as workers idle beside later stages."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return task
