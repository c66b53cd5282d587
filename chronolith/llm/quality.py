"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's hashed features share one weight vector; ordered thresholds cut the line of
w.x into grades: P(grade <= j) = sigmoid(threshold_j - w.x). Scoring gives the
expected grade and the probability of the upper grades, by which texts are selected.
Features are presences: words, and buckets of the text's form (length, distinct
words, repeated lines, symbols). Whole texts are read. Training reads a bounded
sample of rated rows; everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .media import _pieces
from .shared import smallest_hashes

BITS = 18
#: Bound of the training sample, in rated rows.
MOST_ROWS = 12_000
LEAST_ROWS_OF_FEATURE = 3
TAIL = 2
SELECT = 0.5
WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s]")
_cells: dict[str, int] = {}
CELLS_KEPT = 400_000


def _cell(feature: str) -> int:
    c = _cells.get(feature)
    if c is None:
        if len(_cells) >= CELLS_KEPT:
            _cells.clear()
        c = _cells[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) * 2654435761 % (1 << 32) >> (32 - BITS)
    return c


def features(text: str | None) -> list[int]:
    """The cells of a text's features, each once; null counts as ''."""
    text = text or ""
    words = WORD.findall(text.lower())
    distinct = set(words)
    n, lines = len(words), text.split("\n")
    runs = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda a, b: round(10 * a / b) if b else 10
    form = [
        f"#words {n.bit_length()}",
        f"#distinct {share(len(distinct), n)} {min(n.bit_length(), 8)}",
        f"#lines {share(len(set(lines)), len(lines))}",
        f"#runs {share(runs, n)}",
        f"#length {round(sum(map(len, words)) / n) if n else 0}",
    ]
    symbols: dict[str, int] = {}
    for s in SYMBOL.findall(text):
        symbols[s] = symbols.get(s, 0) + 1
    form += [f"#symbol {s} {(64 * c // max(n, 1)).bit_length()}" for s, c in symbols.items() if c >= 3]
    return sorted({_cell(f) for f in [*distinct, *form]})


@dataclass
class Grader:
    weight: np.ndarray  # of each cell
    thresholds: np.ndarray  # ordered, one fewer than grades

    def above(self, cells: list[int]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        z = np.clip(self.weight[cells].sum() - self.thresholds, -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(rows: list[list[int]], grades: np.ndarray, n_grades: int, rounds: int = 200, decay: float = 1.0, step: float = 0.15) -> Grader:
    """Minimise the negative log-likelihood plus decay/2 |w|^2 a row, by Adam over all rows; thresholds keep their order by construction."""
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    cells = np.concatenate([np.asarray(r, np.int64) for r in rows])
    known, at = np.unique(cells, return_inverse=True)
    common = np.bincount(at) >= min(LEAST_ROWS_OF_FEATURE, n)
    row = np.repeat(np.arange(n), sizes)[common[at]]
    col = (np.cumsum(common) - 1)[at[common[at]]]
    w = np.zeros(int(common.sum()))
    share = np.clip([(grades > j).mean() for j in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    p = np.concatenate([w, cuts[:1], gaps])
    m, v, k = np.zeros_like(p), np.zeros_like(p), len(w)
    for t in range(1, rounds + 1):
        theta = p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))])
        eta = np.bincount(row, p[:k][col], n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-np.clip(edge[grades + 1] - eta, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[grades] - eta, -40, 40)))
        hi, lo = np.where(grades == n_grades - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = -hi * (1 - hi) / mass / n, lo * (1 - lo) / mass / n  # of the loss, by the two edges
        g = np.empty_like(p)
        g[:k] = np.bincount(col, (-(d_hi + d_lo))[row], k) + decay / n * p[:k]
        g_theta = np.array([d_hi[grades == j].sum() + d_lo[grades == j + 1].sum() for j in range(n_grades - 1)])
        g[k] = g_theta.sum()
        g[k + 1 :] = np.exp(p[k + 1 :]) * np.cumsum(g_theta[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weight = np.zeros(1 << BITS)
    weight[known[common]] = p[:k]
    return Grader(weight, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, most_rows: int = MOST_ROWS) -> Grader | None:
    """Fit on `most_rows` rows at most: the ratings (doc_id, grade from 0) with the smallest hashes of their ids, and of the documents they rate the rows with the smallest hashes of id, grade and text; None without any.

    Null ids or grades, and grades outside the range, are left out; a document that is
    rated twice, or stands twice, counts twice. The bound holds for rows, however often
    an id is repeated. Null text is ''; whole texts are read.
    """
    r = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    few = smallest_hashes(r, F.xxhash64("doc_id"), most_rows).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn("h", F.xxhash64("doc_id", "grade", "text"))

    def run(batches):
        for b in _pieces(batches, 256):
            cells = [features(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("grade"), pa.array(cells, pa.list_(pa.int32()))], ["h", "grade", "cells"])

    rated = sample.mapInArrow(run, "h long, grade int, cells array<int>")
    got = rated.orderBy("h", "grade", "cells").limit(most_rows).toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("h", "grade", "cells")), strict=True))
    return fit([r[2] for r in rows], np.array([r[1] for r in rows]), n_grades)


def grade(docs: DataFrame, model: Grader | None, tail: int = TAIL, select: float = SELECT) -> DataFrame:
    """`docs` with expected_grade double, tail_prob double = P(grade >= tail), and keep boolean: tail_prob >= `select`.

    Null text is graded as ''. Without a model the grades are null and keep is true.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("expected_grade", "tail_prob", "keep")
    inner = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.schema.fields), "expected_grade double, tail_prob double, keep boolean"])

    def run(batches):
        m = shared.value
        for b in _pieces(batches, 256):
            above = [m.above(features(x)) if m else None for x in b.column("text").to_pylist()]
            new = [pa.array([None if a is None else float(a.sum()) for a in above], pa.float64()), pa.array([None if a is None else float(a[tail - 1]) for a in above], pa.float64()), pa.array([a is None or bool(a[tail - 1] >= select) for a in above], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return inner.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("grade"))
