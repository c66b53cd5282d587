"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit of it is a binary question about the text
(is its language one of these?) answered by a logistic classifier on hashed letter
n-grams. Decoding sums, for each language, the loss of the bits' margins against its
codeword, weighted by how well each classifier did on that language, and takes the
nearest; a small gap to the second nearest flags the answer as ambiguous.
Whole texts are read. Training reads a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .media import _pieces
from .shared import hash_counts, smallest_hashes, tidy

DIM = 1 << 13
#: Bounds of the training sample: rows of each language, and rows in all.
PER_LANGUAGE = 500
MOST_ROWS = 4000
MIN_BITS = 15
AMBIGUOUS = 0.1
LEAST_TRUST = 0.05
UND = "und"
_SEEDS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """A flag for every code point, by str.isalpha."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Counts of the text's letter 1-, 2- and 3-grams in DIM hashed cells; None without a letter.

    Letters are lower-cased; anything else is a blank.
    """
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    blank = np.full(1, 32, np.uint32)
    c = np.concatenate([blank, c, blank])
    total = np.zeros(DIM)
    h = np.zeros_like(c)
    for n in range(3):
        h = (h[: len(c) - n] if n else h) * np.uint32(0x01000193) + c[n:] + np.uint32(n)
        cells = (h * _SEEDS[n]) >> np.uint32(32 - 13)
        total += np.bincount(cells, minlength=DIM)
    return total


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def codewords(n: int, min_bits: int = MIN_BITS) -> np.ndarray:
    """n rows of +1/-1 with far-apart rows and no constant column: all two-way splits for up to 5 languages, else the best of many random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        rows = [np.zeros_like(splits), *((splits >> i) & 1 for i in range(n - 1))]
        return np.array(rows) * 2.0 - 1
    rng, best, far = np.random.default_rng(7), None, -1
    bits = max(min_bits, int(np.ceil(8 * np.log2(n))))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((code[:, None] != code[None]).sum(-1) + np.eye(n, dtype=int) * bits).min()
        if apart > far and not (np.abs(code.sum(0)) == n).any():
            best, far = code, apart
    return best


@dataclass
class Coder:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray = field(default=None)  # languages x bits, rows sum to 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        """The nearest language and how much nearer than the second: 0 (tie) to 1."""
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        if len(loss) == 1:
            return self.languages[0], 1.0
        first, second = np.argsort(loss, kind="stable")[:2]
        return self.languages[first], float(1 - loss[first] / loss[second]) if loss[second] > 0 else 0.0


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 100, decay: float = 1e-4) -> Coder:
    """Train all bits at once by Nesterov's gradient steps on the logistic loss; classes count equally."""
    code = codewords(len(languages))
    targets = code[y]
    balance = 1.0 / np.bincount(y, minlength=len(languages))[y]
    balance = (balance / balance.sum())[:, None].astype(np.float32)
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    step = np.float32(3.0)
    for k in range(rounds):
        m = x @ vw + vb
        g = (-targets * balance / (1 + np.exp(np.clip(targets * m, -30, 30)))).astype(np.float32)
        nw, nb = vw - step * (x.T @ g + decay * vw), vb - step * g.sum(axis=0)
        mu = np.float32(k / (k + 3))
        vw, vb, w, b = nw + mu * (nw - w), nb + mu * (nb - b), nw, nb
    scale = np.float32(4.0)
    model = Coder(languages, code, w * scale, b * scale)
    right = (model.margins(x) * targets) > 0
    trust = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) if len(x) else np.ones_like(code)
    trust = np.maximum(trust, LEAST_TRUST)  # a language that no classifier gets right would else be at no distance from anything
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text (null: '') leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Coder | None:
    """Fit on text and lang of rows that aren't held out: the rows with the smallest hashes of id and text, `per_language` of each language at most and `most_rows` in all, but one of each language at least.

    Rows are ranked and bounded, not ids: null, hot and repeated ids neither crowd a
    language out nor gather more rows. None if there is no labelled row with a letter.
    Features are computed where the rows are; the driver gets sparse counts of the
    bounded sample only.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    h = F.xxhash64("doc_id", "text")
    counts = hash_counts(d, h, F.col("lang"))
    if not counts:
        return None
    quota, sizes = per_language, [sum(by.values()) for by in counts.values()]
    while quota > 1 and sum(min(n, quota) for n in sizes) > most_rows:
        quota -= 1
    order = Window.partitionBy("lang").orderBy(h, "doc_id", "text")
    few = smallest_hashes(d, h, quota, F.col("lang"), counts)
    sample = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)

    def run(batches):
        for b in _pieces(batches, 256):
            rows = [(lang, rank, c) for lang, rank, text in zip(*(b.column(k).to_pylist() for k in ("lang", "rank", "text")), strict=True) if (c := features(text)) is not None]
            cells = [np.flatnonzero(c) for _, _, c in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array([c[2][k].astype(np.float32) for c, k in zip(rows, cells, strict=True)], pa.list_(pa.float32()))],
                ["lang", "rank", "cells", "counts"],
            )

    got = sample.select("lang", "rank", "text").mapInArrow(run, "lang string, rank int, cells array<int>, counts array<float>").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("rank", "ascending")])
    lang, cells, counted = got.column("lang").to_pylist(), got.column("cells"), got.column("counts")
    languages = sorted(set(lang))
    x = np.zeros((len(lang), DIM), np.float32)  # the one large array here
    for i, (k, c) in enumerate(zip(cells, counted, strict=True)):
        c = c.values.to_numpy()
        x[i, k.values.to_numpy()] = np.sqrt(c / c.sum())
    return fit(x, np.array([languages.index(k) for k in lang]), languages)


def predict(docs: DataFrame, model: Coder | None, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """`docs` with lang_pred string, score double (0 to 1: the gap between nearest and second) and ambiguous boolean.

    `und` with score 0 where the text is null, empty or has no letter, or nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("lang_pred", "score", "ambiguous")
    inner = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in inner.schema.fields), "lang_pred string, score double, ambiguous boolean"])

    def run(batches):
        m = shared.value
        for b in _pieces(batches, 256):
            out = []
            for x in b.column("text"):
                c = features(x.as_py()) if m else None
                out.append(m.decode(m.margins(scaled(c))) if c is not None else (UND, 0.0))
            new = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[1] < ambiguous for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return inner.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on `docs` and predict every row; extra columns pass through, those named like the new ones are replaced."""
    return predict(docs, train(docs))
