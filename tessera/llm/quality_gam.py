"""Quality classifier (operator 9): a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature gets one shallow tree on the current gradients, whose leaves are added to
that feature's lookup table over its bins; then the strongest pairs get tables over two features' bins the same way.
A score is the sum of a few table entries, looked up for a whole batch of texts at once.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Labelled rows that the fit uses at most (chosen by a hash of doc_id); the only bounded sample here.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, L2 = 200, 60, 0.1, 3, 2.0

_UPPER, _DIGIT, _SYMBOL, _OTHER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=_{}[]", b"!?"
NAMES = ("log_words", "word_length", "symbols", "pipes", "exclaims", "upper", "digits", "distinct", "adjacent_equal", "top_word", "line_words", "dup_lines", "stops", "commas", "symbols_per_word", "non_ascii")


def features(text: str | None) -> tuple[float, ...]:
    """Measures of a whole text, none of which depends on its language by name; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    symbols = count(_SYMBOL)
    return (
        np.log1p(len(words)),
        (size - raw.count(b" ")) / n,
        symbols / size,
        raw.count(b"|") / n,
        count(_OTHER) / size,
        count(_UPPER) / size,
        count(_DIGIT) / size,
        len(counts) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        len(words) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        raw.count(b".") / n,
        raw.count(b",") / n,
        symbols / n,
        1 - len(text or "") / size,
    )


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(x) for x in texts], np.float64).reshape(-1, len(NAMES))


@dataclass
class Model:
    """edges: inner bin edges by feature; tables: score by bin; pairs: (i, j, edges of i, edges of j, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The values by bin of a tree of `leaves` leaves, grown by the best split each time."""
    parts, best = [(0, len(g))], {}

    def split(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left = cg[:-1] ** 2 / (ch[:-1] + L2)
        right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + L2)
        gain = left + right - cg[-1] ** 2 / (ch[-1] + L2)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    while len(parts) < leaves:
        best = {p: best.get(p) or split(*p) for p in parts}
        part = max(parts, key=lambda p: best[p][0])
        if best[part][0] <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], best[part][1]), (best[part][1], part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features once: four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    quads = []
    for c in (cg, ch):
        a, top, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        quads.append((a, top - a, left - a, all_ - top - left + a))
    for x, y in zip(*quads, strict=True):
        gain += x**2 / (y + L2)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + L2)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + L2)), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Deterministic. Without rows of both labels the model scores every text alike: by the one label's share."""
    n, width = len(y), len(NAMES)
    rate = (y.sum() + 0.5) / (n + 1.0)
    model = Model(float(np.log(rate / (1 - rate))), [np.array([])] * width, [np.zeros(1)] * width, [])
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_cuts(x[:, k], BINS) for k in range(width)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(n, model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradients()
            step = RATE * _tree(np.bincount(b, g, len(model.tables[k])), np.bincount(b, h, len(model.tables[k])))
            model.tables[k] += step
            logit += step[b]
    coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    cell = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cell[i] * shape[1] + cell[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    ranked = sorted(combinations(range(width), 2), key=lambda p: (-_corner(grid(*p, g), grid(*p, h))[0], p))[:PAIRS]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p in ranked:
            g, h = gradients()
            step = RATE * _corner(grid(*p, g), grid(*p, h))[1]
            tables[p] += step
            logit += step[cell[p[0]], cell[p[1]]]
    model.pairs = [(i, j, coarse[i], coarse[j], tables[i, j]) for i, j in ranked]
    return model


def held_out(doc_id: str = "doc_id"):
    """The third of the ids that the fit never sees; a null id is not of it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `max_train` labelled rows outside the held-out third.

    The sample of (doc_id, label) is bounded by the parameter, so it is broadcast; the driver gets one row of numbers for
    each of them at most: of texts that repeat a doc_id, the one of the lowest features counts.
    """
    sample = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix([t.as_py() for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    numbers = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    got = numbers.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    return x, got["quality"].to_numpy().astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Null text scores as the empty text; long texts are measured whole; equal texts score alike; an empty table gives
    no rows; other columns are left out. Inputs of a score are measures of the text alone.
    """
    model = fit(*training_rows(docs, labels, text, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(model.score(matrix([t.as_py() for t in batch.column(1)])), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of `docs` whose text scores 0.5 or more, all their columns as they are.

    Null text scores as the empty text; repeated rows are kept or go together; an empty table gives no rows; with labels
    of one kind or none the model scores all texts alike.
    """
    model, at = fit(*training_rows(docs, labels, text, max_train)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(matrix([t.as_py() for t in batch.column(at)])) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_gam": op9_quality_gam}
ORACLES: dict[str, str] = {}
