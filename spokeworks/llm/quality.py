"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature in turn gets a shallow tree on its bins, fitted to the
residuals, whose values are added to the feature's lookup table; then the strongest pairs of
features get tables in the same way. A document's score is a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, text_of

FEATURES = (
    "log_words", "word_length", "longest_word", "symbols", "exclaims", "stops", "upper", "digits", "non_ascii",
    "duplicate_lines", "distinct_words", "top_word", "short_words", "line_words", "marked_words", "pair_repeats",
)
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_HIGH = bytes(range(128, 256))


def features(text: str) -> list[float]:
    """FEATURES of a text; all zero without words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.max()), share(b"#*$%&|<>"), share(b"!?"), share(b".,;:"), share(_UPPER), share(_DIGITS), share(_HIGH),
        1 - len(set(lines)) / len(lines), len(counts) / n**0.8, counts.most_common(1)[0][1] / n, float((lengths <= 3).mean()), float(np.log1p(n / len(lines))),
        sum(w[-1:] in b".,;:!?" for w in words) / n, 1 - pairs / max(n - 1, 1),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges and a table per feature; a table over coarse bins per pair."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features, by additions of table entries."""
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        wide = [np.searchsorted(edges, x[:, k], "right") for k, edges in enumerate(self.coarse)]
        for i, j, table in self.pairs:
            total += table[wide[i], wide[j]]
        return _sigmoid(total)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a tree with so many leaves at most, grown best-first, for sums of gradient and weight by bin."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        left, right = h[k] - h[a], h[b] - h[k]
        gain = (g[k] - g[a]) ** 2 / (left + 1) + (g[b] - g[k]) ** 2 / (right + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        gain = np.where((left >= least) & (right >= least), gain, 0)
        return float(gain.max()), int(k[gain.argmax()])

    parts = [(*best(0, len(gradient)), 0, len(gradient))]
    while len(parts) < leaves and (top := max(parts))[0] > 1e-9:
        parts.remove(top)
        _, k, a, b = top
        parts += [(*best(a, k), a, k), (*best(k, b), k, b)]
    out = np.zeros(len(gradient))
    for _, _, a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values of a tree over two features: the cut of the rows, with a cut of the columns on either side, that gains most."""
    best, out = -1.0, np.zeros_like(g)
    for k in range(1, len(g)):
        sides = [_tree(x[0].sum(axis=0), x[1].sum(axis=0), 2, least) for x in ((g[:k], h[:k]), (g[k:], h[k:]))]
        gain = float(sides[0] @ g[:k].sum(axis=0) + sides[1] @ g[k:].sum(axis=0))
        if gain > best:
            best, out = gain, np.concatenate([np.tile(sides[0], (k, 1)), np.tile(sides[1], (len(g) - k, 1))])
    return out


def fit_table(x: np.ndarray, y: np.ndarray, bins: int = 64, wide_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, leaves: int = 4, least: float = 2.0) -> AdditiveModel:
    """The model of features x and labels y (0 or 1). Without rows, or with one label only, it is a constant."""
    n, m = x.shape
    base = (y.sum() + 0.5) / (n + 1)
    intercept = float(np.log(base / (1 - base)))
    cuts = lambda k: tuple(np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if n else np.zeros(0) for j in range(m))
    edges, coarse = cuts(bins), cuts(wide_bins)
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, intercept)
    if not n or y.min() == y.max():
        return AdditiveModel(intercept, edges, tuple(tables), coarse, ())
    for _ in range(rounds):
        for j in range(m):
            p = _sigmoid(total)
            size = len(tables[j])
            step = rate * _tree(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size), leaves, least)
            tables[j] += step
            total += step[at[j]]
    wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell, size = _sigmoid(total), wide[i] * sizes[j] + wide[j], sizes[i] * sizes[j]
        return np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)

    gains = sorted((-float((g**2 / (h + 1)).sum()), i, j) for i in range(m) for j in range(i) for g, h in [sums(i, j)])
    chosen = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            g, h = (a.reshape(sizes[i], sizes[j]) for a in sums(i, j))
            step = _quadrants(g, h, least)
            table += rate * step
            total += rate * step[wide[i], wide[j]]
    return AdditiveModel(intercept, edges, tuple(tables), coarse, tuple(chosen))


def with_features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, x array<double>."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return over_batches(docs, [F.col(doc_id), text_of(text)], work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, x array<double>")


def remainder(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null for a null id, whose row is neither held out nor learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, folds: int = 5, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> AdditiveModel:
    """Fit on labelled documents whose ``remainder`` isn't 0.

    most_rows: the bound of the sample; beyond it the rows with the smallest hashes of their id are
    taken, the same in each run. Null ids and labels are left out. Labels that an id repeats count
    by their smallest, documents that repeat it by their largest features.
    """
    known = labels.filter(F.col(label).isNotNull() & (remainder(doc_id, folds) != 0)).groupBy(doc_id).agg(F.min(label).alias("__label"))
    sample = known.orderBy(F.xxhash64(doc_id), doc_id).limit(most_rows).select(F.col(doc_id).alias("__id"), F.col("__label").cast("int").alias("__label"))
    chosen = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("__text")).join(F.broadcast(sample), "__id", "left_semi")
    x = with_features(chosen, "__text", "__id").groupBy("doc_id").agg(F.max("x").alias("x"))
    rows = x.join(F.broadcast(sample), x["doc_id"] == sample["__id"]).select("x", "__label", "__id").toArrow()  # bounded by most_rows
    order = np.argsort(rows["__id"].to_numpy(), kind="stable")
    flat = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))[order]
    return fit_table(flat, rows["__label"].to_numpy()[order].astype(float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, score double (probability of label 1).

    Null texts count as empty, whose features are all zero; repeated rows give repeated rows; an
    empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return over_batches(docs, [F.col(doc_id), text_of(text)], work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(shared.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
