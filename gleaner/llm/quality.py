"""Document quality by a generalised additive model with pairwise interactions.

Features come from bytes and word hashes of whole texts. Each is cut into bins;
boosting goes round the features, fits a tree of few leaves to the gradient over
one feature's bins, and adds a fraction of it to that feature's lookup table.
Then the pairs of features that explain most of what is left get small tables of
their own. A score is the sum of table entries through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import shingles as S

FEATURES = (
    "log_words", "mean_word_bytes", "upper_share", "digit_share", "stop_share", "symbol_share", "bang_share", "bar_share",
    "line_rate", "repeat_share", "distinct_share", "marked_word_share", "short_word_share", "long_word_share", "wide_share", "top_word_share",
)
BINS, PAIR_BINS, LEAVES = 64, 12, 3
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 160, 80, 0.15, 6
#: Labelled rows that the model is fitted on, chosen by hash.
MOST_LABELLED = 20_000

_KIND = np.zeros(256, dtype=np.int64)  # 0 other
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b".,;:?'\"-()":
    _KIND[_c] = 3
for _c in b"#$%&*+/<=>@[\\]^_`{}~":
    _KIND[_c] = 4
_KIND[ord("!")], _KIND[ord("|")], _KIND[10] = 5, 6, 7
_KIND[97:123] = 8
_KIND[[9, 11, 12, 13, 32]] = 9
_KIND[128:] = 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; all zero for one without words."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, rows = S.word_spans(data, offsets)
    if not len(starts):
        return out
    words = np.bincount(rows, minlength=n)
    per_word = 1.0 / np.maximum(words, 1)
    kinds = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 11 + kinds, minlength=n * 11).reshape(n, 11).astype(float)
    # capital letters of two bytes: 0xC3 0x80-0x9E
    wide_upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    upper = counts[:, 1] + np.bincount(owner[wide_upper], minlength=n)
    ink = np.maximum(counts.sum(axis=1) - counts[:, 9] - counts[:, 7], 1)
    letters = np.maximum(counts[:, 1] + counts[:, 8] + counts[:, 10] / 2, 1)
    length = ends - starts
    hashes = S.word_hashes(data, starts, ends)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])])
    order = np.lexsort((hashes, rows))
    new = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(rows[order]) != 0)])
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(n)
    np.maximum.at(top, rows[order][new], runs)
    marked = np.isin(kinds[ends - 1], (4, 5, 6))

    def rate(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows[flags], minlength=n) * per_word

    columns = (
        np.log1p(words), np.bincount(rows, weights=length, minlength=n) * per_word, upper / letters, counts[:, 2] / ink, counts[:, 3] / ink,
        counts[:, 4] / ink, counts[:, 5] / ink, counts[:, 6] / ink, counts[:, 7] * per_word, rate(again),
        np.bincount(rows[order][new], minlength=n) * per_word, rate(marked), rate(length <= 2), rate(length >= 14), counts[:, 10] / ink, top * per_word,
    )
    out[:] = np.stack(columns, axis=1) * (words > 0)[:, None]
    return out


class Model(NamedTuple):
    base: float
    cuts: list  # per feature: bin bounds
    tables: list  # per feature: a value for each bin
    pairs: list  # (feature, feature, cuts, cuts, table)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for f, g, f_cuts, g_cuts, table in self.pairs:
            total += table[np.searchsorted(f_cuts, x[:, f], "right"), np.searchsorted(g_cuts, x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def bounds(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 5.0) -> np.ndarray:
    """The step of each bin: best splits of the bins into ``leaves`` ranges."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    edges = [0, len(gradient)]

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        at = np.arange(a + 1, b)
        left = (g[at] - g[a]) ** 2 / (h[at] - h[a] + ridge)
        right = (g[b] - g[at]) ** 2 / (h[b] - h[at] + ridge)
        best = int(np.argmax(left + right))
        return float(left[best] + right[best] - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)), int(at[best])

    while len(edges) - 1 < leaves:
        best, at = max(gain(a, b) for a, b in zip(edges, edges[1:], strict=False))
        if best <= 1e-9:
            break
        edges = sorted([*edges, at])
    step = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:], strict=False):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of P(y = 1); with rows of one class only, their smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    cuts = [bounds(x[:, f], BINS) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, bins in enumerate(binned):
            r, w = residual()
            size = len(tables[f])
            step = RATE * shallow_tree(np.bincount(bins, r, size), np.bincount(bins, w, size), LEAVES)
            tables[f] += step
            total += step[bins]

    coarse = [bounds(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    placed = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    r, w = residual()
    ranked = []
    for f in range(x.shape[1]):
        for g in range(f + 1, x.shape[1]):
            width = len(coarse[g]) + 1
            cell, size = placed[f] * width + placed[g], (len(coarse[f]) + 1) * width
            ranked.append((float((np.bincount(cell, r, size) ** 2 / (np.bincount(cell, w, size) + 5)).sum()), f, g))
    chosen = [(f, g) for _, f, g in sorted(ranked, reverse=True)[:PAIRS]]
    grids = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for f, g in chosen:
            r, w = residual()
            shape = grids[f, g].shape
            cell = placed[f] * shape[1] + placed[g]
            gradient, weight = np.bincount(cell, r, shape[0] * shape[1]).reshape(shape), np.bincount(cell, w, shape[0] * shape[1]).reshape(shape)
            rows = shallow_tree(gradient.sum(axis=1), weight.sum(axis=1), 2)
            step = np.zeros(shape)
            for value in np.unique(rows):
                side = rows == value
                step[side] = shallow_tree(gradient[side].sum(axis=0), weight[side].sum(axis=0), 2)
            grids[f, g] += RATE * step
            total += RATE * step[placed[f], placed[g]]
    return Model(base, cuts, tables, [(f, g, coarse[f], coarse[g], grids[f, g]) for f, g in chosen])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, usable: Column, most: int) -> DataFrame:
    """At most ``most`` usable labelled rows, chosen by hash: (id, label)."""
    rows = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id", "label").limit(most)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = S.flat(batch.column(1))
        for first, last in S.pieces(offsets):
            low, high = offsets[first], offsets[last]
            found = features(data[low:high], offsets[first : last + 1] - low)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(list(found), pa.list_(pa.float64()))], names=["label", "x"]
            )


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` documents whose label row is ``usable``."""
    sample = labelled_sample(labels, id_col, label_col, usable, most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")
    found = rows.mapInArrow(feature_rows, "label int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    order = np.lexsort((found["label"].to_numpy(), *x.T))  # independent of the order in which rows arrive
    return fit(x[order], found["label"].to_numpy(dtype=float)[order])


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score and predicted (1 if score >= ``threshold``) of every document.

    A null text counts as empty; an empty one scores like a text without words.
    Only the text is read: other columns, ties and repeated rows don't matter.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = S.flat(batch.column(1))
            scores = [np.zeros(0)]
            for first, last in S.pieces(offsets):
                low, high = offsets[first], offsets[last]
                scores.append(shared.value.scores(features(data[low:high], offsets[first : last + 1] - low)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["id", "score"])

    scored = rows.mapInArrow(task, f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's digits leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
