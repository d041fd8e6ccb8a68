"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words counts the letter triples that both have in order,
weighted by how far each is spread, so an insult with a gap or an inserted
character stays close to the plain one. Words are folded to a small alphabet
first: case, digits and signs between letters vanish, repeated letters become
one, letters spelled apart are joined, and an accent is a letter of its own ahead
of the plain one, which the kernel takes for an inserted character. A word's start
and end count as letters, for an insult's stem may be ordinary inside other words.

Training is on labelled sentences: each is a bag of words, toxic if one of them
is. Words that explain the toxic sentences are found by greedy cover, an SVM is
fitted on the Nyström features of these and of words of clean sentences, and the
clean words that score highest are added as hard negatives. As the kernel is a
sum over triples, the fitted SVM folds into one weight for each triple, and a
task scores a word with a few table lookups. A text is judged by its TOP highest
word scores, for one doubtful word says little and several say much; their weights
are fitted on scores of words that the other half of the sample was trained on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import shingles as S
from gleaner.llm.quality import labelled_sample

DECAY, LETTERS, MOST_SPAN, WINDOW = 0.5, 32, 9, 24
LEAST = 5  # letters of a word with its start and end marks
LANDMARKS, RIDGE = 256, 1e-4
#: Labelled documents of each class that the model is fitted on, chosen by hash.
MOST_TOXIC, MOST_CLEAN = 4_000, 6_000
#: Words of clean sentences among the training rows.
MOST_NEGATIVE = 4_000
#: The share of toxic documents, and at least how many, that make a word a positive row
#: even where others explain them.
SUPPORT, LEAST_SUPPORT = 0.015, 4
#: Word scores that a text is judged by.
TOP = 4

_DROP = 255
_CODE = np.full(256, _DROP, dtype=np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[0x80:0xC0] = 27 + np.arange(64) % 4
ACCENT = 31
#: The second bytes of U+00C0 to U+00FF, folded to their base letters.
_LATIN = "aaaaaaaceeeeiiiidnooooo*ouuuuytsaaaaaaaceeeeiiiidnooooo*ouuuuyty"
_AFTER_C3 = np.array([_DROP if c == "*" else ord(c) - 96 for c in _LATIN], dtype=np.uint8)


def fold(data: np.ndarray) -> np.ndarray:
    """A letter code 1 to 31 for each byte, or ``_DROP``."""
    codes = _CODE[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] < 0xC0)]
    codes[after] = _AFTER_C3[data[after] - 0x80]
    codes[after[codes[after] != _DROP] - 1] = ACCENT
    return codes


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j, k) in a word of n letters and their weights."""
    at = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + MOST_SPAN)) for j in range(i + 1, k)]
    at = np.array(at, dtype=np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1)


_TRIPLES = [triples(n) for n in range(WINDOW + 1)]
_NORM = np.array([max(np.sqrt((w**2).sum()), 1e-9) for _, w in _TRIPLES])


def code_matrix(letters: np.ndarray, n: int) -> np.ndarray:
    """Triple codes of words of n letters, a column for each triple."""
    at = _TRIPLES[n][0]
    wide = letters.astype(np.int32)
    return (wide[:, at[:, 0]] * LETTERS + wide[:, at[:, 1]]) * LETTERS + wide[:, at[:, 2]]


def table_scores(letters: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Sum of weighted table entries over each word's triples, normalised."""
    at, weights = _TRIPLES[n]
    wide = letters.astype(np.int32)
    total = np.zeros(len(letters))
    for (i, j, k), w in zip(at, weights, strict=True):
        total += w * table[(wide[:, i] * LETTERS + wide[:, j]) * LETTERS + wide[:, k]]
    return total / _NORM[n]


def folded_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words one after another, and their lengths."""
    codes = fold(data)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(starts, size)
    letters, word = codes[index], np.repeat(np.arange(len(starts)), size)
    keep = letters != _DROP
    letters, word = letters[keep], word[keep]
    if len(letters):
        new = np.concatenate([[True], (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])])
        letters, word = letters[new], word[new]
    return letters, np.bincount(word, minlength=len(starts))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, offset, length) of the pieces of at most WINDOW letters of each word."""
    word, offset, size = np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.int64), np.minimum(lengths, WINDOW)
    long = np.flatnonzero(lengths > WINDOW)
    more = [(w, o, min(WINDOW, lengths[w] - o)) for w in long for o in range(WINDOW // 2, int(lengths[w]) - WINDOW // 2, WINDOW // 2)]
    if more:
        a, b, c = (np.array(v, dtype=np.int64) for v in zip(*more, strict=True))
        word, offset, size = np.concatenate([word, a]), np.concatenate([offset, b]), np.concatenate([size, c])
    return word, offset, size


def spelled(lengths: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at least three neighbouring words of one letter."""
    single = (lengths == 1).astype(np.int8)
    change = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])) | np.concatenate([[0], np.diff(rows), [0]]) != 0)
    return [(a, b) for a, b in zip(change, change[1:], strict=False) if b - a >= 3 and single[a]]


class Words(NamedTuple):
    """The distinct words of a piece and where they occur."""

    letters: np.ndarray  # codes of all distinct words
    ends: np.ndarray
    of: np.ndarray  # the distinct word of each occurrence
    rows: np.ndarray  # the row of each occurrence


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, rows = S.word_spans(data, offsets)
    hashes = S.word_hashes(data, starts, ends)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    letters, lengths = folded_words(data, starts[first], ends[first])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    joined = [(letters[bounds[of[a:b]]], rows[a]) for a, b in spelled(lengths[of], rows)] if len(of) else []
    if joined:
        letters = np.concatenate([letters, *[x for x, _ in joined]])
        more = np.cumsum([len(x) for x, _ in joined])
        of = np.concatenate([of, np.arange(len(bounds) - 1, len(bounds) - 1 + len(joined))])
        rows = np.concatenate([rows, [r for _, r in joined]])
        bounds = np.concatenate([bounds, bounds[-1] + more])
    return Words(letters, bounds, of, rows)


def marked(letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least three letters with code 0 at their start and end."""
    size = np.diff(bounds)
    whole = size >= 3
    starts = np.concatenate([[0], np.cumsum(size + 2 * whole)])
    out = np.zeros(starts[-1], dtype=np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(letters)) - bounds[word] + starts[word] + whole[word]] = letters
    return out, starts


def word_scores(words: Words, table: np.ndarray) -> np.ndarray:
    """The table score of each distinct word: its best piece; 0 under three letters."""
    letters, ends = marked(words.letters, words.ends)
    out = np.zeros(len(ends) - 1)
    word, offset, size = windows(np.diff(ends))
    for n in range(LEAST, WINDOW + 1):
        chosen = np.flatnonzero(size == n)
        if len(chosen):
            start = ends[word[chosen]] + offset[chosen]
            scores = table_scores(letters[start[:, None] + np.arange(n)], n, table)
            np.maximum.at(out, word[chosen], scores)
    return out


class WordModel(NamedTuple):
    table: np.ndarray  # a weight for each letter triple
    floor: float  # the score on the SVM's boundary


def highest(scores: np.ndarray, rows: np.ndarray, n: int, floor: float) -> np.ndarray:
    """How far the TOP highest scores of each row pass ``floor``, in falling order,
    as a share of the way to 1; else 0."""
    some = np.flatnonzero(scores > floor)
    scores, rows = (scores[some] - floor) / (1 - floor), rows[some]
    order = np.lexsort((-scores, rows))
    scores, rows = scores[order], rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out = np.zeros((n, TOP))
    out[rows[place < TOP], place[place < TOP]] = scores[place < TOP]
    return out


class Model(NamedTuple):
    words: WordModel
    weights: np.ndarray  # of the TOP word scores
    shift: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest word scores of each row; zeros for rows without words."""
        words = distinct_words(data, offsets)
        return highest(word_scores(words, self.words.table)[words.of], words.rows, len(offsets) - 1, self.words.floor)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(data, offsets) @ self.weights + self.shift, -30, 30)))


def as_letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("latin-1"), dtype=np.uint8) - 64


def kernel_tables(words: list[str]) -> np.ndarray:
    """For each word the normalised weight of each triple."""
    out = np.zeros((len(words), LETTERS**3), dtype=np.float32)
    for row, word in enumerate(words):
        letters = as_letters(word)[:WINDOW]
        n = len(letters)
        np.add.at(out[row], code_matrix(letters[None, :], n)[0], _TRIPLES[n][1] / _NORM[n])
    return out


def kernel(words: list[str], tables: np.ndarray) -> np.ndarray:
    """Kernel of words (rows) and the words behind ``tables`` (columns)."""
    out, by_code = np.zeros((len(words), len(tables))), np.ascontiguousarray(tables.T)
    sizes = np.array([min(len(w), WINDOW) for w in words])
    for n in np.unique(sizes):
        chosen = np.flatnonzero(sizes == n)
        letters = np.stack([as_letters(words[i])[:n] for i in chosen])
        codes, weights = code_matrix(letters, n), _TRIPLES[n][1] / _NORM[n]
        part = np.zeros((len(chosen), len(tables)), dtype=np.float32)
        for t in range(codes.shape[1]):
            part += np.float32(weights[t]) * by_code[codes[:, t]]
        out[chosen] = part
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps: weights and bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        inside = y * (z @ w) < 1
        zi, ci = z[inside], cost[inside]
        hessian = (zi * ci[:, None]).T @ zi + np.diag(penalty) + 1e-9 * np.eye(len(w))
        new = np.linalg.solve(hessian, (zi * ci[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def greedy_cover(bags: list[set[str]], counts: dict[str, int], least: int) -> list[str]:
    """Words that explain the bags: each new one the most unexplained bags."""
    where: dict[str, set[int]] = {}
    for i, bag in enumerate(bags):
        for word in bag:
            if word in counts:
                where.setdefault(word, set()).add(i)
    chosen, open_bags = [], set(range(len(bags)))
    heap = sorted(((len(v), w) for w, v in where.items()), key=lambda x: (-x[0], x[1]))
    while heap:
        fresh = sorted(((len(where[w] & open_bags), w) for _, w in heap[:200]), key=lambda x: (-x[0], x[1]))
        gain, word = fresh[0]
        rest = heap[200:]
        if rest and rest[0][0] > gain:  # the bound of those behind is not known to be lower yet
            heap = sorted(((len(where[w] & open_bags), w) for _, w in heap), key=lambda x: (-x[0], x[1]))
            continue
        if gain < least:
            break
        chosen.append(word)
        open_bags -= where[word]
        heap = [x for x in [*fresh[1:], *rest] if x[0]]
    return chosen


def bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The label, distinct folded words and their numbers (up to TOP) of each text."""
    for batch in batches:
        data, offsets = S.flat(batch.column(2))
        for first, last in S.pieces(offsets):
            low, high = offsets[first], offsets[last]
            words = distinct_words(data[low:high], offsets[first : last + 1] - low)
            letters, ends = marked(words.letters, words.ends)
            raw = (letters + np.uint8(64)).tobytes().decode("latin-1")
            names = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            bags: list[dict[str, int]] = [{} for _ in range(last - first)]
            for row, word in zip(words.rows.tolist(), words.of.tolist(), strict=True):
                if len(names[word]) >= LEAST:
                    bags[row][names[word]] = min(TOP, bags[row].get(names[word], 0) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    batch.column(1).slice(first, last - first),
                    pa.array([sorted(b) for b in bags], pa.list_(pa.string())),
                    pa.array([[b[w] for w in sorted(b)] for b in bags], pa.list_(pa.int32())),
                ],
                names=["id", "label", "words", "counts"],
            )


Bag = dict[str, int]


def pieces_of(name: str) -> list[str]:
    """A word, or the pieces of a longer one that scoring looks at."""
    if len(name) <= WINDOW:
        return [name]
    _, offsets, sizes = windows(np.array([len(name)]))
    return [name[a : a + n] for a, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]


def fit_words(bags: list[Bag], toxic: np.ndarray) -> WordModel | None:
    """Weights by which the median insult scores 1; None if no word sets the classes
    apart."""
    clean_words: dict[str, int] = {}
    counts: dict[str, int] = {}
    sets = [{piece for word in bag for piece in pieces_of(word)} for bag in bags]
    for bag, label in zip(sets, toxic, strict=True):
        into = counts if label else clean_words
        for word in bag:
            into[word] = into.get(word, 0) + 1
    toxic_bags = [bag for bag, label in zip(sets, toxic, strict=True) if label]
    if not toxic_bags or len(toxic_bags) == len(bags):
        return None
    ratio = len(toxic_bags) / (len(bags) - len(toxic_bags))
    pure = {w: c for w, c in counts.items() if c >= 2 and clean_words.get(w, 0) * ratio <= 0.03 * c}
    cover = greedy_cover(toxic_bags, pure, 2)
    often = sorted((w for w, c in pure.items() if c >= max(LEAST_SUPPORT, SUPPORT * len(toxic_bags))), key=lambda w: (-counts[w], w))[:MOST_NEGATIVE]
    insults = list(dict.fromkeys(cover + often))
    if not insults:
        return None
    rng = np.random.default_rng(7)
    others = sorted(set(clean_words) - set(insults))
    negatives = [others[i] for i in rng.permutation(len(others))[:MOST_NEGATIVE]]
    table = np.zeros(LETTERS**3)
    for step in range(3):
        words = insults + negatives
        y = np.concatenate([np.ones(len(insults)), -np.ones(len(negatives))])
        landmarks = insults[: LANDMARKS * 3 // 4]
        landmarks = landmarks + negatives[-(LANDMARKS - len(landmarks)) :]
        tables = kernel_tables(landmarks)
        values, vectors = np.linalg.eigh(kernel(landmarks, tables))
        good = values > 1e-8 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        z = kernel(words, tables) @ whiten
        cost = np.where(y > 0, 0.5 / len(insults), 0.5 / max(len(negatives), 1)) * 1000
        weights, bias = fit_svm(z, y, cost, RIDGE * 1000)
        table = (whiten @ weights) @ tables
        if step < 2:  # hard negatives: clean words that look worst
            scored = np.array(list(names_scored(others, table).values()))
            hard = [others[i] for i in np.argsort(-scored, kind="stable")[: MOST_NEGATIVE // 4]]
            negatives = list(dict.fromkeys(negatives + hard))
    usual = max(float(np.median(list(names_scored(insults, table).values()))), 1e-6)
    return WordModel(table / usual, float(np.clip(-bias / usual, 0.0, 0.9)))


def names_scored(names: list[str], table: np.ndarray) -> dict[str, float]:
    scores, sizes = np.zeros(len(names)), np.array([len(w) for w in names], dtype=np.int64)
    for n in range(LEAST, WINDOW + 1):
        at = np.flatnonzero(sizes == n)
        if len(at):
            scores[at] = table_scores(as_letters("".join(names[i] for i in at)).reshape(-1, n), n, table)
    return dict(zip(names, scores.tolist(), strict=True))


def bag_margins(bags: list[Bag], model: WordModel) -> np.ndarray:
    words = sorted({w for bag in bags for w in bag})
    scored = names_scored(sorted({p for w in words for p in pieces_of(w)}), model.table)
    known = {w: max(scored[p] for p in pieces_of(w)) for w in words}
    rows = [i for i, bag in enumerate(bags) for n in bag.values() for _ in range(n)]
    scores = [known[w] for bag in bags for w, n in bag.items() for _ in range(n)]
    return highest(np.array(scores, dtype=float), np.array(rows, dtype=np.int64), len(bags), model.floor)


def fit_weights(x: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of at least 0, by projected Newton steps."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    free = np.ones(len(w), dtype=bool)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - toxic) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        free = (w > 0) | (gradient < 0)
        free[-1] = True
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        new = w - step
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def originals(bags: list[Bag], hashes: int = 16, least: int = 10) -> list[int]:
    """Bags that aren't near copies of an earlier one, by their words' minima: a
    copy would vouch for every word of its original."""
    names = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
    keys = np.array([zlib.crc32(w.encode()) for w in names], dtype=np.uint64)
    mixed = np.stack([S.mix64(keys + np.uint64(k << 32)) for k in range(hashes)], axis=1) if names else np.zeros((0, hashes), dtype=np.uint64)
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, bag in enumerate(bags):
        if not bag:
            continue
        minima = list(enumerate(mixed[[names[w] for w in bag]].min(axis=0).tolist()))
        shared = Counter(j for slot in minima for j in seen.get(slot, ()))
        if shared and shared.most_common(1)[0][1] >= least:
            continue
        kept.append(i)
        for slot in minima:
            seen.setdefault(slot, []).append(i)
    return kept


def fit(bags: list[Bag], toxic: np.ndarray, threshold: float) -> Model:
    """A model whose score passes ``threshold`` where F1 over the bags is best.

    Weights and threshold come from margins of bags under the table of the other
    half, so they are those of unseen texts. Without bags of both classes, or
    words that set them apart, nothing is learnt and every score is low.
    """
    kept = originals(bags)
    bags, toxic = [bags[i] for i in kept], toxic[kept]
    words = fit_words(bags, toxic)
    if words is None:
        return Model(WordModel(np.zeros(LETTERS**3), 0.5), np.zeros(TOP), -4.0)
    margins, half = np.zeros((len(bags), TOP)), np.arange(len(bags)) % 2
    for part in (0, 1):
        here = half == part
        other = fit_words([b for b, h in zip(bags, here, strict=True) if not h], toxic[~here])
        margins[here] = bag_margins([b for b, h in zip(bags, here, strict=True) if h], words if other is None else other)
    weights, _ = fit_weights(margins, toxic)
    if not weights.any():
        weights = np.eye(TOP)[0]
    values = margins @ weights
    order = np.argsort(-values, kind="stable")
    hits, cut = np.cumsum(toxic[order]), np.arange(1, len(bags) + 1)
    f1 = 2 * hits / (cut + toxic.sum())
    distinct = np.append(values[order][:-1] > values[order][1:] + 1e-12, True)
    best = int(np.argmax(np.where(distinct, f1, -1)))
    below = values[order][best + 1] if best + 1 < len(bags) else 0.0
    edge = 0.5 * (values[order][best] + max(below, 0.0))
    slope = 6.0 / max(float(np.median(values[toxic])) - edge, 0.05)
    return Model(words, weights * slope, float(np.log(threshold / (1 - threshold)) - slope * edge))


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> Model:
    """Fit on at most MOST_TOXIC and MOST_CLEAN documents whose label is usable.

    The sentences of the sample are its documents: a label covers a whole one.
    """
    toxic = labelled_sample(labels, id_col, label_col, usable & (F.col(label_col) == 1), MOST_TOXIC)
    clean = labelled_sample(labels, id_col, label_col, usable & (F.col(label_col) == 0), MOST_CLEAN)
    sample = toxic.unionByName(clean)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, label int, words array<string>, counts array<int>"
    found = sorted((r["id"], r["label"], r["words"], r["counts"]) for r in rows.mapInArrow(bag_rows, schema).toLocalIterator())
    return fit([dict(zip(words, counts, strict=True)) for _, _, words, counts in found], np.array([label == 1 for _, label, _, _ in found], dtype=bool), threshold)


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score and predicted (1 if score >= ``threshold``) of every document.

    A document scores by its most insulting words. Null and empty texts have the
    lowest score; repeated rows have a row each. Only the text is read, whole, whatever its length.
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
                scores.append(shared.value.scores(data[low:high], offsets[first : last + 1] - low))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["id", "score"])

    scored = rows.mapInArrow(task, f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
