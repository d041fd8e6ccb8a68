"""Alignment of two tokenizers' tokens, and how often their ids meet.

Both tokenizers cut a text's bytes; places where tokens of both end cut them into
groups, and tokens whose bytes overlap are linked. Texts are cut at words first
(:mod:`gleaner.llm.pieces`), where both end tokens, so each distinct word of a
chunk of documents is aligned once:

1. A task takes chunks of bounded bytes. On the tokens of a chunk's distinct words
   cumulative sums give ends, their intersection the cuts, binary searches the
   groups and overlaps, and repetition expands overlaps into links. A chunk is a row:
   its documents as numbers of words, its words as numbers of id pairs, its pairs
   with counts. Chunks are written once and read from there.
2. Pairs are summed over chunks in two stages, the first by pair and salt.
3. Each chunk gets the corpus-wide counts of its own pairs back, in a group with its
   row, and sums them over its documents' words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import shingles as S
from gleaner.llm.pieces import ByteLevel, TwoMemories, distinct, encode_pieces, piece_starts, spans
from gleaner.llm.storage import Workspace, join_checked

#: Bytes of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 3 << 20
#: Bytes of words that a worker remembers.
MOST_BYTES = 32 << 20
#: Parts that a pair's rows are dealt to before they are summed.
SALTS = 16
#: Rows of a table that is broadcast at most.
MOST_BROADCAST_ROWS = 200_000
#: How a piece vocabulary writes a space.
SPACE_MARK = "▁"

CHUNK = (
    "chunk long, doc_ids array<long>, word_ends array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, n_words long, words binary, n_word_links long, word_links binary, n_link_ends long, link_ends binary, keys array<long>, counts array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PieceModel:
    """A sentencepiece model, and its tokens' bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(SPACE_MARK, " ").encode() for i, name in enumerate(names)]
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        #: No entry has a space mark behind another character, so words don't join.
        self.cuts = not any(SPACE_MARK in name.lstrip(SPACE_MARK) for name in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, which begins with a space; the model adds that one
        itself, but for a text of nothing else (the last space of a document)."""
        found = self.model.encode([text[1:] for text in texts], num_threads=1)
        lone = [self.model.piece_to_id(SPACE_MARK)]
        return [np.array(lone if text == " " else ids, dtype=np.uint32) for text, ids in zip(texts, found, strict=True)]


class Links(NamedTuple):
    """Groups and links of two token sequences over the same bytes."""

    group_a: np.ndarray  # of each A token
    group_b: np.ndarray
    link_a: np.ndarray  # A token of each link, in order
    link_b: np.ndarray


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Links:
    """Groups and links by the tokens' bytes (1 or more each, the sums equal)."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, ends_a - sizes_a, side="right")
    last = np.searchsorted(ends_b - sizes_b, ends_a, side="left")
    link_a = np.repeat(np.arange(len(sizes_a)), last - first)
    return Links(np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), link_a, spans(first, last - first))


class Pair:
    """Both tokenizers, and what a worker remembers of words: (A's ids, B's ids)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, special=False), PieceModel(path_b)
        if not (self.a.cuts and self.b.cuts):
            raise ValueError("texts of these tokenizers can't be cut at words")
        self.known = TwoMemories(MOST_BYTES)
        self.names = [[f"{i}{mark}".encode() for i in range(max(len(self.a.sizes), len(self.b.sizes)))] for mark in ",|;"]
        self.letters = [np.frombuffer(b"".join(side.bytes), dtype=np.uint8) for side in (self.a, self.b)]
        self.letter_at = [np.cumsum(side.sizes) - side.sizes for side in (self.a, self.b)]

    def work(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the number of A's ids, these, and B's."""
        marks = np.zeros(len(data) + 1, dtype=np.int64)
        marks[1:] = np.cumsum(data == SPACE_MARK.encode()[1])
        apart = marks[ends] > marks[starts]  # words that may hold the space mark itself
        (flat_a, at_a, n_a), (flat_b, at_b, n_b) = (encode_pieces(data, starts, ends, side.encode, side.sizes, apart) for side in (self.a, self.b))
        sizes = 1 + n_a + n_b
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        out[begin] = n_a
        out[spans(begin + 1, n_a)] = flat_a[spans(at_a, n_a)]
        out[spans(begin + 1 + n_a, n_b)] = flat_b[spans(at_b, n_b)]
        return out, begin, sizes

    def exact(self, side: int, ids: np.ndarray, count: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each word's tokens have just its bytes."""
        token_sizes = (self.a, self.b)[side].sizes[ids]
        ends = np.append(0, np.cumsum(token_sizes))[np.append(0, np.cumsum(count))]
        out = np.diff(ends) == sizes
        rows = np.flatnonzero(out)
        letters = self.letters[side][spans(self.letter_at[side][ids], token_sizes)]
        equal = letters[spans(ends[:-1][rows], sizes[rows])] == data[spans(starts[rows], sizes[rows])]
        if len(rows):
            out[rows] = np.logical_and.reduceat(equal, np.cumsum(sizes[rows]) - sizes[rows])
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """One for each worker process: words stay known from task to task."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def packed(numbers: np.ndarray) -> bytes:
    """Compressed byte planes of numbers under 2**32."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(raw, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def word_texts(pair: Pair, ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], last: np.ndarray) -> list[bytes]:
    """'a1,a2|b1;a3|b2;' of each word; ``last`` is the last group of each."""
    group, side = np.concatenate(groups), np.repeat([0, 1], [len(ids[0]), len(ids[1])])
    order = np.argsort(2 * group + side, kind="stable")
    group, side, number = group[order], side[order], np.concatenate(ids)[order]
    mark = np.full(len(order), 2)
    mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
    parts = [pair.names[m][i] for m, i in zip(mark.tolist(), number.tolist(), strict=True)]
    ends = np.searchsorted(group, last, side="right").tolist()
    return [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def chunk_row(docs: list, texts: list[pa.Array], number: int, pair: Pair) -> pa.RecordBatch:
    """The row of a chunk: its documents, words, and pairs with counts."""
    column = pa.concat_arrays([t.cast(pa.large_string()).fill_null("") for t in texts])
    filled = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    data, offsets = S.flat(filled)
    starts = piece_starts(data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    keys, at, of = distinct(data, starts, ends, pair.known.seed)
    s, sizes = starts[at], (ends - starts)[at]
    flat, begin, count = pair.known.values(data, keys, s, sizes, lambda k: pair.work(data, s[k], s[k] + sizes[k]))
    n_a = flat[begin].astype(np.int64)
    n_b = count - 1 - n_a
    ids_a, ids_b = flat[spans(begin + 1, n_a)], flat[spans(begin + 1 + n_a, n_b)]
    good = pair.exact(0, ids_a, n_a, data, s, sizes) & pair.exact(1, ids_b, n_b, data, s, sizes)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = n_a * good, n_b * good

    found = align(pair.a.sizes[ids_a], pair.b.sizes[ids_b])
    word_a = np.repeat(np.arange(len(at)), n_a)
    last = np.append(-1, found.group_a)[np.cumsum(n_a)]
    n_groups = np.diff(np.append(-1, last))
    n_links = np.bincount(word_a[found.link_a], minlength=len(at))
    names = word_texts(pair, (ids_a, ids_b), (found.group_a, found.group_b), last)

    # documents whose words are all exact; others have no tokens
    word_ends = np.searchsorted(starts, offsets[1:])
    bad = np.append(0, np.cumsum(~good[of]))
    empty = np.diff(bad[np.append(0, word_ends)]) > 0
    whole = ~np.repeat(empty, np.diff(np.append(0, word_ends)))
    words = of[whole]
    word_ends = np.append(0, np.cumsum(whole))[word_ends]
    met = np.bincount(words, minlength=len(at))
    pairs = (ids_a[found.link_a].astype(np.int64) << 32) | ids_b[found.link_b]
    pair_keys, word_links = np.unique(pairs, return_inverse=True)
    counts = np.zeros(len(pair_keys), dtype=np.int64)
    np.add.at(counts, word_links, met[word_a[found.link_a]])

    bounds = np.append(0, word_ends)
    shas = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        shas.append(hashlib.sha256(b"".join([names[k] for k in words[a:b].tolist()])[:-1]).hexdigest() if b > a else "")
    sums = [np.append(0, np.cumsum(n[words]))[bounds] for n in (n_a, n_b, n_groups, n_links)]
    used = counts > 0
    row = [
        number, docs, word_ends, *[np.diff(x) for x in sums], shas, len(words), packed(words), len(word_links),
        packed((np.cumsum(used) - 1)[word_links] * used[word_links]), len(n_links), packed(np.cumsum(n_links)), pair_keys[used], counts[used],
    ]
    fields = pa_fields()
    return pa.RecordBatch.from_arrays([pa.array([v.tolist() if isinstance(v, np.ndarray) else v], t) for v, (_, t) in zip(row, fields, strict=True)], names=[n for n, _ in fields])


def pa_fields() -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [(name, kinds[kind]) for name, kind in (field.split() for field in CHUNK.split(", "))]


def make_chunks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's documents, in order."""
    from pyspark import TaskContext

    pair, number = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32
    docs: list = []
    texts: list[pa.Array] = []
    size = 0
    for batch in batches:
        offsets = S.flat(batch.column(1))[1]
        for first, last in S.pieces(offsets, CHUNK_BYTES // 4):
            more = int(offsets[last] - offsets[first])
            if docs and size + more > CHUNK_BYTES:
                yield chunk_row(docs, texts, number, pair)
                docs, texts, size, number = [], [], 0, number + 1
            docs += batch.column(0).slice(first, last - first).to_pylist()
            texts.append(batch.column(1).slice(first, last - first))
            size += more
    if docs:
        yield chunk_row(docs, texts, number, pair)


def add_counts(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk with the corpus-wide counts of their links."""
    answers = answers.sort_by("pos")
    row = {name: chunk[name][0] for name in chunk.column_names}
    n = {name: row[name].as_py() for name in ("n_words", "n_word_links", "n_link_ends")}
    words, links, ends = (unpacked(row[name].as_py(), n[f"n_{name}"]) for name in ("words", "word_links", "link_ends"))
    bounds = np.append(0, row["word_ends"].values.to_numpy())
    out = []
    for column in ("best", "count"):
        values = np.append(answers[column].to_numpy().astype(np.int64), 0)  # links of words without a document have no answer
        of_word = np.diff(np.append(0, np.cumsum(values[np.minimum(links, len(values) - 1)]))[np.append(0, ends)])
        out.append(np.diff(np.append(0, np.cumsum(of_word[words]))[bounds]))
    sums = [row[name].values for name in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([row["doc_ids"].values, *sums, *map(pa.array, out), row["groups"].values], names=[field.split()[0] for field in RESULT.split(", ")])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    A is a byte-level tokenizer and gets a space and the text, B a piece model that
    adds the space itself; strings of special tokens are plain text. A pair of ids
    counts as often as links of the corpus hold it; ``n_best`` are links whose count
    is the highest of their B id, ``count_sum`` sums the counts over links. Texts
    that are null or empty, or that either side's tokens don't give back byte by
    byte, have no tokens: zeros and an empty string. Ids must be integers (null
    stays null); repeated rows count each; other columns are ignored; an empty
    table gives an empty result. Tokenizers that join words raise ValueError.
    """
    space = Workspace(docs.sparkSession, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = space.keep(rows.mapInArrow(partial(make_chunks, path_a=path_a, path_b=path_b), CHUNK), "chunks")
    counted = chunks.select(F.pmod("chunk", F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    counted = counted.groupBy(F.col("x.keys").alias("key"), "salt").agg(F.sum("x.counts").alias("count"))
    counted = space.keep(counted.groupBy("key").agg(F.sum("count").alias("count")), "counted")
    with_b = counted.withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = space.keep(with_b.groupBy("b").agg(F.max("count").alias("highest")), "highest")  # at most B's vocabulary
    scored = join_checked(with_b, highest, "b", "inner", MOST_BROADCAST_ROWS)
    scored = space.keep(scored.select("key", "count", (F.col("count") == F.col("highest")).alias("best")), "scored")
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("keys").alias("pos", "key"))
    answers = join_checked(asked, scored, "key", "inner", MOST_BROADCAST_ROWS).select("of", "pos", "count", F.col("best").cast("int").alias("best"))
    own = chunks.drop("keys", "counts")
    return own.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(add_counts, RESULT)
