"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a whole document's MinHash says
nothing about an item inside it. Items are partitioned by the size of their
shingle set, into classes of up to 2**c shingles. For each class the domain is
cut into windows of two neighbouring blocks of 2**c shingles: any passage of an
item lies within one window, and the Jaccard similarity of item and window has a
bound that depends on the containment alone. A shared minimum in any of the hash
functions makes a candidate, and candidates are verified by exact containment of
the item's shingles in the whole document.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import shingles as S

#: Hash functions; an item with 80 % of its shingles in a window is missed with probability under 2e-6.
HASHES = 64
#: Text of the items that one scan carries to the tasks; more items take more scans.
BLOCK_CHARS = 8_000_000

_SEEDS = S.mix64(np.arange(1000, 1000 + 2 * HASHES, dtype=np.uint64))
_XOR = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32)
_ODD = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Items(NamedTuple):
    ids: list
    texts: list
    sets: list
    #: class -> per hash function: bit table of low bits, sorted minima, their items
    tables: dict
    seed: int


def permuted(short: np.ndarray, j: int) -> np.ndarray:
    return (short ^ _XOR[j]) * _ODD[j]


def index_items(ids: list, texts: list, width: int, seed: int = 0) -> Items:
    data, offsets = S.flat(pa.array(texts, pa.string()))
    hashes, owners = S.row_shingles(data, offsets, width, seed)
    flat, ends = S.distinct_sets(hashes, owners, len(texts))
    sets = [flat[ends[i] : ends[i + 1]] for i in range(len(texts))]
    tables = {}
    sizes = np.diff(ends)
    classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for c in sorted(set(classes[sizes > 0].tolist())):
        chosen = np.flatnonzero((classes == c) & (sizes > 0))
        tables[c] = []
        for j in range(HASHES):
            low = np.array([permuted((sets[i] >> np.uint64(32)).astype(np.uint32), j).min() for i in chosen])
            order = np.argsort(low, kind="stable")
            bits = np.zeros(65536, dtype=bool)
            bits[low & 0xFFFF] = True
            tables[c].append((bits, low[order], chosen[order]))
    return Items(ids, texts, sets, tables, seed)


def candidates(hashes: np.ndarray, owners: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(row, item) pairs of which a window and the item share a minimum."""
    found: set[tuple[int, int]] = set()
    if not len(hashes):
        return found
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    fresh = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    place = np.arange(len(hashes)) - np.repeat(fresh, np.diff(np.append(fresh, len(hashes))))
    layout = {}
    for c in items.tables:
        starts = np.flatnonzero(place % (1 << c) == 0)
        rows = owners[starts]
        layout[c] = starts, rows, np.flatnonzero(rows[1:] == rows[:-1])
    for j in range(HASHES):
        values = permuted(short, j)
        for c, (starts, rows, pairs) in layout.items():
            bits, minima, members = items.tables[c][j]
            lows = np.minimum.reduceat(values, starts)
            windows = lows.copy()
            windows[pairs] = np.minimum(lows[pairs], lows[pairs + 1])
            hit = np.flatnonzero(bits[windows & 0xFFFF])
            if len(hit):
                first, last = np.searchsorted(minima, windows[hit], "left"), np.searchsorted(minima, windows[hit], "right")
                for w, a, b in zip(hit, first, last, strict=True):
                    found.update((int(rows[w]), int(i)) for i in members[a:b])
    return found


def search(batches: Iterator[pa.RecordBatch], items: Items, width: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = S.flat(batch.column(1))
        for first, last in S.pieces(offsets):
            low, high = offsets[first], offsets[last]
            hashes, owners = S.row_shingles(data[low:high], offsets[first : last + 1] - low, width, items.seed)
            rows, out = {}, []
            for row, i in sorted(candidates(hashes, owners, items)):
                if row not in rows:
                    rows[row] = np.unique(hashes[np.searchsorted(owners, row) : np.searchsorted(owners, row, "right")]), None
                near = len(np.intersect1d(rows[row][0], items.sets[i], assume_unique=True))
                if near < least * len(items.sets[i]):
                    continue
                if rows[row][1] is None:
                    rows[row] = rows[row][0], S.shingle_set(batch.column(1)[first + row].as_py(), width)
                wanted = S.shingle_set(items.texts[i], width)
                shared = len(wanted & rows[row][1])
                if shared >= least * len(wanted):
                    out.append((first + row, items.ids[i], len(wanted), shared))
            if out:
                at, ids, n, shared = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(n, pa.int64()), pa.array(shared, pa.int64())],
                    names=["doc", "body_key", "n_item_shingles", "n_shared"],
                )


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """A row for each document and item it contains: ids, n_item_shingles,
    n_shared, containment (shared / n_item_shingles >= ``least``).

    Distinct item texts go to the tasks in blocks of about ``BLOCK_CHARS``, each
    with its own scan of ``docs``, so what is broadcast is bounded whatever the
    number of items and repetitions. An item without words matches nothing; one of fewer words than
    ``width`` matches only a document of just these words. Null and empty texts
    have no rows; repeated items and documents have a row each; other columns are
    ignored.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("body"))
    items = items.withColumn("body_key", F.sha2("body", 256))
    bodies = items.dropDuplicates(["body_key"])
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    doc_type, seed = dict(rows.dtypes)["doc"], secrets.randbits(63)
    chars = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    found = None
    for k in range(blocks):
        block = bodies.where(F.pmod(F.xxhash64("body_key"), F.lit(blocks)) == k).select("body_key", "body").collect()
        index = spark.sparkContext.broadcast(index_items([r["body_key"] for r in block], [r["body"] for r in block], width, seed))

        def task(batches, index=index):
            return search(batches, index.value, width, least)

        part = rows.mapInArrow(task, f"doc {doc_type}, body_key string, n_item_shingles long, n_shared long")
        found = part if found is None else found.unionByName(part)
    found = found.join(items.select("body_key", "item"), "body_key")
    return found.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_id_col),
        "n_item_shingles",
        "n_shared",
        (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"),
    )
