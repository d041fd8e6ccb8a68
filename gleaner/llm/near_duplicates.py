"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes the set of its word shingles, a digest of its words and a
   MinHash signature. Equal texts, by words, are one class and go on as one
   representative.
2. Representatives that agree in a band of the signature share a bucket.
3. A pair's signatures are compared batch by batch; it is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls under
   the chosen miss probability. Survivors are verified on the shingles of their
   whole texts, links merge components, and pairs within one component need no
   further look. Hashes only choose what is verified, and their seed is drawn anew.
4. First each bucket's most central member (its hub) is compared with the others:
   a group of many copies costs its size, not its square. Buckets whose members
   are in one component are done.
5. In the others every pair of two components is decided, within tasks on two
   blocks of a bucket each, and only in the first band on which the pair agrees.
   Signatures go first; texts follow for members that have a live pair.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import shingles as S
from gleaner.llm.storage import Workspace, join_checked
from gleaner.operators.components import connected_components

ROWS, BATCH = 4, 16
MISS = 1e-6
#: Members of a block; two blocks meet in a task.
BLOCK = 1024
#: A broadcast of so many ids stays under 8 MB; more are joined by shuffle.
MOST_BROADCAST_IDS = 200_000

def bands_for(least: float, miss: float) -> int:
    """Bands of ROWS that miss a pair of similarity ``least`` with probability
    under ``miss``, in whole batches of hashes: 20 at 0.85 and 28 at 0.8 for 1e-6."""
    bands = BATCH // ROWS
    while (1 - least**ROWS) ** bands >= miss:
        bands += BATCH // ROWS
    return bands


def signatures(hashes: np.ndarray, offsets: np.ndarray, bands: int) -> np.ndarray:
    """A row of 32-bit minima for each set; an empty set has zeros."""
    width = bands * ROWS
    seeds = (S.mix64(np.arange(1, 2 * width + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    xor, odd = seeds[:width], seeds[width:] | np.uint32(1)
    out = np.zeros((len(offsets) - 1, width), dtype=np.uint32)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for j in range(width):
            out[filled, j] = np.minimum.reduceat((short ^ xor[j]) * odd[j], offsets[filled])
    return out


def sketch(batches: Iterator[pa.RecordBatch], width: int, bands: int, seed: int) -> Iterator[pa.RecordBatch]:
    """id, n, digest of the sequence of words, signature of the shingle set."""
    for batch in batches:
        data, offsets = S.flat(batch.column(1))
        for first, last in S.pieces(offsets):
            low, high = offsets[first], offsets[last]
            hashes, owners = S.row_shingles(data[low:high], offsets[first : last + 1] - low, width, seed)
            sets, ends = S.distinct_sets(hashes, owners, last - first)
            signed = signatures(sets, ends, bands)
            texts = batch.column(1).slice(first, last - first).to_pylist()
            digests = [hashlib.blake2b(b" ".join(S.word_list(text)), digest_size=20).digest() for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.binary()), pa.array([row.tobytes() for row in signed], pa.binary())],
                names=["id", "n", "digest", "signature"],
            )


def similar(left: set[bytes], right: set[bytes], percent: int) -> bool:
    """Whether 100 * shared >= percent * union."""
    shared = len(left & right)
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def least_matches(least: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): with fewer the posterior is under miss.

    From a uniform prior, P(similarity >= least | m of n match) is the chance of
    at most m successes in n + 1 trials of probability ``least``.
    """
    out = []
    for n in range(BATCH, bands_for(least, miss) * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(batches: Iterator[pa.RecordBatch], needed: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs that no batch of hashes rules out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
        alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
        for n, least in needed:
            matches += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], n
        kept = pa.array(alive, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])


def verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose texts' shingles have 100 * shared >= percent * union."""
    last: list = [(None, set()), (None, set())]  # a hub's text comes again and again
    for batch in batches:
        keep = []
        for texts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            for k, text in enumerate(texts):
                if last[k][0] != text:
                    last[k] = text, S.shingle_set(text, width)
            keep.append(similar(last[0][1], last[1][1], percent))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def live_pairs(left: np.ndarray, right: np.ndarray, differ: np.ndarray, band: int, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and matches of pairs of ``differ`` that no batch rules out,
    and that agree in no band before ``band``; most matches first."""
    rows, columns = np.nonzero(differ)
    matches, done = np.zeros(len(rows), dtype=np.int64), 0
    for n, least in needed:
        for k in range(done, n):
            matches += left[rows, k] == right[columns, k]
        keep = matches >= least
        rows, columns, matches, done = rows[keep], columns[keep], matches[keep], n
    earlier = np.zeros(len(rows), dtype=bool)
    for b in range(band):
        same = np.ones(len(rows), dtype=bool)
        for k in range(ROWS * b, ROWS * (b + 1)):
            same &= left[rows, k] == right[columns, k]
        earlier |= same
    rows, columns, matches = rows[~earlier], columns[~earlier], matches[~earlier]
    order = np.argsort(-matches, kind="stable")
    return rows[order], columns[order], matches[order]


def two_blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Row numbers of the two blocks, signatures, which pairs to decide, the band."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block, comp = table["block"].to_numpy(), np.unique(table["comp"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    signed = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint32).reshape(table.num_rows, -1)
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    differ = comp[first][:, None] != comp[second][None, :]
    if i == j:
        differ = np.triu(differ, 1)
    return first, second, signed, differ, table["band"][0].as_py()


def live_members(table: pa.Table, needed: list[tuple[int, int]]) -> pa.Table:
    """The members of two blocks that have a live pair."""
    first, second, signed, differ, band = two_blocks(table)
    rows, columns, _ = live_pairs(signed[first], signed[second], differ, band, needed)
    live = pa.array(np.union1d(first[rows], second[columns]), pa.int64())
    return table.select(["key", "id"]).take(live)


def decide_blocks(table: pa.Table, needed: list[tuple[int, int]], width: int, percent: int, seed: int) -> pa.Table:
    """Links that join components of the members of two blocks; sets of hashes rule
    out what is far from alike, and shingles decide."""
    first, second, signed, differ, band = two_blocks(table)
    rows, columns, _ = live_pairs(signed[first], signed[second], differ, band, needed)
    texts = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    sets = []
    data, offsets = S.flat(texts)
    for low, high in S.pieces(offsets):
        found, owners = S.row_shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width, seed)
        flat, ends = S.distinct_sets(found, owners, high - low)
        sets += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    of = np.unique(table["comp"].to_numpy(zero_copy_only=False), return_inverse=True)[1].tolist()
    parent = list(range(max(of) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for x, y in zip(first[rows].tolist(), second[columns].tolist(), strict=True):
        p, q = root(of[x]), root(of[y])
        if p != q:
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared < percent * (len(sets[x]) + len(sets[y]) - shared) - 100:
                continue
            if similar(S.shingle_set(texts[x].as_py(), width), S.shingle_set(texts[y].as_py(), width), percent):
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
    ids = table["id"].combine_chunks() if isinstance(table["id"], pa.ChunkedArray) else table["id"]
    return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})


def in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each member of a bucket in every pair of blocks that its own block is in."""
    counted = join_checked(members, sizes, "key", "inner", MOST_BROADCAST_IDS)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = counted.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    others = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return others.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "m")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, miss: float = MISS, seed: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked where 100 * shared >= ``percent`` * union of their sets
    of word shingles; components close the links; the smallest id stays. A text
    of fewer words than ``width`` has one shingle, its whole sequence; a null
    text or one without words has none and is linked with nothing. There are so
    many bands that a pair at the threshold is missed with probability under
    ``miss``; links are verified on shingles, whatever the hashes. ``seed`` is that
    of the hashes, drawn anew by default so that no text can be written against it.
    Other columns are ignored; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    needed, bands = least_matches(percent / 100, miss), bands_for(percent / 100, miss)
    seed = secrets.randbits(63) if seed is None else seed
    sketched = rows.mapInArrow(partial(sketch, width=width, bands=bands, seed=seed), f"id {id_type}, n long, digest binary, signature binary")
    sketched = space.keep(sketched, "sketch")
    classes = space.keep(sketched.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    members = sketched.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = space.keep(members, "members")
    reps = sketched.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "signature").dropDuplicates(["id"])
    reps = space.keep(reps, "reps")
    space.drop("sketch", "classes")

    # buckets; of those with the same members the first band's stays
    slots = [F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(bands)]
    banded = reps.select("id", F.posexplode(F.array(*slots)).alias("band", "key"))
    found = banded.groupBy("key", "band").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    found = found.where("c > 1").groupBy("c", "x", "y").agg(F.min(F.struct("band", "key")).alias("at"))
    buckets = space.keep(found.select("at.key", "c"), "buckets")
    entries = space.keep(join_checked(banded, buckets, "key", "inner", MOST_BROADCAST_IDS), "entries")
    degrees = space.keep(entries.groupBy("id").agg(F.sum("c").alias("degree")), "degrees")

    # one hub for each bucket
    central = join_checked(entries, degrees, "id", "inner", MOST_BROADCAST_IDS)
    hubs = space.keep(central.groupBy("key").agg(F.max_by("id", F.struct("degree", F.xxhash64("id"))).alias("hub")), "hubs")
    pairs = join_checked(entries, hubs, "key", "inner", MOST_BROADCAST_IDS).where("id <> hub")
    pairs = space.keep(pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
    left, right = reps.select(F.col("id").alias("a"), F.col("signature").alias("left")), reps.select(F.col("id").alias("b"), F.col("signature").alias("right"))
    signed = join_checked(left, pairs, "a", "inner", MOST_BROADCAST_IDS).join(right, "b").select("a", "b", "left", "right")
    likely = space.keep(signed.mapInArrow(partial(prune, needed=needed), f"a {id_type}, b {id_type}"), "likely")
    asked = space.keep(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "asked")
    texts = space.keep(join_checked(rows, asked, "id", "left_semi", MOST_BROADCAST_IDS).dropDuplicates(["id"]), "texts")
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = join_checked(left, likely, "a", "inner", MOST_BROADCAST_IDS).join(right, "b").select("a", "b", "left", "right")
    links = space.keep(both.mapInArrow(partial(verify, width=width, percent=percent), f"a {id_type}, b {id_type}"), "links")
    labels = space.keep(connected_components(links), "labels")
    space.drop("texts", "likely", "asked", "pairs", "hubs", "degrees")

    # buckets that still hold several components
    named = labels.select(F.col("node").alias("id"), "component")
    here = join_checked(entries.select("key", "band", "id"), named, "id", "left", MOST_BROADCAST_IDS)
    here = space.keep(here.select("key", "band", "id", F.coalesce("component", "id").alias("comp")), "here")
    still = here.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    still = space.keep(still.where("low <> high and m > 2").select("key", "m"), "still")
    if still.limit(1).count():
        blocked = in_blocks(here, still).join(reps, "id")
        wanted = blocked.groupBy("key", "i", "j").applyInArrow(lambda t: live_members(t, needed), f"key long, id {id_type}")
        live = space.keep(wanted.distinct(), "live")
        asked = space.keep(live.select("id").distinct(), "asked2")
        texts = join_checked(rows, asked, "id", "left_semi", MOST_BROADCAST_IDS).dropDuplicates(["id"])
        texts = space.keep(texts.join(reps, "id"), "texts2")
        counts = space.keep(live.groupBy("key").agg(F.count("*").alias("m")), "counts")
        alive = join_checked(here, live, ["key", "id"], "left_semi", MOST_BROADCAST_IDS)
        blocked = in_blocks(alive, counts).join(texts, "id")
        more = blocked.groupBy("key", "i", "j").applyInArrow(lambda t: decide_blocks(t, needed, width, percent, seed), f"a {id_type}, b {id_type}")
        links = links.unionByName(space.keep(more, "links2"))
        labels = space.keep(connected_components(links), "labels2")
        space.drop("texts2", "live", "asked2", "counts")
    space.drop("reps", "buckets", "entries", "here", "still", "links")
    roots = labels.select(F.col("node").alias("rep"), "component")
    found = join_checked(members, roots, "rep", "left", MOST_BROADCAST_IDS).withColumn("component_id", F.coalesce("component", "rep"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
