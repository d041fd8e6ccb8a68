"""Phrases of a lexicon table found in texts: places, concepts, actions, names.

A lexicon has rows (alias, canonical, kind) and more columns as its kinds need. It
is joined by the first word of its aliases, so any number of phrases costs one
hash join over the texts' words; a small lexicon is broadcast after a count.

Counts need no row per occurrence: texts are made into blocks, a block gives one row
for each word and each likely phrase with the texts that have it, and those are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import plain_words, words
from gleaner.storage import Workspace, join_checked

#: Words of a text that are looked at in one row.
CHUNK_WORDS = 2048
#: Lexicon rows that are broadcast at most; a larger lexicon is joined by shuffle.
MOST_BROADCAST_ROWS = 50_000
#: Bytes of text in a block of :func:`phrase_counts`, about, and bits of its filter.
BLOCK_BYTES, FILTER_BITS = 8 << 20, 1 << 24

# Capitalised words that begin no name.
STOP_CAPS = (
    "The", "A", "An", "In", "On", "At", "Of", "For", "To", "And", "But", "Or", "As", "By", "With", "From", "After", "Before", "Over", "Under", "Into",
    "New", "Watch", "Video", "Explained", "Live", "Update", "Updates", "Breaking", "Big", "Top", "How", "Why", "What", "When", "Where", "Who", "Amid",
    "Says", "Said", "India", "Indian", "Tamil", "Nadu",
)
#: Kinds of places that are one spot; places of more districts than WIDE are not.
SPECIFIC, WIDE = ("water-body", "landmark", "city"), 3


def phrase_matches(docs: DataFrame, lexicon: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence: id, start, n_words, alias, the lexicon's other columns,
    nested.

    Words are lower-case runs of letters and digits, counted from 1. An alias matches
    where its words stand in a row; all aliases count, also several at one place.
    ``nested`` marks a match that lies within a longer one, so the others are the
    longest matches; matches that overlap in part are both kept. Aliases without a
    word match nothing, repeated lexicon rows count once, repeated documents are
    looked at by id; null and empty texts have no matches.
    """
    phrases = lexicon.where("alias is not null").distinct().withColumn("_words", words(F.col("alias"))).where("_words[0] <> ''")
    phrases = phrases.withColumns({"_first": F.col("_words")[0], "n_words": F.size("_words")})
    sizes = phrases.agg(F.count("*"), F.max("n_words")).first()
    most = sizes[1] or 1
    if sizes[0] <= MOST_BROADCAST_ROWS:
        phrases = F.broadcast(phrases)
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(F.array(words(F.col(text_col)))).alias("_all")).where("_all[0] <> '' or size(_all) > 1")
    begins = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / CHUNK_WORDS).cast("int"))
    chunks = F.transform(begins, lambda k: F.struct((k * CHUNK_WORDS).alias("before"), F.slice("_all", k * CHUNK_WORDS + 1, CHUNK_WORDS + most - 1).alias("words")))
    rows = rows.select("_id", F.explode(chunks).alias("c")).select("_id", "c.before", "c.words")
    places = F.transform(F.sequence(F.lit(1), F.least(F.size("words"), F.lit(CHUNK_WORDS))), lambda i: F.struct((i + F.col("before")).alias("start"), F.slice("words", i, most).alias("ahead")))
    found = rows.select("_id", F.explode(places).alias("p")).select("_id", "p.start", "p.ahead", F.col("p.ahead")[0].alias("_first"))
    found = found.join(phrases, "_first").where(F.slice("ahead", F.lit(1), F.col("n_words")) == F.col("_words"))
    found = found.drop("ahead", "_first", "_words").withColumnRenamed("_id", id_col)
    return _nested(found, [id_col], "start")


def _nested(found: DataFrame, text: list[str], start: str) -> DataFrame:
    """Adds ``nested``: within a longer match of the same text."""
    before = Window.partitionBy(*text).orderBy(start, F.desc("n_words")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col(start) + F.col("n_words")
    reach = F.max(F.struct(end.alias("end"), F.col("n_words").alias("n"))).over(before)
    return found.withColumn("nested", (reach["end"] > end) | ((reach["end"] == end) & (reach["n"] > F.col("n_words"))))


def _bits(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Where words' hashes, or those of neighbouring words, stand in the filter."""
    both = first if second is None else (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    return ((both ^ (both >> np.uint64(29))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap of a task's phrases: of single words, and of others' first two words."""
    marked = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        first, second = _hashes(batch.column(0)), batch.column(1)
        single = second.is_null().to_numpy(zero_copy_only=False)
        marked[_bits(first[single])] = True
        marked[_bits(first[~single], _hashes(second.drop_null()))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marked).tobytes()], pa.binary())], names=["bits"])


class Block(NamedTuple):
    """Words of some texts, in order: their codes, the distinct words, each word's text
    and where texts end."""

    code: np.ndarray
    known: pa.Array
    doc: np.ndarray
    ends: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Texts of plain words, about BLOCK_BYTES at a time."""
    for batch in batches:
        texts = batch.column(0)
        share = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), len(texts)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                split = pc.split_pattern(texts.slice(i, j - i), " ")
                sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = split.flatten().dictionary_encode()
                yield Block(coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.repeat(np.arange(j - i), sizes), np.cumsum(sizes))


def _postings(batches: Iterator[pa.RecordBatch], marked: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """(block, n, key, hits, docs, starts): for each word of a block that the filter lets
    through (n = 1) its hits and the texts that have it, and for each run of ``most``
    words (less at a text's end) that may begin a phrase its places (n = 2)."""
    likely = np.unpackbits(np.frombuffer(marked, np.uint8)).view(bool)
    first = TaskContext.get().partitionId() << 32
    for block, (code, known, doc, ends) in enumerate(_blocks(batches), first):

        def rows(n: int, keys: pa.Array, cuts: np.ndarray, docs: np.ndarray, starts: np.ndarray | None, hits: np.ndarray, block: int = block) -> pa.RecordBatch:
            lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
            places = pa.nulls(len(keys), pa.list_(pa.int32())) if starts is None else lists(starts)
            columns = [pa.array(np.full(len(keys), block), pa.int64()), pa.array(np.full(len(keys), n), pa.int32()), keys, pa.array(hits, pa.int64()), lists(docs), places]
            return pa.RecordBatch.from_arrays(columns, names=["block", "n", "key", "hits", "docs", "starts"])

        hashes, n = _hashes(known), len(ends)
        good = likely[_bits(hashes)]
        at = np.flatnonzero(good[code])
        pairs = np.unique(code[at] * n + doc[at])
        used = np.flatnonzero(good)
        cuts = np.searchsorted(pairs, np.append(used, len(known)) * n)
        yield rows(1, known.take(pa.array(used)), cuts, pairs % n, None, np.bincount(code, minlength=len(known))[used])
        if most > 1 and len(code) > 1:
            of = hashes[code]
            at = np.flatnonzero((doc[:-1] == doc[1:]) & likely[_bits(of[:-1], of[1:])])
            width = np.minimum(most, ends[doc[at]] - at)
            each = np.concatenate([[0], np.cumsum(width)])
            reach = np.repeat(at - each[:-1], width) + np.arange(each[-1])
            ahead = pc.binary_join(pa.ListArray.from_arrays(pa.array(each, pa.int32()), known.take(pa.array(code[reach]))), " ").dictionary_encode()
            key = ahead.indices.to_numpy().astype(np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.searchsorted(key[order], np.arange(len(ahead.dictionary) + 1))
            at = at[order]
            begin = np.append(0, ends)[doc[at]]
            yield rows(2, ahead.dictionary, cuts, doc[at], at - begin + 1, np.diff(cuts))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, docs): words and neighbouring pairs of words of each block, with the number
    of its texts that have them."""
    for code, known, doc, ends in _blocks(batches):
        n = len(ends)
        single = np.bincount(np.unique(code * n + doc) // n, minlength=len(known))
        yield pa.RecordBatch.from_arrays([known, pa.nulls(len(known), pa.string()), pa.array(single, pa.int64())], names=["x", "y", "docs"])
        beside = np.flatnonzero(doc[:-1] == doc[1:])
        kinds, kind = np.unique(code[beside] * len(known) + code[beside + 1], return_inverse=True)
        docs = np.bincount(np.unique(kind * n + doc[beside]) // n, minlength=len(kinds))
        pair = [known.take(pa.array(k)) for k in (kinds // len(known), kinds % len(known))]
        yield pa.RecordBatch.from_arrays([*pair, pa.array(docs, pa.int64())], names=["x", "y", "docs"])


def _by_id(rows: DataFrame, id_col: str, space: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other has, and the rest if there is any: null and repeated ids."""
    again = space.keep(rows.groupBy(F.col(id_col).alias("_again")).count().where("count > 1 or _again is null").select("_again"), "again")
    if not again.limit(1).count():
        return rows, None
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    return tuple(join_checked(rows, again, same, how, MOST_BROADCAST_ROWS) for how in ("left_anti", "left_semi"))


def gram_documents(rows: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(x, y, docs): each word (y null) and each pair of neighbouring words of texts and
    the number of ids that have it; words as in :func:`phrase_matches`, null ids don't
    count. An empty text has the empty word."""
    own, rest = _by_id(rows, id_col, Workspace(rows.sparkSession, "grams"))
    found = own.select(plain_words(F.col(text_col)).alias("text")).where("text is not null").mapInArrow(_grams, "x string, y string, docs long")
    if rest is not None:
        w = F.col("w")
        both = F.concat(F.transform(w, lambda x: F.struct(x.alias("x"), F.lit(None).cast("string").alias("y"))), F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
        each = rest.select(F.col(id_col).alias("id"), F.explode(F.array(words(F.col(text_col)))).alias("w")).select("id", F.explode(F.array_distinct(both)).alias("g"))
        again = each.groupBy("g.x", "g.y").agg(F.count_distinct("id").alias("docs"))
        found = found.unionByName(again)
    return found.groupBy("x", "y").agg(F.sum("docs").alias("docs"))


def phrase_counts(docs: DataFrame, lexicon: DataFrame, by: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """matches, docs and nested of each value of ``by``, columns of the lexicon: how many
    rows of :func:`phrase_matches` it has, in how many documents, and how many are nested.

    Words are counted within blocks of whole texts, so a frequent word is one row of a
    block with the texts that have it. A filter of fixed size keeps away most words and
    pairs of words that begin no phrase; the joins decide. Words are nested where a
    phrase covers them. Rows whose id is null or not the only one go by their matches.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "phrases")
    split = lexicon.where("alias is not null").distinct().select(*by, words(F.col("alias")).alias("w")).where("w[0] <> ''")
    phrases = space.keep(split.select(*by, F.array_join("w", " ").alias("phrase"), F.size("w").alias("n_words"), F.col("w")[0].alias("first"), F.get("w", F.lit(1)).alias("second")), "lexicon")
    most = phrases.agg(F.max("n_words")).first()[0] or 1
    maps = phrases.select("first", "second").distinct().coalesce(8).mapInArrow(_filters, "bits binary").collect()
    marked = spark.sparkContext.broadcast(np.bitwise_or.reduce([np.frombuffer(m["bits"], np.uint8) for m in maps] or [np.zeros(FILTER_BITS // 8, np.uint8)]).tobytes())
    own, rest = _by_id(docs, id_col, space)
    texts = own.select(plain_words(F.col(text_col)).alias("text")).where("text <> ''")
    found = space.keep(texts.mapInArrow(lambda batches: _postings(batches, marked.value, most), "block long, n int, key string, hits long, docs array<int>, starts array<int>"), "postings")
    one, more = phrases.where("n_words = 1").select(*by, "phrase"), phrases.where("n_words > 1").select(*by, "phrase")
    no = F.lit(0).cast("long")
    hits = found.where("n = 1").withColumnRenamed("key", "phrase").join(one, "phrase").select("block", *by, "hits", "docs", no.alias("nested"))
    if most > 1:
        ahead = found.where("n = 2").withColumn("w", F.split("key", " "))
        heads = F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.array_join(F.slice("w", F.lit(1), k), " "))
        ahead = ahead.select("block", "docs", "starts", F.explode(heads).alias("phrase"))
        named = space.keep(ahead.join(more.select("phrase").distinct(), "phrase", "left_semi"), "named")
        places = named.select("block", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), F.explode(F.arrays_zip("docs", "starts")).alias("p")).select("block", "phrase", "n_words", "p.docs", "p.starts")
        within = F.explode(F.transform(F.split("phrase", " "), lambda w, k: F.struct((F.col("starts") + k).alias("at"), w.alias("word"))))
        inner = places.select("block", "docs", within.alias("c")).distinct().groupBy(F.col("c.word").alias("phrase")).agg(F.count("*").alias("nested")).join(one, "phrase")
        if most > 2:
            nested = _nested(places, ["block", "docs"], "starts").where("nested").groupBy("phrase").agg(F.count("*").alias("nested")).join(more, "phrase")
            inner = inner.select(*by, "nested").unionByName(nested.select(*by, "nested"))
        hits = hits.unionByName(named.join(more, "phrase").select("block", *by, F.size("docs").cast("long").alias("hits"), "docs", no.alias("nested")))
        hits = hits.unionByName(inner.select(F.lit(None).cast("long").alias("block"), *by, no.alias("hits"), F.array().cast("array<int>").alias("docs"), "nested"))
    blocks = hits.groupBy("block", *by).agg(F.sum("hits").alias("matches"), F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).cast("long").alias("docs"), F.sum("nested").alias("nested"))
    if rest is not None:
        few = phrase_matches(rest, lexicon, id_col=id_col, text_col=text_col)
        few = few.groupBy(*by).agg(F.count("*").alias("matches"), F.count_distinct(id_col).alias("docs"), F.count_if("nested").alias("nested"))
        blocks = blocks.unionByName(few.withColumn("block", F.lit(None).cast("long")))
    return blocks.groupBy(*by).agg(F.sum("matches").alias("matches"), F.sum("docs").alias("docs"), F.sum("nested").alias("nested"))


def places_of(matches: DataFrame, id_col: str) -> DataFrame:
    """id and ``places`` of the matches of a place lexicon: the struct that
    :func:`place_relation` takes. Kinds are state, country, district, region and
    those of SPECIFIC; ``districts`` is an array of the districts a place lies in."""
    narrow = F.size(F.coalesce("districts", F.array().cast("array<string>"))) <= WIDE
    rows = matches.select(id_col, "canonical", "kind", "districts", narrow.alias("narrow"))

    def named(when: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(when, F.col("canonical"))))

    inside = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind") == "district", F.array("canonical")).when(F.col("narrow"), F.col("districts"))))))
    found = rows.groupBy(id_col).agg(
        named(F.col("kind") == "state").alias("states"),
        F.bool_or(F.col("kind").isin("state", "country")).alias("wide"),
        inside.alias("districts"),
        F.bool_or(F.col("kind") == "district").alias("district_named"),
        named(F.col("kind").isin(*SPECIFIC) & F.col("narrow")).alias("specific"),
        named(F.col("kind") == "region").alias("regions"),
    )
    return found.select(id_col, F.struct("states", "wide", "districts", "district_named", "specific", "regions").alias("places"))


def place_relation(a: Column, b: Column) -> Column:
    """How two sides' places relate; a null struct names no place."""

    def shared(name: str) -> Column:
        return F.coalesce(F.arrays_overlap(a[name], b[name]), F.lit(False))

    def has(side: Column, name: str) -> Column:
        return F.size(side[name]) > 0

    states, districts = has(a, "states") & has(b, "states"), has(a, "districts") & has(b, "districts")
    around = (a["wide"] & ~a["district_named"]) | (b["wide"] & ~b["district_named"])
    return (
        F.when(a.isNull() | b.isNull(), "unknown")
        .when(states & ~shared("states"), "different")
        .when(shared("specific"), "same")
        .when(districts & shared("districts"), "same")
        .when(districts & around, "nested")
        .when(districts, "sibling")
        .when((has(a, "districts") & has(b, "states")) | (has(b, "districts") & has(a, "states")), "nested")
        .when(shared("regions") | states, "same-region-only")
        .otherwise("unknown")
    )


def names(title: Column) -> Column:
    """Capitalised runs of a title, lower-cased: each run of more than three letters,
    and of runs of three words and more also the last word (from five letters) and
    the first two. Initials and words of STOP_CAPS end a run."""
    bare = F.transform(F.split(F.regexp_replace(title, r"[^\p{L}\p{N}\s.]", " "), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    marked = F.transform(bare, lambda w: F.when((F.length(w) > 1) & w.rlike("^[A-Z]") & ~w.isin(*STOP_CAPS), w).otherwise("|"))
    runs = F.filter(F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")

    def of(run: Column) -> Column:
        parts = F.split(run, " ")
        last, lead = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, 2), " ")
        long = F.size(parts) >= 3
        return F.array(F.when(F.length(run) > 3, F.lower(run)), F.when(long & (F.length(last) >= 5), F.lower(last)), F.when(long & (F.length(lead) > 3), F.lower(lead)))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(runs, of)), lambda r: r.isNotNull())))


def concept_overlap(a: Column, b: Column, equivalent: tuple[tuple[str, str], ...], generic: tuple[str, ...]) -> tuple[Column, Column]:
    """(number of a's concepts that b has by itself or by an equivalent, that over the
    smaller number of concepts). Generic concepts don't count; not symmetric."""
    same: dict[str, list[str]] = {}
    for p, q in equivalent:
        same.setdefault(p, []).append(q)
        same.setdefault(q, []).append(p)
    plain = lambda side: F.filter(side, lambda x: ~x.isin(*generic)) if generic else side
    meets = lambda x: F.array_contains(b, x)
    if same:
        others = F.create_map(*[v for k, values in sorted(same.items()) for v in (F.lit(k), F.array(*[F.lit(x) for x in values]))])
        meets = lambda x: F.array_contains(b, x) | F.coalesce(F.arrays_overlap(b, others[x]), F.lit(False))
    shared = F.size(F.filter(plain(a), meets))
    least = F.greatest(F.least(F.size(plain(a)), F.size(plain(b))), F.lit(1))
    return shared, shared / least
