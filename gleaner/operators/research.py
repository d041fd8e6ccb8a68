"""Record linkage, containment and grounded summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators.topk import first_per_group
from gleaner.storage import Workspace

#: Words of a tile, about, and the letters from which a shared word counts twice.
MENTION_WORDS, ITEM_WORDS, LONG_WORD = 250_000, 1_000_000, 8


def word_shingles(text: Column, width: int = 5) -> Column:
    """Distinct shingles of lower-case words of letters and digits; none if shorter."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        found = F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))
        return F.when(F.size(w) >= width, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return X.with_value(words, grams)


def containment_join(texts: DataFrame, records: DataFrame, key: str, record_key: str, least: float, width: int = 5) -> DataFrame:
    """(key, record, shared, containment): records of which a text holds at least
    ``least`` of the shingles. Joined on shingles; only keys are aggregated."""
    a = texts.select(F.col(key).alias("k"), F.explode(word_shingles(F.col("body"), width)).alias("s"))
    grams = records.select(F.col(record_key).alias("r"), word_shingles(F.col("text"), width).alias("g"))
    b = grams.select("r", F.size("g").alias("n"), F.explode("g").alias("s"))
    counts = a.join(b, "s").groupBy("k", "r", "n").agg(F.count("*").alias("shared"))
    found = counts.withColumn("containment", F.col("shared") / F.col("n")).where(F.col("containment") >= least)
    return found.select(F.col("k").alias(key), F.col("r").alias(record_key), "shared", "containment")


def search_records(claims: DataFrame, records: DataFrame, key: str, record_key: str, k: int = 3, least: float = 0.4) -> DataFrame:
    """The ``k`` best records of each claim by the share of its words they have,
    with a bonus for a shared long word; ties go to the smaller record."""
    a = claims.select(key, F.array_distinct(X.tokens(F.col("body"))).alias("w")).where(F.size("w") > 0)
    b = records.select(F.col(record_key), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("t"))
    words = a.select(key, F.size("w").alias("n"), F.explode("w").alias("t"))
    scores = words.join(b, "t").groupBy(key, record_key, "n").agg(F.count("*").alias("shared"), F.max(F.length("t")).alias("longest"))
    relevance = F.col("shared") / F.col("n") + F.when(F.col("longest") >= 9, 0.2).otherwise(0.0)
    scored = scores.withColumn("relevance", F.round(relevance, 6)).where(F.col("relevance") >= least)
    return first_per_group(scored, [key], [F.desc("relevance"), F.col(record_key)], k).select(key, record_key, "shared", "relevance", "place")


def echo_gate(families: Column, echoing: Column, anchors: Column) -> Column:
    """What is left of a story once families that echo one record count as one."""
    genuine = families - echoing
    return (
        F.when(genuine >= 2, "independent").when((genuine == 1) & (anchors > 0), "one-family-and-record").when((genuine == 0) & (anchors > 0), "record-only")
        .when(genuine == 1, "single-family").otherwise("echo-only")
    )


# Units of figures, what a unit is called, months, and types of claims that records can answer.
_UNITS = r"(crore|lakh|per cent|percent|%|mm|cusecs?|kmph|bps|points?|billion|dead|killed|died|injured|missing)"
_NUMBER = rf"(?i)[0-9][0-9,]*(?:\.[0-9]+)?\s*{_UNITS}?"
UNIT_NAMES = {"per cent": "%", "percent": "%", "cusec": "cusecs", "killed": "dead", "died": "dead", "point": "points"}
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
_DATE = rf"(?i)\b[0-9]{{1,2}}\s+{_MONTH}[a-z]*|{_MONTH}[a-z]*\s+[0-9]{{1,2}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b"
QUERY_TYPES = [
    ("weather_event", r"(?i)\b(rain|cyclone|flood|imd|alert|warning)\b"), ("court", r"(?i)\b(court|bench|plea|petition|verdict)\b"),
    ("scheme_allocation", "(?i)₹|crore|lakh|allocat|sanction"), ("official_action", r"(?i)\b(government|minister|announce|launch|resolution|order)\b"),
]
CHECKABLE = r"(?i)[0-9]|\b(court|government|minister|imd|rbi|announce|order|reject|sanction|appoint)\b"
#: Adapters that records of a type come from, in order.
ROUTES = (
    ("weather_event", "imd_rmc_chennai"), ("court", "ecourts"), ("official_action", "tn_dipr"), ("official_action", "pib"), ("official_action", "tn_gazette"),
    ("scheme_allocation", "tn_dipr"), ("scheme_allocation", "pib"), ("scheme_allocation", "data_gov_in"),
)
MOST_FIGURES, MOST_DATES, MOST_NAMES, MOST_ADAPTERS, TRIGGER_HOURS = 8, 6, 10, 3, 72


def figures_with_units(text: Column) -> Column:
    """The first distinct figures of a text as structs of value and unit ('' for none)."""

    def figure(m: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(m, r"^([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").cast("double")
        unit = F.lower(F.regexp_extract(m, f"(?i){_UNITS}$", 1))
        named = F.lit(None).cast("string")
        for name, to in UNIT_NAMES.items():
            named = F.when(unit == name, to).otherwise(named)
        return F.struct(value.alias("value"), F.coalesce(named, unit).alias("unit"))

    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), figure)), 1, MOST_FIGURES)


def trigger(families: Column, anchored: Column, age_hours: Column, text: Column) -> Column:
    """Whether a story is worth research: one family or none, no primary record, at most
    TRIGGER_HOURS old, and something in its text that a record can answer."""
    return F.coalesce((families < 2) & ~anchored & (age_hours <= TRIGGER_HOURS) & text.rlike(CHECKABLE), F.lit(False))


def record_query(text: Column) -> Column:
    """A struct of what to look for: type, names, figures, dates; empty arrays for none."""
    proper = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{3,}(?:\s+[A-Z][a-z]{3,}){0,3}"), F.lit(0)), lambda n: F.trim(n))
    names = F.slice(F.array_distinct(F.filter(proper, lambda n: ~n.rlike("^(?i)(The|This|That|Tamil Nadu|India)$"))), 1, MOST_NAMES)
    dates = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))), 1, MOST_DATES)
    return F.struct(X.first_match(text, QUERY_TYPES, "other").alias("type"), names.alias("names"), figures_with_units(text).alias("figures"), dates.alias("dates"))


def routed(queries: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """(key, type, adapter, place): at most MOST_ADAPTERS adapters of the query's type, in
    the order of ``routes`` (type, adapter, ord); types without a route have none."""
    found = queries.select(key, "type").join(routes, "type")
    return first_per_group(found, [key], [F.col("ord"), F.col("adapter")], MOST_ADAPTERS).select(key, "type", "adapter", "place")


def figure_outcome(claimed: Column, recorded: Column, certain: Column) -> Column:
    """How a record's figures bear on a claim's (arrays of value and unit): corroborated
    if each of the claim's has one of its unit within 2 %, contradicted if ``certain`` and
    one has only others of its unit, else not_found; claims without figures aren't found."""
    near = lambda c, r: (c["unit"] == r["unit"]) & (F.abs(c["value"] - r["value"]) <= 0.02 * F.greatest(c["value"], r["value"]))
    matched = F.forall(claimed, lambda c: F.exists(recorded, lambda r: near(c, r)))
    against = F.exists(claimed, lambda c: F.exists(recorded, lambda r: c["unit"] == r["unit"]) & ~F.exists(recorded, lambda r: near(c, r)))
    return F.when((F.size(claimed) > 0) & matched, "corroborated").when(certain & against, "contradicted").otherwise("not_found")


def best_in_tile(mentions: pa.Table, items: pa.Table, least: int) -> pa.Table:
    """Of each mention the item of the tile with the highest score, then the least id."""
    items = items.sort_by("id")
    words, owner = items["words"].combine_chunks().flatten().dictionary_encode(), np.repeat(np.arange(items.num_rows), pc.list_value_length(items["words"]).to_numpy())
    codes = words.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))
    owner = owner[order]
    weight = np.where(pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False) >= LONG_WORD, 2, 1)
    lists = mentions["words"].combine_chunks()
    asked = pc.fill_null(pc.index_in(lists.flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
    begin, rows, best, scores = 0, [], [], []
    for i, end in enumerate(np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))):
        found = [(owner[ends[c - 1] if c else 0 : ends[c]], weight[c]) for c in asked[begin:end] if c >= 0]
        begin = end
        if not found:
            continue
        score = np.bincount(np.concatenate([o for o, w in found for _ in range(w)]))
        top = int(score.argmax())
        if score[top] >= least:
            rows.append(i)
            best.append(top)
            scores.append(int(score[top]))
    ids = items["id"].combine_chunks().take(pa.array(best, pa.int64()))
    return pa.table({"words": mentions["words"].combine_chunks().take(pa.array(rows, pa.int64())), "id": ids, "score": pa.array(scores, pa.int64())})


def best_by_shared_words(mentions: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(words, id, score): for each distinct ``words`` of ``mentions`` the row of ``items``
    (id, words) with the highest score from ``least``, then the least id. Words that both
    have score 1, from LONG_WORD letters 2, as often as they stand on both sides; lists
    are sorted.

    Each tile of mentions meets each tile of items in one task, which keeps only the best
    item of each mention, so the pairs that share a word are never written. Tiles hold a
    bounded number of words; equal lists of words are looked at once.
    """
    space = Workspace(mentions.sparkSession, "shared-words")
    asked = space.keep(mentions.where(F.size("words") > 0).select("words").distinct(), "mentions")
    given = space.keep(items.where(F.size("words") > 0).groupBy("words").agg(F.min("id").alias("id")), "items")

    def tiles(rows: DataFrame, most: int) -> int:
        return max(1, -(-(rows.agg(F.sum(F.size("words"))).first()[0] or 0) // most))

    n, k = tiles(asked, MENTION_WORDS), tiles(given, ITEM_WORDS)

    def numbers(own: str, count: int, other: str, others: int) -> list[Column]:
        return [F.pmod(F.xxhash64("words"), F.lit(count)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)]

    left, right = asked.select("words", *numbers("x", n, "y", k)), given.select("id", "words", *numbers("y", k, "x", n))

    def best(mentions: pa.Table, items: pa.Table) -> pa.Table:
        return best_in_tile(mentions, items, least)

    kind = dict(items.dtypes)["id"]
    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(best, f"words array<string>, id {kind}, score long")
    return found.groupBy("words").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b")).select("words", "b.id", "b.score")
