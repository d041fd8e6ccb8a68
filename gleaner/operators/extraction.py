"""What single sentences say: figures, speakers, markets, policy, fixtures, acts,
times, local effects, corrections; guards on generated text. Column functions,
null for null text; the lists below are English and meant to be extended."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.quantities import number_token
from gleaner.functions.text import tokens, with_value

# Kinds of figures and the words that name them.
FIGURES = (
    ("deaths", "dead|killed|died|deaths"), ("injuries", "injured|hurt|wounded"), ("missing", "missing"), ("rescued", "rescued"),
    ("houses_damaged", "houses|homes"), ("relief_camps", "relief camps|camps"), ("rainfall_mm", "mm|millimetres"), ("wind_kmph", "kmph|km/h"), ("amount", "crore|lakh"),
)
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?|one|two|three|four|five|six|seven|eight|nine|ten|dozen|hundred)"
SPEECH = "said|says|told|announced|claimed|alleged|warned|stated"
ALLOWED = {
    ("court", "ordered"), ("court", "stayed"), ("government", "announced"), ("government", "ordered"), ("government", "approved"), ("police", "arrested"), ("police", "registered"),
    ("collector", "ordered"), ("collector", "announced"), ("commission", "ordered"), ("minister", "announced"), ("minister", "inaugurated"),
}
ACTS = (("denies", r"\b(denied|denies|rejected|refuted)\b"), ("alleges", r"\b(alleged|accused|accuses)\b"), ("demands", r"\b(demanded|demands|urged)\b"), ("announces", r"\b(announced|launched|inaugurated)\b"), ("criticises", r"\b(criticised|slammed|condemned)\b"), ("meets", r"\b(met|meets)\b"))
INJECTION = r"(?i)ignore (all |the )?(previous|above)|system prompt|you are now|disregard .{0,20}instructions|</?(system|assistant)>"


def sentences(title: Column, excerpt: Column) -> Column:
    """Parts of over 12 characters, cut at sentence ends and spaced dashes."""
    parts = F.split(F.concat_ws(". ", title, excerpt), r"[.!?]+\s+|\s+[–—-]\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 12)


def named_numbers(kind: str, values: Column) -> Column:
    return F.transform(values, lambda n: F.struct(F.lit(kind).alias("kind"), number_token(n).alias("value")))


def figures(sentence: Column) -> Column:
    """Array of {kind, value}: the number right before a kind's words."""
    low = F.lower(sentence)
    found = []
    for kind, words in FIGURES:
        pattern = rf"\b{NUMBER} (?:people |persons |workers |fishermen )?(?:were |are |feared )?(?:{words})\b"
        found.append(named_numbers(kind, F.regexp_extract_all(low, F.lit(pattern), F.lit(1))))
    return F.concat(*found)


def speaker(sentence: Column) -> Column:
    """Who is said to say it: before the verb, after it, or 'according to'."""
    name = r"((?:[A-Z][\w.]+ ?){1,4})"
    tries = [rf"[Aa]ccording to (?:the )?{name}", rf"^(?:The )?{name} (?:has |have )?(?:{SPEECH})", rf"(?:{SPEECH}) (?:the )?{name}"]
    return F.nullif(F.trim(F.coalesce(*[F.nullif(F.regexp_extract(sentence, p, 1), F.lit("")) for p in tries])), F.lit(""))


def official_action(sentence: Column) -> Column:
    """{subject, predicate} where the pair is one that such a body can do."""
    low = F.lower(sentence)
    pairs = F.array(*[F.when(low.rlike(rf"\b{s}s?\b.{{0,40}}\b{p}\b"), F.struct(F.lit(s).alias("subject"), F.lit(p).alias("predicate"))) for s, p in sorted(ALLOWED)])
    return F.try_element_at(F.filter(pairs, lambda x: x.isNotNull()), F.lit(1))


def claim_type(sentence: Column) -> Column:
    low = F.lower(sentence)
    return (
        F.when(F.size(figures(sentence)) > 0, "statistic").when(official_action(sentence).isNotNull(), "official-statement").when(low.rlike(r"\b(alleged|accused)\b"), "allegation")
        .when(low.rlike(r"\b(will|likely|expected|forecast)\b"), "prediction").when(speaker(sentence).isNotNull(), "attribution").otherwise("event")
    )


def correction(sentence: Column) -> Column:
    """{before, after}: first and last number where the text corrects itself."""
    values = F.regexp_extract_all(F.lower(sentence), F.lit(rf"\b{NUMBER}\b"), F.lit(1))
    cue = F.lower(sentence).rlike(r"\b(correction|corrected|revised|earlier said|not)\b")
    return F.when(cue & (F.size(values) >= 2), F.struct(number_token(values[0]).alias("before"), number_token(F.element_at(values, -1)).alias("after")))


def market_moves(text: Column) -> Column:
    """Array of {value, unit, direction}: direction from the 60 characters before
    and 20 after; flat over down over up."""
    pattern = r"(.{0,60}?)([0-9][0-9,]*(?:\.[0-9]+)?) ?(points|per cent|percent|%|bps|basis points|rupees)(.{0,20})"
    low = F.lower(text)
    parts = F.arrays_zip(*[F.regexp_extract_all(low, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "b"), (2, "n"), (3, "u"), (4, "a"))])

    def move(p: Column) -> Column:
        near = F.concat(p["b"], F.lit(" "), p["a"])
        way = F.when(near.rlike("flat|unchanged|steady"), "flat").when(near.rlike("fell|falls|down|slip|drop|lower|decline|crash"), "down").when(near.rlike("rose|rises|up|gain|jump|higher|surge"), "up").otherwise("unknown")
        unit = F.when(p["u"].isin("%", "per cent"), "percent").when(p["u"] == "basis points", "bps").otherwise(p["u"])
        return F.struct(number_token(p["n"]).alias("value"), unit.alias("unit"), way.alias("direction"))

    return F.transform(parts, move)


def policy_event(text: Column) -> Column:
    """{authority, instrument, decision, size}; hold before cut before hike before
    change. Liquidity operations are no policy event."""
    low = F.lower(text)
    pick = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    authority, instrument = pick(r"\b(rbi|central bank|sebi|fed|government)\b"), pick(r"\b(repo rate|interest rate|cash reserve ratio|duty|tax)\b")
    decision = F.when(low.rlike(r"unchanged|holds?\b|kept|pause"), "hold").when(low.rlike(r"\bcuts?\b|lower|reduc"), "cut").when(low.rlike(r"hike|rais|increas"), "hike").when(low.rlike(r"chang|revis"), "change")
    size = number_token(pick(r"by ([0-9.]+) ?(?:bps|basis points|percent|%)"))
    whole = authority.isNotNull() & instrument.isNotNull() & decision.isNotNull() & ~low.rlike("auction|liquidity|open market")
    return F.when(whole, F.struct(authority.alias("authority"), instrument.alias("instrument"), decision.alias("decision"), size.alias("size")))


def market_reaction(text: Column) -> Column:
    return F.lower(text).rlike(r"^(sensex|nifty|rupee|gold|shares?|stocks?)\b") | ((F.size(market_moves(text)) > 0) & F.lower(text).rlike("after|following|on hopes|as investors"))


def fixture(text: Column) -> Column:
    """{teams sorted, round, status, women}: two capitalised sides around 'vs' or a verb."""
    a = F.trim(F.regexp_extract(text, r"((?:[A-Z]\w+ ?)+)(?:vs?\.?|beat|defeat(?:ed)?|draw with) ((?:[A-Z]\w+ ?)+)", 1))
    b = F.trim(F.regexp_extract(text, r"((?:[A-Z]\w+ ?)+)(?:vs?\.?|beat|defeat(?:ed)?|draw with) ((?:[A-Z]\w+ ?)+)", 2))
    low = F.lower(text)
    status = F.when(low.rlike(r"abandon|postpon|called off"), "off").when(low.rlike(r"\b(beat|defeat|won|draw)"), "finished").when(low.rlike(r"\blive\b|stumps|at tea"), "live").otherwise("scheduled")
    stage = F.nullif(F.regexp_extract(low, r"\b(final|semi-final|quarter-final|group stage|[0-9](?:st|nd|rd|th) (?:test|odi|t20))\b", 1), F.lit(""))
    return F.when((a != "") & (b != ""), F.struct(F.array_sort(F.array(a, b)).alias("teams"), stage.alias("round"), status.alias("status"), low.rlike(r"\bwomen").alias("women")))


def political_act(text: Column) -> Column:
    """{act, topic}: the first pattern that applies; the most frequent long word."""
    act = F.coalesce(*[F.when(F.lower(text).rlike(p), name) for name, p in ACTS])
    topic = with_value(tokens(text, 5), lambda w: F.array_max(F.transform(F.array_distinct(w), lambda x: F.struct(F.size(F.filter(w, lambda y: y == x)).alias("n"), x.alias("word"))))["word"])
    return F.when(act.isNotNull(), F.struct(act.alias("act"), topic.alias("topic")))


def scheduled_day(text: Column, published: Column) -> Column:
    """{day, phrase}: a day named relative to publication, or a date without year,
    which takes the nearest of the years before, of and after publication."""
    low, day = F.lower(text), F.to_date(published)
    named = F.regexp_extract(low, r"\b([0-9]{1,2}) (january|february|march|april|may|june|july|august|september|october|november|december)\b", 0)
    dates = F.array(*[F.to_date(F.try_to_timestamp(F.concat(F.initcap(named), F.lit(" "), (F.year(day) + k).cast("string")), F.lit("d MMMM yyyy"))) for k in (-1, 0, 1)])
    nearest = F.array_min(F.transform(F.filter(dates, lambda d: d.isNotNull()), lambda d: F.struct(F.abs(F.datediff(d, day)).alias("gap"), d.alias("d"))))["d"]
    weekday = F.initcap(F.regexp_extract(low, r"\b(?:on|next) (monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 1))
    found = (
        F.when(named != "", F.struct(nearest.alias("day"), named.alias("phrase")))
        .when(low.rlike(r"\btomorrow\b"), F.struct(F.date_add(day, 1).alias("day"), F.lit("tomorrow").alias("phrase")))
        .when(low.rlike(r"\byesterday\b"), F.struct(F.date_sub(day, 1).alias("day"), F.lit("yesterday").alias("phrase")))
        .when(low.rlike(r"\btoday\b"), F.struct(day.alias("day"), F.lit("today").alias("phrase")))
        .when(weekday != "", F.struct(F.next_day(day, "Mon").alias("day"), weekday.alias("phrase")))
    )
    days = F.create_map(*[F.lit(x) for n, k in (("Monday", 0), ("Tuesday", 1), ("Wednesday", 2), ("Thursday", 3), ("Friday", 4), ("Saturday", 5), ("Sunday", 6)) for x in (n, k)])
    ahead = F.pmod(days[weekday] - F.weekday(day) - 1, F.lit(7)) + 1
    return F.when((weekday != "") & (found["phrase"] == weekday), F.struct(F.date_add(day, ahead.cast("int")).alias("day"), weekday.alias("phrase"))).otherwise(found)


def local_impact(text: Column) -> Column:
    """{kinds, scale}: sentences that name an effect and what it hits."""
    kinds = (("closure", "closed|shut|suspended", "schools?|colleges?|roads?|highway|airport"), ("outage", "outage|power cut|disrupted", "power|water|services?|trains?"), ("warning", "warning|alert", "rain|flood|cyclone|heat"))
    parts = F.split(F.lower(text), r"[.!?]+\s*")

    def both(a: str, b: str) -> Column:
        return F.exists(parts, lambda s: s.rlike(rf"\b({a})\b") & s.rlike(rf"\b({b})\b"))

    hit = F.array(*[F.when(both(a, b), name) for name, a, b in kinds])
    found = F.filter(hit, lambda k: k.isNotNull())
    districts = number_token(F.nullif(F.regexp_extract(F.lower(text), rf"\b{NUMBER} districts\b", 1), F.lit("")))
    scale = F.when(districts >= 5, "wide").when(districts >= 2, "several districts").otherwise("local")
    return F.when(F.size(found) > 0, F.struct(found.alias("kinds"), scale.alias("scale")))


def injection(text: Column) -> Column:
    return F.coalesce(text.rlike(INJECTION), F.lit(False))


def sanitised(text: Column) -> Column:
    """Text whose delimiters can't be taken for a prompt's."""
    return F.regexp_replace(F.regexp_replace(text, r"`{3,}|<\|[^|]*\|>", " "), r"(?i)</?(system|assistant|user)>", " ")


def entailment(claim: Column, source: Column) -> Column:
    """admit, downgrade or reject: every number must stand in the source, and most
    long words."""
    digits = F.regexp_extract_all(claim, F.lit(r"[0-9][0-9,.]*[0-9]|[0-9]"), F.lit(0))
    words = F.array_distinct(tokens(claim, 5))
    share = with_value(tokens(source, 5), lambda have: F.size(F.filter(words, lambda w: F.array_contains(have, w)))) / F.greatest(F.size(words), F.lit(1))
    return F.when(~F.forall(digits, lambda n: F.contains(source, n)), "reject").when(share >= 0.8, "admit").when(share >= 0.5, "downgrade").otherwise("reject")


def draft_number(turn: Column, pos: Column) -> Column:
    """The place of a sentence (pos, an int) in its cluster, by turn and then pos."""
    return F.shiftleft(turn.cast("long"), 32) + pos


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cluster, type, words and host of (cluster, type, words, draft), which come cluster by
    cluster in draft order. Hosts are looked up by their words, so a draft meets only
    those that it shares a word with."""
    cluster, hosts, having = object(), [], {}
    for batch in batches:
        found = []
        for own, kind, words, draft in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != cluster:
                cluster, hosts, having = own, [], {}
            shared: dict[int, int] = {}
            for word in words:
                for h in having.get((kind, word), ()):
                    shared[h] = shared.get(h, 0) + 1
            for h in sorted(shared):
                n, alike = shared[h], shared[h] / (len(words) + hosts[h][1] - shared[h])
                if alike >= 0.5 or (n >= 3 and alike >= 0.25) or (n >= 2 and alike >= 0.4):
                    found.append(hosts[h][0])
                    break
            else:
                for word in words:
                    having.setdefault((kind, word), []).append(len(hosts))
                hosts.append((draft, len(words)))
                found.append(draft)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], names=[*batch.schema.names[:3], "host"])


def merge_assertions(drafts: DataFrame, cluster: str) -> DataFrame:
    """Greedy identity merge, in draft order, within each cluster.

    A draft joins the first earlier host of its type whose words are alike:
    Jaccard from .5, or three shared and .25, or two shared and .4. The order
    decides, so a cluster is merged in one place; its rows are its distinct match keys (type
    and set of words), each at its first draft, whose host later copies share.
    A draft without words is like nothing and hosts itself.
    ``drafts`` has cluster, draft long, type, words array<string>.
    """

    kinds = dict(drafts.dtypes)
    keyed = drafts.select(cluster, "draft", "type", F.array_sort(F.array_distinct("words")).alias("words"))
    filled, key = keyed.where(F.size("words") > 0), [cluster, "type", "words"]
    firsts = filled.groupBy(*key).agg(F.min("draft").alias("draft")).repartition(cluster).sortWithinPartitions(cluster, "draft")
    known = firsts.mapInArrow(merged, f"{cluster} {kinds[cluster]}, type {kinds['type']}, words {kinds['words']}, host long")
    joined = filled.join(known, key).select(cluster, "draft", "host")
    return joined.unionByName(keyed.where(F.size("words") == 0).select(cluster, "draft", F.col("draft").alias("host")))
