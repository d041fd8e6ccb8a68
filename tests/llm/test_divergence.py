"""Source divergence against a dense count in plain Python."""

import random
import re
from collections import Counter
from itertools import islice

from gleaner.llm import divergence as D
from gleaner.llm.storage import Workspace

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int, term string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def dense(rows, least_docs, top):
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        words = Counter(TERM.findall(lowered(text)))
        groups.add((lang, source))
        for w, n in words.items():
            counts[lang, source, w] += n
            docs[lang, w] += 1
    out = set()
    for lang in {g for g, _ in groups}:
        terms = sorted(w for (g, w), n in docs.items() if g == lang and n >= least_docs)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(of, terms=terms):
            total = sum(of[w] for w in terms)
            return {w: 1 + 10**9 * (of[w] + 5) // (total + 5 * len(terms)) for w in terms}

        own = {s: Counter({w: counts[lang, s, w] for w in terms}) for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares(sum(own.values(), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][w] - p[o][w]) for w in terms), o) for o in sources if o != s]
            term = [(p[s][w] - q[w], w) for w in terms if own[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, w, v, k + 1) for k, (v, w) in enumerate(ranked) if part == "pair" or k < top}
    return out


def found(frame):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [*"abcdefghij", "Straße", "été", "ÉTÉ", "漢字", "🙂x", "don't", "x1y", "ZZ_z", *[f"{a}{b}" for a in "klm" for b in "nopqrst"]]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "c", None, ""])
        bag = [w for w in words if hash((w, source, seed)) % 3] or words
        text = rng.choice([" ", "\n", "-", "  "]).join(rng.choice(bag) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice([text] * 20 + [None, ""]), rng.choice(["en", "en", "en", "fr", None]), source))
    return rows + [rows[0], ("only", "xx", "lone"), (None, "en", "empty")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 7, 7, "clash") for i, r in enumerate(rows)], SCHEMA).repartition(5)


def test_equals_a_dense_count(spark):
    for seed, least, top in ((1, 3, 4), (2, 1, 50), (3, 400, 50)):
        rows = corpus(seed)
        assert found(D.divergence(frame(spark, rows), least_docs=least, top=top)) == dense(rows, least, top)


def test_many_ties_are_refined_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_TIED", 2)
    monkeypatch.setattr(D, "MOST_BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "MOST_TERMS", 10)
    stems = ["same" * 5 + x for x in ("", "a", "aa", "ab", "b", "é", "漢", "🙂", "z", "zz", "zzz", "zzzz")]
    rows = [(" ".join(stems), "en", "a"), ("other words here", "en", "b"), (" ".join(stems[:4] * 2), "en", "c")]
    for top in (1, 3, 5, 50):
        assert found(D.divergence(frame(spark, rows), least_docs=1, top=top)) == dense(rows, 1, top)


def test_top_terms_find_the_boundary(spark):
    rng = random.Random(5)
    rows = [("en", f"s{g}", f"t{i}", rng.choice([0, 1, 5, 1023, 1024, 1 << 20, (1 << 31) - 1, rng.randrange(1 << 31)])) for g in range(3) for i in range(10 + 200 * g)]
    values = spark.createDataFrame(rows, "lang string, source string, term string, value long")
    for k in (1, 7, 50):
        got = {(r.source, r.term) for r in D.top_terms(values, k, Workspace(spark, "test")).collect()}
        want = set()
        for g in range(3):
            mine = sorted((r for r in rows if r[1] == f"s{g}"), key=lambda r: (-r[3], r[2].encode()))
            want |= {(r[1], r[2]) for r in islice(mine, k)}
        assert got == want


def test_long_texts_and_counts_beyond_a_long(spark, empty, odd):
    assert D.divergence(empty).count() == 0
    rows = [("Wort " * 500_000 + "x" * 3_000_000, "de", "a"), ("wort anders", "de", "b"), ("", "de", "c")]
    assert found(D.divergence(frame(spark, rows), least_docs=1)) == dense(rows, 1, 50)
    assert found(D.divergence(odd, least_docs=1)) == dense([(r.text, r.lang, r.source) for r in odd.collect()], 1, 50)
    big = spark.range(1).select(D.share(*[D.F.lit(x) for x in (10**15, 3 * 10**17, 10**6)]).alias("p")).first().p
    assert big == 1 + 10**9 * (10**15 + 5) // (3 * 10**17 + 5 * 10**6)
