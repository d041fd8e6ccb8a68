"""Quality, toxicity and personal data."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import personal_data as P
from gleaner.llm import quality as Q
from gleaner.llm import shingles as S
from gleaner.llm import toxicity as T

SYLLABLES = ["ba", "ko", "mi", "tu", "re", "sa", "lo", "ne"]
INSULTS = ["dreckwurz", "schmierling", "trottelkopf"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def toxic_text(rng, spoil=False):
    words = [word(rng) for _ in range(rng.randint(3, 30))]
    insult = rng.choice(INSULTS)
    if spoil:
        at = rng.randint(2, len(insult) - 2)
        insult = insult[:at] + rng.choice(["-", "x", ".", insult[at]]) + insult[at:]
    words.insert(rng.randrange(len(words)), insult)
    return " ".join(words)


def test_toxicity_learns_and_tolerates_inserted_characters(spark, make):
    rng = random.Random(8)
    texts = [toxic_text(rng) if i % 3 == 0 else " ".join(word(rng) for _ in range(rng.randint(3, 30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = T.train_toxicity(make(texts), labels, F.lit(True))
    fresh = [toxic_text(rng, spoil=True) for _ in range(60)] + [" ".join(word(rng) for _ in range(20)) for _ in range(60)]
    fresh += ["ba ko d r e c k w u r z mi", None, ""]
    found = {r.doc_id: r for r in T.score_toxicity(make(fresh), model).collect()}
    assert np.mean([found[i].predicted for i in range(60)]) > 0.9
    assert np.mean([found[i].predicted for i in range(60, 120)]) < 0.05
    assert found[120].predicted == 1 and found[121].predicted == found[122].predicted == 0
    assert all(0 <= r.score <= 1 for r in found.values())


def test_table_score_equals_the_kernel():
    words = ["ABCDE".replace("A", "A"), "BADCAB", "ABXCDE"]
    words = [w.translate(str.maketrans("ABCDEX", "ABCDEX")) for w in words]
    tables = T.kernel_tables(words)
    gram = T.kernel(words, tables)
    assert np.allclose(gram, gram.T, atol=1e-5) and gram[0, 2] > gram[0, 1]
    for i, w in enumerate(words):
        assert np.allclose(T.table_scores(T.as_letters(w)[None, :], len(w), tables[0])[0], gram[i, 0], atol=1e-5)


def test_folding():
    data, offsets = S.flat(pa.array(["ÉcóLé i-d.i1ot  zzoo", None, "1234 !!"]))
    words = T.distinct_words(data, offsets)
    spelled = {(words.letters[a:b] + 64).tobytes().decode() for a, b in zip(words.ends, words.ends[1:], strict=False)}
    assert {"_EC_OL_E", "IDIOT", "ZO"} <= spelled


def test_kernel_against_all_gapped_triples():
    """The kernel of two words by enumerating every subsequence of three letters."""

    def features(word):
        found = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + T.MOST_SPAN)):
                    key = word[i] + word[j] + word[k]
                    found[key] = found.get(key, 0.0) + T.DECAY ** (k - i + 1)
        places = sum(T.DECAY ** (2 * (k - i + 1)) for i in range(len(word)) for j in range(i + 1, len(word)) for k in range(j + 1, min(len(word), i + T.MOST_SPAN)))
        return {key: v / places**0.5 for key, v in found.items()}

    words = ["@IDIOT@", "@IDXIOT@", "@I_DIOT@", "@WINDOWS@", "@ABABABAB@"]
    gram = T.kernel(words, T.kernel_tables(words))
    for a, x in enumerate(map(features, words)):
        for b, y in enumerate(map(features, words)):
            assert abs(gram[a, b] - sum(v * y.get(key, 0.0) for key, v in x.items())) < 1e-4
    assert gram[0, 1] > 2 * gram[0, 3] and gram[0, 2] > 2 * gram[0, 3]


def test_insults_of_any_length_and_copies(spark, make):
    """A 40-letter insult is learnt by its pieces; copies of one text vouch for nothing."""
    rng = random.Random(21)
    long = "schmierfinkendreckwurzelhohlkopftrottelig"
    texts = [" ".join([word(rng) for _ in range(12)] + ([long] if i % 3 == 0 else [])) for i in range(240)]
    copied = " ".join(word(rng) + word(rng) for _ in range(20))
    texts += [copied] * 60
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i >= 240)) for i in range(300)], "doc_id long, toxic int")
    model = T.train_toxicity(make(texts), labels, F.lit(True))
    fresh = [f"ba ko {long} mi", *[" ".join([word(rng) for _ in range(8)] + [w]) for w in copied.split()]]
    found = [r.predicted for r in T.score_toxicity(make(fresh), model).orderBy("doc_id").collect()]
    assert found[0] == 1 and sum(found[1:]) <= 2


def test_toxicity_without_labels_or_documents(spark, make, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train_toxicity(odd, none, F.lit(True))
    assert [r.predicted for r in T.score_toxicity(odd, model).collect()] == [0] * odd.count()
    assert T.score_toxicity(empty, model).count() == 0


def junk(rng):
    return rng.choice([lambda: " ".join([word(rng)] * 40), lambda: " | ".join(word(rng) for _ in range(30)), lambda: " ".join(word(rng).upper() + "!!" for _ in range(30))])()


def test_quality_on_held_out_rows(spark, make):
    rng = random.Random(9)
    texts = [junk(rng) if i % 4 == 0 else ". ".join(" ".join(word(rng) for _ in range(8)).capitalize() for _ in range(5)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, quality int")
    docs, held = make(texts), Q.held_out(F.col("doc_id"), 5, 0)
    model = Q.train_quality(docs, labels, ~held)
    found = {r.doc_id: r for r in Q.score_quality(docs, model).select("doc_id", "score", "predicted", held.alias("held")).collect()}
    right = [found[i].predicted == int(i % 4 != 0) for i in range(400) if found[i].held]
    assert len(right) > 40 and np.mean(right) > 0.95


def test_quality_score_is_a_sum_of_table_entries(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(Q.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = Q.fit(x, y)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.9 and len(model.pairs) == Q.PAIRS
    one = model.base + sum(t[np.searchsorted(c, x[0, f], "right")] for f, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    one += sum(t[np.searchsorted(a, x[0, f], "right"), np.searchsorted(b, x[0, g], "right")] for f, g, a, b, t in model.pairs)
    assert abs(1 / (1 + np.exp(-one)) - model.scores(x[:1])[0]) < 1e-9


def test_quality_odd_rows(spark, odd, empty):
    model = Q.train_quality(odd, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert [r.score for r in Q.score_quality(odd, model).collect()] == [0.5] * odd.count()
    assert Q.score_quality(empty, model).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(10)
    for _ in range(20_000):
        text = "".join(rng.choice("1234 .@a-+()b9é") for _ in range(rng.randint(0, 30)))
        assert P.base_spans(text) == plain_spans(text)
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111,", "+1 (238) 555-6608", "a.b+c@d-e.example.org.", "256.1.1.1 1.2.3.4.5"]
    assert [P.base_spans(c) for c in cards] == [plain_spans(c) for c in cards] and all(map(P.base_spans, cards))


def test_model_adds_spans_and_keeps_base_ones():
    model = P.train()
    text = "write to anna at firma dot com or (030) 555-1234, a@b.de version 2.0 of 2024-05-06"
    base = P.base_spans(text)
    added = P.added_spans(text, base, model)
    got = {(k, text[a:b]) for k, a, b in added}
    assert ("email", "anna at firma dot com") in got and ("phone", "(030) 555-1234") in got
    assert not any("2.0" in t or "2024" in t for _, t in got) and [text[a:b] for _, a, b in base] == ["a@b.de"]
    rng, hit, given, said = random.Random(12), 0, 0, 0
    for _ in range(300):
        sentence, gold = P.example(rng, ["rosen", "haus", "wiese", "turm", "feld", "bach"])
        found = set(P.added_spans(sentence, P.base_spans(sentence), model)) | set(P.base_spans(sentence))
        hit, given, said = hit + len(found & set(gold)), given + len(gold), said + len(found)
    assert hit / given > 0.85 and hit / said > 0.85


def test_every_written_address_opens_a_window(make):
    model = P.train()
    wanted = ["anna at mira.com", "anna (AT) mira (DOT) org", "anna AT mira DOT org", "anna [At] mira.net", "anna (at) mira (dot) org"]
    rows = P.find_personal_data(make([f"haus {w} turm" for w in wanted] + ["turm at haus wiese"]), model).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == [f"email:5:{5 + len(w)}" for w in wanted] + [""]


def test_formats_that_training_does_not_know():
    """Recall and precision on written forms and distractors of another generator."""
    model, rng = P.train(), random.Random(99)
    plain = "lorem ipsum dolor amet tempus meeting budget report Wien 2024 window".split()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def entity():
        number = next(n for n in ("4" + d(15) for _ in range(10_000)) if P.luhn(n))
        who, host, octet = rng.choice(["anna", "j.smith", "lea99", "max-p"]), rng.choice(["mira", "shop24", "uni-wien"]), [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice(
            [
                ("email", f"{who} {{at}} {host}.com"), ("email", f"{who} AT {host} DOT org"), ("email", f"{who}(at)mail.{host}.co.uk"), ("email", f"{who} at {host}.net"),
                ("ip", "(dot)".join(octet)), ("ip", " dot ".join(octet)), ("card", " / ".join(number[i : i + 4] for i in (0, 4, 8, 12))), ("card", "_".join(number[i : i + 4] for i in (0, 4, 8, 12))),
                ("phone", f"({d(3)}) {d(3)} {d(4)}"), ("phone", f"{d(3)}/{d(3)}-{d(4)}"), ("phone", f"({d(3)}){d(3)}-{d(4)}"),
            ]
        )

    other = lambda: rng.choice([f"v{d(1)}.{d(1)}.{d(2)}", f"{d(5)} EUR", f"at {rng.choice(plain)}", f"ISBN {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", f"{d(2)}:{d(2)}", f"item {d(6)}", f"{d(4)}-{d(4)}"])
    hit = given = said = 0
    for _ in range(600):
        text, gold = " ".join(rng.choice(plain) for _ in range(5)) + " ", set()
        if rng.random() < 0.6:
            kind, body = entity()
            gold.add((kind, len(text), len(text) + len(body)))
        else:
            body = other()
        text += body + " " + " ".join(rng.choice(plain) for _ in range(4))
        base = P.base_spans(text)
        found = set(base) | set(P.added_spans(text, base, model))
        hit, given, said = hit + len(found & gold), given + len(gold), said + len(found)
    assert hit / given > 0.9 and hit / said > 0.9


def test_zeros_before_a_number_do_not_hide_an_address():
    for zeros in (1, 300, 401, 5_000):
        assert P.base_spans("0" * zeros + "1.2.3.255") == [("ip", 0, zeros + 9)]
    assert P.base_spans("1.2.3.0256") == [] and P.base_spans("0.00.000.0") == [("ip", 0, 10)]


def test_long_runs_are_not_cut():
    """A run of 1,200 digit tokens against Viterbi over all its segments at once."""
    model, rng = P.train(), random.Random(4)
    text = " ".join("".join(rng.choice("0123456789") for _ in range(rng.choice([3, 3, 4, 4, 5]))) for _ in range(1_200))
    base = P.base_spans(text)
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    blocked = [any(a < e and s < b for _, s, e in base) for a, b in tokens]
    whole = P.best_segments(list(P.lattice(text, tokens, blocked)), model)
    assert whole and P.added_spans(text, base, model) == whole


def test_viterbi_is_the_best_of_all_segmentations():
    model = P.train()
    text = "haus 00 49 301 555 1234 anna (at) x (dot) com 1.2"
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    segments = list(P.lattice(text, tokens, [False] * len(tokens)))

    def best(last):
        if last == 0:
            return 0.0
        options = [best(last - 1)] + [best(first) + max(model.scores(f)) for first, f, _, _ in segments[last - 1]]
        return max(options)

    chosen = P.best_segments(segments, model)
    score = sum(max(model.scores(f)) for kind, a, b in chosen for here in segments for _, f, s, e in here if (s, e) == (a, b))
    assert abs(score - best(len(tokens))) < 1e-6


def test_personal_data_odd_rows(odd, empty, make):
    model = P.Model()
    found = P.find_personal_data(odd, model).collect()
    assert len(found) == odd.count() and all(r.spans == "" for r in found) and P.find_personal_data(empty, model).count() == 0
    row = P.find_personal_data(make(["é x@y.org +1 (238) 555-6608"]), model).first()
    assert row.base == row.spans == "email:2:9,phone:10:27" and (row.n_email, row.n_phone) == (1, 1)
