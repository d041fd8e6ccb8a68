"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans: email, ip, card and phone. The model adds spans
that they miss, such as written-out addresses or national phone numbers. It
scores whole candidate segments, not single tokens: a segment of up to
``MOST_TOKENS`` tokens and ``MOST_CHARS`` characters on one line, the bound of an
entity, has features of its full text, and dynamic programming over segment ends
chooses the best sequence of segments and types at once. Base spans are fixed; the
model only decides about the text between them.

The model is trained here by conditional likelihood on sentences that are built
from the formats below, planted among common words and invented ones. It depends
on no corpus, so a text's spans don't depend on the texts beside it.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS = 7, 120
CONTEXT = 3  # tokens read on either side of a trigger
#: Training sentences, invented words among them, and passes over them.
SENTENCES, INVENTED, EPOCHS = 500, 1_000, 9
# Common words of the training sentences.
COMMON = (
    "the of and in is was for on with that this from by are not as it his her they you we one all were be have had but or which their an she he "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind "
    "le de un et il avoir ne je son que se qui ce dans elle au du pas plus pouvoir par les avec tout faire mettre autre on mais nous comme ou si "
    "el la en y a los del se las por para con no una su al lo como mas pero sus le ya o este porque esta entre cuando muy sin sobre"
).split()

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What RE2 looks for before a text is read in Python at all.
SCREEN = r"(?i)[0-9@]|[(\[{] ?at ?[)\]}]|\bdot\b|\bat [a-z0-9-]+\.[a-z0-9-]"
_TRIGGER = re.compile(SCREEN)
_CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "iban", "account"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell"),
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _unpadded(digits: str) -> str:
    return digits.lstrip("0")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then by kind."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in _LOCAL:
            left -= 1
        host = _HOST.match(text, at + 1) if left < at else None
        if host:
            found.append(("email", left, host.end()))
            last = host.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in map(_unpadded, m.group().split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment's span without the punctuation around it."""
    while end > start and text[end - 1] in ".,;:!?\"'>]}":
        end -= 1
    while start < end and text[start] in "\"'<[{,;:":
        start += 1
    if end > start and text[end - 1] == ")" and "(" not in text[start:end]:
        end -= 1
    if start < end and text[start] == "(" and ")" not in text[start:end]:
        start += 1
    return start, end


_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]| at ", re.I)
_DOT = re.compile(r"\.|[(\[{] ?dot ?[)\]}]| dot ", re.I)
_SHAPES = (
    ("mail", re.compile(r"[\w.%+-]+ ?(?:@|[(\[{] ?at ?[)\]}]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]| dot ) ?[A-Za-z0-9-]+)*? ?(?:\.|[(\[{] ?dot ?[)\]}]| dot ) ?[A-Za-z]{2,8}", re.I)),
    ("four", re.compile(r"[0-9]{1,3}(?: ?(?:[(\[{] ?(?:dot|\.) ?[)\]}]| dot |,) ?[0-9]{1,3}){3}", re.I)),
    ("groups4", re.compile(r"[0-9]{4}(?:[./_ -]{1,3}[0-9]{4}){3}")),
    ("national", re.compile(r"\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}")),
    ("abroad", re.compile(r"\+[0-9]{1,3}[ ./-]\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}")),
    ("zeros", re.compile(r"00[1-9][0-9]?(?:[ ./-][0-9]{2,5}){3,4}")),
    ("run", re.compile(r"[0-9]+")),
    ("dotted", re.compile(r"[0-9]+(?:\.[0-9]+)+")),
    ("dated", re.compile(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}")),
    ("mixed", re.compile(r"\w*[A-Za-z]\w*[0-9]\w*")),
)


_PLAIN = re.compile(r"[A-Za-z0-9 .,@()\[\]{}+/_%-]*")


def span_features(span: str, tokens: int, before: str, after: str) -> list[str]:
    """Features of a whole segment; without digits, @ or a written at: none."""
    digits = [c for c in span if "0" <= c <= "9"]
    if not digits and not _AT.search(span):
        return []
    letters = sum(c.isalpha() for c in span)
    n = len(digits)
    out = ["bias", f"tokens{tokens}", "digits" + ("0" if not n else "1-6" if n < 7 else "7-9" if n < 10 else "10-11" if n < 12 else "12-13" if n < 14 else "14-19" if n < 20 else "20+")]
    out += [f"shape={name}" for name, shape in _SHAPES if shape.fullmatch(span)]
    out.append("letters" + ("0" if not letters else "few" if letters <= 6 else "many"))
    out.append("at=" + ("sign" if "@" in span else "word" if _AT.search(span) else "no"))
    out.append("dot=" + ("sign" if "." in span else "word" if _DOT.search(span) else "no"))
    out += [f"has{c}" for c in "+()-/=_:" if c in span]
    if 14 <= n <= 19:
        out.append(f"luhn={luhn(''.join(digits))},{'letters' if letters else 'plain'}")
    if not _PLAIN.fullmatch(span):
        out.append("odd")
    if after and _DOT.match(f" {after} ") or after.startswith(("(dot", "[dot")):
        out.append("dot follows")
    cue = before.lower().strip(".,:;()")
    out += [f"cue={kind}" for kind, words in _CUES.items() if cue in words]
    return out


class Model:
    """Weights of (feature, kind); a token outside any segment scores 0."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}

    def scores(self, features: list[str]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return sum((self.weights.get(f, zero) for f in features), zero)


Segment = tuple[int, list[str], int, int]


def lattice(text: str, tokens: list[tuple[int, int]], blocked: list[bool]) -> Iterator[list[Segment]]:
    """For each end token the segments (first token, features, start, end)."""
    for last in range(len(tokens)):
        segments = []
        for first in range(last, max(-1, last - MOST_TOKENS), -1):
            if blocked[first]:
                break
            start, end = trimmed(text, tokens[first][0], tokens[last][1])
            if start >= end or start >= tokens[first][1] or end <= tokens[last][0] or end - start > MOST_CHARS or "\n" in text[start:end]:
                continue
            before = text[slice(*tokens[first - 1])] if first else ""
            after = text[slice(*tokens[last + 1])] if last + 1 < len(tokens) else ""
            features = span_features(text[start:end], last - first + 1, before, after)
            if features:
                segments.append((first, features, start, end))
        yield segments


def best_segments(segments: Iterable[list[Segment]], model: Model) -> list[tuple[str, int, int]]:
    """The highest-scoring sequence of segments (semi-Markov Viterbi), read once."""
    best, back = [0.0], [None]
    for last, here in enumerate(segments):
        top, how = best[last], None
        for first, features, start, end in here:
            scores = model.scores(features)
            kind = int(np.argmax(scores))
            if best[first] + scores[kind] > top + 1e-9:
                top, how = best[first] + scores[kind], (first, KINDS[kind], start, end)
        best.append(top)
        back.append(how)
    out, at = [], len(back) - 1
    while at:
        how = back[at]
        if how:
            out.append(how[1:])
            at = how[0]
        else:
            at -= 1
    return out[::-1]


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """Spans of the model outside the base spans."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]
    blocked = [False] * len(tokens)
    for _, a, b in base:
        for t in range(max(0, bisect_right(starts, a) - 1), len(tokens)):
            if tokens[t][0] >= b:
                break
            blocked[t] = True
    hot = sorted({t for m in _TRIGGER.finditer(text) if not blocked[t := bisect_right(starts, m.start()) - 1]})
    out, i = [], 0
    while i < len(hot):
        first = last = hot[i]
        while i < len(hot) and hot[i] <= last + CONTEXT:
            last = hot[i]
            i += 1
        low, high = max(0, first - CONTEXT), min(len(tokens), last + CONTEXT + 1)
        out += best_segments(lattice(text, tokens[low:high], blocked[low:high]), model)
    return [s for k, s in enumerate(out) if not k or s[1] >= out[k - 1][2]]


def example(rng: random.Random, words: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its entities, in formats that base patterns miss."""

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = rng.choice("3456") + d(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def name() -> str:
        return re.sub(r"[^A-Za-z]", "", rng.choice(words)).lower() or "person"

    byte = lambda: str(rng.randint(1, 254))
    at, dot = rng.choice([" at ", " (at) ", "(at)", " [at] ", "[at]"]), rng.choice([" dot ", " (dot) ", "[dot]", "(dot)", "."])
    number = card()
    sep = rng.choice([".", "/", "_", " - "])
    options = [
        ("email", f"{name()}{at}{name()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'example'])}"),
        ("email", f"{name()}.{d(2)}{at}{name()}{d(1)}{dot}{name()}{dot}com"),
        ("ip", rng.choice(["[.]", "(.)", "[dot]", " dot "]).join([byte(), byte(), byte(), byte()])),
        ("card", sep.join(number[i : i + 4] for i in range(0, 16, 4))),
        ("phone", f"({d(3)}) {d(3)}-{d(4)}"),
        ("phone", rng.choice(["-", ".", " ", "/"]).join([d(3), d(3), d(4)])),
        ("phone", f"00{rng.choice('123456789')}{d(1)} {d(3)} {d(3)} {d(4)}"),
        ("phone", f"+{rng.choice('123456789')} ({d(3)}) {d(3)}-{d(4)}"),
        (None, rng.choice(["1.0", "2.0.", "v3", "4.0.", "1.2.3", "10.4.2.1.5", "3.14"])),
        (None, f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        (None, f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}"),
        (None, d(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 18, 20]))),
        (None, f"{d(3)} {d(3)} {d(3)}"),
        (None, d(16)),
        (None, f"| {d(16)} |"),
        (None, f"{d(16)}{rng.choice(['$$$', '&&&', '###', '!!'])}"),
        (None, f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)} {d(3)} {d(2)}"),
        (None, f"password={''.join(rng.choice('0123456789abcdef') for _ in range(18))}"),
        (None, f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"'),
        (None, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
        (None, f"{name()} @ {name()} . {name()}"),
        (None, f"@{name()}"),
        (None, f"{name()}{d(2)} at {name()} {name()}"),
        (None, f"{d(1)}.{d(3)},{d(2)}"),
        (None, f"{name()}@{name()}"),
    ]
    text, spans = "", []
    for k in range(rng.randint(1, 3)):
        text += "".join(rng.choice(words) + " " for _ in range(rng.randint(1, 5)))
        kind, body = rng.choice(options)
        cue = rng.choice(_CUES[kind]) + " " if kind and rng.random() < 0.3 else ""
        text += cue
        if kind:
            spans.append((kind, len(text), len(text) + len(body)))
        text += body + rng.choice([" ", " ", ", ", ". "])
    return text + rng.choice(words), spans


def context_words(rng: random.Random) -> list[str]:
    """Common words and invented ones: the model must not know words by heart."""
    invented = ["".join(rng.choice("bcdfghklmnprstvwzß") + rng.choice("aeiouäéó") + rng.choice(["", "n", "r", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(INVENTED)]
    return COMMON + [w.capitalize() if rng.random() < 0.2 else w for w in invented]


def train(seed: int = 11, rate: float = 0.15, ridge: float = 1e-3) -> Model:
    """Conditional likelihood over segmentations, by AdaGrad; the same every time."""
    rng, model = random.Random(seed), Model()
    words = context_words(rng)
    squares: dict[str, np.ndarray] = {}
    data = []
    for _ in range(SENTENCES):
        text, spans = example(rng, words)
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        gold = {(a, b): KINDS.index(kind) for kind, a, b in spans}
        data.append((list(lattice(text, tokens, [False] * len(tokens))), gold))
    for _ in range(EPOCHS):
        for segments, gold in data:
            n = len(segments)
            scored = [[model.scores(features) for _, features, _, _ in here] for here in segments]
            forward = [0.0] * (n + 1)
            for last in range(n):
                terms = [forward[last]] + [forward[s[0]] + v for s, row in zip(segments[last], scored[last], strict=True) for v in row]
                top = max(terms)
                forward[last + 1] = top + math.log(sum(math.exp(t - top) for t in terms))
            backward = [0.0] * (n + 1)
            ahead: list[list[float]] = [[] for _ in range(n + 1)]
            for last in range(n - 1, -1, -1):
                after = backward[last + 1]
                ahead[last].append(after)
                for s, row in zip(segments[last], scored[last], strict=True):
                    ahead[s[0]] += [after + v for v in row]
                # every segment that starts at `last` ends at or after it, so ahead[last] is complete here
                top = max(ahead[last])
                backward[last] = top + math.log(sum(math.exp(t - top) for t in ahead[last]))
            gradient: dict[str, np.ndarray] = {}
            for last in range(n):
                for (first, features, start, end), row in zip(segments[last], scored[last], strict=True):
                    step = -np.exp(np.minimum(forward[first] + row + backward[last + 1] - forward[n], 0.0))
                    kind = gold.get((start, end))
                    if kind is not None:
                        step[kind] += 1.0
                    if np.abs(step).max() > 1e-4:
                        for f in features:
                            gradient[f] = gradient.get(f, 0.0) + step
            for f, g in gradient.items():
                w = model.weights.setdefault(f, np.zeros(len(KINDS)))
                g = g - ridge * w
                squares[f] = squares.get(f, np.full(len(KINDS), 1e-6)) + g * g
                w += rate * g / np.sqrt(squares[f])
    return model


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_personal_data(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of base spans, base and all spans.

    Spans are kind:start:end in code points, end exclusive, by start and then in
    the order of KINDS. A null text counts as empty, and a text without a trigger
    has no spans. Whole texts are read; other columns are not; repeated rows have
    a row each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            hits = pc.fill_null(pc.match_substring_regex(batch.column(1), SCREEN), False)
            base, every = [""] * n, [""] * n
            counts = np.zeros((len(KINDS), n), dtype=np.int64)
            for i in np.flatnonzero(hits.to_numpy(zero_copy_only=False)):
                text = batch.column(1)[int(i)].as_py()
                found = base_spans(text)
                base[i], every[i] = joined(found), joined(found + added_spans(text, found, shared.value))
                for kind, _, _ in found:
                    counts[KINDS.index(kind), i] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())],
                names=["id", *[f"n_{k}" for k in KINDS], "base", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = rows.mapInArrow(task, f"id {id_type}, {counts}, base string, spans string")
    return found.withColumnRenamed("id", id_col)
