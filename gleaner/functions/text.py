"""Text cleaning, URLs, tokens, languages and ids as Column expressions.

Every function gives null for null input unless it says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities, tracking parameters, stop words, and words folded to one.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–",
    "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&amp;": "&",
}
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "cmpid", "ncid")
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "had", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how",
    "its", "new", "now", "old", "see", "two", "who", "did", "she", "use", "way", "will", "with", "from", "this", "that", "have", "been", "over", "into",
    "after", "says", "said", "amid", "near", "more", "than", "also", "news", "update", "updates", "latest", "report", "reports", "today", "live", "video", "photos",
)
SAME_WORD = {
    "rain": ("rainfall", "downpour", "showers", "raining", "rains"), "flood": ("flooded", "flooding", "floods", "inundated", "inundation"),
    "close": ("closed", "closes", "closure", "shut", "shuts", "shutdown", "holiday"), "suspend": ("suspended", "suspends", "halted", "halts", "stopped"),
    "cancel": ("cancelled", "canceled", "cancels"), "die": ("killed", "dead", "died", "deaths", "death"), "injure": ("injured", "injuries", "hurt", "wounded"),
    "rescue": ("rescued", "rescues"), "evacuate": ("evacuated", "evacuation", "evacuations", "evacuees"),
    "release": ("released", "releases", "releasing", "discharge", "discharged"), "open": ("opened", "opens", "opening"),
    "warn": ("warning", "warned", "warns", "alert", "alerts"), "impose": ("imposed", "imposes", "clamped", "clamps"), "damage": ("damaged", "damages"),
    "landslide": ("landslip", "landslides"), "cyclone": ("cyclonic",),
}
KEY_SAME_WORD = {
    "close": ("shut", "closed", "shutdown", "closure", "holiday"), "order": ("ordered",), "declare": ("declared",), "announce": ("announced",),
    "suspend": ("suspended", "halted"), "cancel": ("cancelled",), "ban": ("banned",), "warn": ("warned", "warning", "alert"), "die": ("killed", "dead", "died", "deaths"),
    "injure": ("injured", "hurt", "wounded"), "rescue": ("rescued",), "evacuate": ("evacuated", "shifted"), "rain": ("rainfall", "downpour", "showers"),
    "release": ("released",), "open": ("opened",),
}
KEY_STOP_WORDS = (
    "the", "and", "for", "are", "was", "will", "has", "have", "had", "with", "from", "that", "this", "amid", "over", "into", "after", "news", "today", "latest",
    "report", "reports", "watch", "video", "tamil", "nadu", "india", "state", "says", "said", "new", "big", "top",
)
#: Plurals that keep their s.
KEEPS_S = "(ss|us|is|os|as|ews| news|sis)$"
#: White space of the web's text, and control characters but tab and line feed.
SPACES = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CONTROLS = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"


def _compatible() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one character and marks."""
    found = []
    for code in (*range(0xA0, 0x2000), *range(0xFF01, 0xFF5F)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != chr(code):
            found.append((chr(code), bare))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _compatible()


def with_value(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas of ``use``."""
    return F.transform(F.array(value), use)[0]


def _character(number: Column) -> Column:
    """The character of a code point; nothing for controls and for no character."""
    bad = (number > 0x10FFFF) | ((number < 0x20) & ~number.isin(9, 10)) | number.between(0x7F, 0x9F) | number.between(0xD800, 0xDFFF)
    return F.when(bad, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _numeric(text: Column, digits: str, base: int) -> Column:
    """Entities ``&#...;`` of a pattern of digits as characters; those beyond any
    character, of however many digits, as nothing."""

    def piece(p: Column, i: Column) -> Column:
        found = F.regexp_extract(p, f"^{digits};", 1)
        short = F.regexp_replace(found, "^0+(?=.)", "")
        number = F.when(F.length(short) <= 8, F.conv(short, base, 10).try_cast("long"))
        made = F.concat(F.coalesce(_character(number), F.lit("")), F.regexp_replace(p, f"^{digits};", ""))
        return F.when(i == 0, p).when(found != "", made).otherwise(F.concat(F.lit("&#"), p))

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), piece), "")).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Hexadecimal entities, then decimal ones (also those that the first made), then
    named ones; ``&amp;`` last, once."""
    numeric = _numeric(_numeric(text, "x([0-9a-fA-F]+)", 16), "([0-9]+)", 10)
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ENTITIES.items(), numeric)


def strip_tags(html: Column) -> Column:
    """Scripts, styles and tags as spaces; the text of CDATA sections stays."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style\b.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.regexp_replace(bare, "(?s)<[^>]+>", " ")


def cleaned(html: Column) -> Column:
    """Plain text of markup: no tags, entities or controls, white space collapsed."""
    bare = F.regexp_replace(decode_entities(strip_tags(html)), CONTROLS, "")
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters; a cut text ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def safe_url(url: Column) -> Column:
    """An http(s) URL with a dotted host, or null: scheme and host in lower case,
    no default port, fragment or tracking parameter, a path of at least a slash,
    every parameter with its equals sign. Escapes and dot segments stay."""
    url = F.trim(url)
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    scheme, host = F.lower(part("^([A-Za-z]+)://")), F.lower(part("^[A-Za-z]+://([^/?#]*)"))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path, query = part("^[A-Za-z]+://[^/?#]*([^?#]*)"), part(r"^[^?#]*\?([^#]*)")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*TRACKING))
    kept = F.transform(kept, lambda p: F.concat(F.replace(p, F.lit("%20"), F.lit("+")), F.when(F.contains(p, F.lit("=")), "").otherwise("=")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    usable = scheme.isin("http", "https") & F.contains(host, F.lit(".")) & ~host.rlike(r"[\s<>\^|%]")
    return F.when(usable, F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail))


def url_key(url: Column) -> Column:
    """For comparison: no scheme, www, query, fragment or last slash; lower case."""
    key = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(key, r"[?#].*$", ""), "/+$", "")


def unaccented(text: Column) -> Column:
    """Letters without their marks and in their plain form."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[\x{0300}-\x{036F}]", "")


def _same(word: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The word that ``word`` is folded to, or null; most words are in no list, which one
    look into all of them tells."""
    folded = reduce(lambda rest, item: F.when(word.isin(*item[1]), item[0]).otherwise(rest), table.items(), F.lit(None).cast("string"))
    return F.when(word.isin(*[form for forms in table.values() for form in forms]), folded)


def stem(word: Column) -> Column:
    """Listed inflections and synonyms as one word; a plain plural s goes."""
    base = F.substring(word, F.lit(1), F.length(word) - 1)
    plural = (F.length(word) > 4) & F.endswith(word, F.lit("s")) & ~word.rlike(KEEPS_S)
    return F.coalesce(_same(word, SAME_WORD), F.when(plural, F.coalesce(_same(base, SAME_WORD), base)), word)


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order, with a space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.split(plain_words(text), " ")


def tokens(text: Column, least: int = 3) -> Column:
    """Words without accents and stop words, folded by :func:`stem`, in order."""
    kept = F.filter(words(unaccented(F.lower(text))), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))
    return F.filter(F.transform(kept, stem), lambda w: ~w.isin(*STOP_WORDS))


def title_key(text: Column) -> Column:
    """The tokens in order of code points."""
    return F.array_join(F.array_sort(tokens(text)), " ")


def claim_key(text: Column) -> Column:
    """Key of a phrase, for matching claims across wordings."""
    folded = F.transform(words(text), lambda w: F.coalesce(_same(w, KEY_SAME_WORD), w))
    return F.array_join(F.array_sort(F.filter(folded, lambda w: (F.length(w) > 2) & ~w.isin(*KEY_STOP_WORDS))), " ")


def query_length_bucket(query: Column) -> Column:
    """0 for an empty query, then 1 under 8, 2 under 24 and 3 from 24 characters."""
    n = F.length(F.trim(query))
    return F.when(n == 0, 0).when(n < 8, 1).when(n < 24, 2).otherwise(3)


def script_letters(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{pattern}]", ""))


def language_by_script(text: Column) -> Column:
    """Tamil, English or unknown, by letters of the Tamil block and of a-z."""
    tamil, latin = script_letters(text, "஀-௿"), script_letters(text, "A-Za-z")
    return (
        F.when(tamil >= 12, "ta").when((tamil > 4) & (2 * tamil >= latin), "ta").when(latin > 4, "en").when(tamil > 0, "ta").otherwise("unknown")
    )


def slug(text: Column, most: int = 56) -> Column:
    """ASCII words joined by hyphens, at most ``most`` characters; never empty."""
    bare = F.regexp_replace(unaccented(F.lower(text)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.regexp_replace(bare, "^-+|-+$", ""), 1, most), "-+$", ""), F.lit("")), F.lit("item"))


def _fold(units: Column, seed: int) -> Column:
    return F.aggregate(units, F.lit(seed).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))


def stable_id(text: Column) -> Column:
    """12 base-36 digits of two 32-bit multiplicative hashes of the UTF-16 units,
    forwards from seed 5381 and backwards from 52711."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    units = F.transform(pairs, lambda u: F.conv(u, 16, 10).cast("bigint"))
    both = F.concat(F.conv(_fold(units, 5381).cast("string"), 10, 36), F.conv(_fold(F.reverse(units), 52711).cast("string"), 10, 36))
    return F.lower(F.substring(both, 1, 12))


def parse_date(text: Column, at: Column) -> Column:
    """A time from epoch seconds or milliseconds, ISO, RFC 822 or
    ``Www Mmm dd HH:MM:SS IST yyyy`` text; null if
    before 2000 or more than two days after ``at``."""
    text = F.trim(text)
    number = F.expr("1") * text.try_cast("double")
    parsed = F.coalesce(
        F.when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(number)),
        F.when(text.rlike("^[0-9]{13}$"), F.timestamp_seconds(number / 1000)),
        F.when(text.rlike("^[A-Z][a-z]{2}, "), F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(text.rlike("^[0-9]{4}-"), text.try_cast("timestamp")),
        F.when(text.rlike("^\\w{3} [A-Z][a-z]{2} \\d{1,2} [0-9:]{8} IST \\d{4}$"), F.try_to_timestamp(F.concat(F.regexp_replace(text, "^\\w{3} (.*) IST", "$1"), F.lit(" +0530")), F.lit("MMM d HH:mm:ss yyyy Z"))),
    )
    return F.when((F.year(parsed) >= 2000) & (parsed <= at + F.expr("INTERVAL 2 DAYS")), parsed)


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first (name, pattern) that the text has; rules are one expression."""
    found = F.lit(otherwise)
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found
