"""Numbers with units in text, in base units, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spelling, dimension and factor to the base unit.
UNITS = (
    ("km", "length", 1000.0), ("mm", "length", 0.001), ("cm", "length", 0.01), ("metres", "length", 1.0),
    ("crore", "currency", 1e7), ("lakh", "currency", 1e5), ("kmph", "speed", 1.0), ("cusecs", "volume-rate", 1.0),
    ("percent", "percent", 1.0), ("people", "count", 1.0), ("districts", "district-count", 1.0),
)
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozen": 12, "hundred": 100}


def number_token(token: Column) -> Column:
    """Digits with thousands commas and a decimal point, or a number word."""
    word = F.create_map(*[F.lit(x) for k, v in WORDS.items() for x in (k, float(v))])
    return F.coalesce(F.when(token.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$"), F.replace(token, F.lit(",")).try_cast("double")), word[F.lower(token)])


def quantities(text: Column) -> Column:
    """Array of {unit, dimension, value} in the order of UNITS, value in the base unit."""

    def of(unit: str, dimension: str, factor: float) -> Column:
        pattern = rf"(?:^|[^\p{{L}}\p{{N}}])((?:[0-9][0-9,]*(?:\.[0-9]+)?)) ?{unit}(?:$|[^\p{{L}}\p{{N}}])"
        found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
        return F.transform(found, lambda n: F.struct(F.lit(unit).alias("unit"), F.lit(dimension).alias("dimension"), (number_token(n) * factor).alias("value")))

    return reduce(lambda a, b: F.concat(a, b), [of(*unit) for unit in UNITS])


def equivalent(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Whether two quantity arrays share a dimension with values that close."""
    near = lambda x, y: (x["dimension"] == y["dimension"]) & (F.abs(x["value"] - y["value"]) <= tolerance * F.greatest(F.abs(x["value"]), F.abs(y["value"])))
    return F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))
