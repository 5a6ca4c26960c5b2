"""Native column expressions: normalization, signatures, token and number similarity.

Missing values are empty strings; every expression maps null to ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import PARTS

TOKEN = r"([A-Z0-9#]+)"


def s(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_text(c: Column | str) -> Column:
    """Upper case; slash, hyphen, full stop and comma are spaces; apostrophes go; runs of space shrink."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.upper(s(c)), "/-.,", "    "), "'", ""), r"\s+", " "))


def normalize_spaces(c: Column | str) -> Column:
    """Single spaces, none before a comma and one after it."""
    return F.replace(F.trim(F.regexp_replace(F.replace(s(c), F.lit(","), F.lit(" , ")), r"\s+", " ")), F.lit(" ,"), F.lit(","))


def query_key(c: Column | str) -> Column:
    return F.trim(F.upper(F.replace(normalize_spaces(c), F.lit(","), F.lit(""))))


def joined(*parts: Column | str) -> Column:
    """The parts that aren't empty, with a space between."""
    return F.concat_ws(" ", *(F.nullif(s(p), F.lit("")) for p in parts))


def standardize(get=F.col) -> Column:
    """One line of the ten parts: street and unit, comma, locality."""
    c = {p: get(p) for p in PARTS}
    left = joined(*(c[p] for p in PARTS[:7]))
    place = joined(c["city"], c["state"], c["zip_code"])
    return F.when(place == "", left).otherwise(F.trim(F.concat(left, F.lit(", "), place), F.lit(", ")))


def canonical_line(get=F.col) -> Column:
    """Upper-case canonical rendering: unit between commas, only if it has both parts."""
    c = {p: s(get(p)) for p in PARTS}
    unit = F.when((c["unit_type"] != "") & (c["unit_value"] != ""), F.concat(F.lit(", "), c["unit_type"], F.lit(" "), c["unit_value"])).otherwise("")
    street = joined(*(c[p] for p in PARTS[:5]))
    return F.upper(normalize_spaces(F.concat(street, unit, F.lit(", "), joined(c["city"], c["state"], c["zip_code"]))))


def street_signature(get=F.col) -> Column:
    return joined(get("predir"), get("street_name"), get("street_type"), get("suffixdir"))


def street_core(get=F.col) -> Column:
    return joined(get("predir"), get("street_name"), get("suffixdir"))


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(s(c), F.lit(TOKEN), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets: 1 if both are empty, 0 if one is."""
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


_SOUND = str.maketrans({**dict.fromkeys("BFPV", "1"), **dict.fromkeys("CGJKQSXZ", "2"), **dict.fromkeys("DT", "3"), "L": "4", **dict.fromkeys("MN", "5"), "R": "6"})
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "".join(x if x.isdigit() else "0" for x in _LETTERS.translate(_SOUND))


def soundex_code(token: Column) -> Column:
    """Letter and three digits; vowels, H, W and Y end a run of equal digits."""
    letters = F.regexp_replace(normalize_text(token), "[^A-Z]+", "")
    digits = F.regexp_replace(F.translate(letters, _LETTERS, _DIGITS), r"(\d)\1+", "$1")
    rest = F.replace(F.substring(digits, 2, 1000), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.substring(F.rpad(F.concat(F.substring(letters, 1, 1), rest), 4, "0"), 1, 4))


def phonetic_signature(c: Column | str) -> Column:
    every = F.regexp_extract_all(s(c), F.lit(TOKEN), F.lit(1))
    return F.array_join(F.filter(F.transform(every, soundex_code), lambda x: x != ""), " ")


def number_gap_similarity(a: Column, b: Column) -> Column:
    """1 less a 25th per number between two whole numbers; null where it isn't a matter of numbers."""
    both = a.rlike(r"^\d{1,18}$") & b.rlike(r"^\d{1,18}$")
    gap = F.abs(a.cast("long") - b.cast("long"))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(both, F.greatest(F.lit(0.0), 1 - F.least(gap, F.lit(25)) / 25))
