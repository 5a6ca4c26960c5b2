"""Native column expressions that clean source values. Missing values come out as ''."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import normalize_spaces, s


def _map(table: dict[str, str]) -> Column:
    """A constant map as one expression, folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def let(value: Column, f) -> Column:
    """f of a value that is computed, and stands in the plan, once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(table), key), F.lit(""))


def clean(c: Column | str) -> Column:
    """Without byte-order mark and outer quotes, single spaces; markers of missing values are ''."""
    text = F.trim(F.replace(s(c), F.lit("﻿"), F.lit("")))
    text = normalize_spaces(F.regexp_replace(text, "^['\"]+|['\"]+$", ""))
    return F.regexp_replace(text, _MISSING, "")


_MISSING = "(?i)^(" + "|".join(x for x in v.MISSING if x) + ")$"


def token(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9]+", "")


def first_of(row, names, f=clean) -> Column:
    """First non-empty f(value) among aliases; ``row`` finds a column by name whatever its case, or None."""
    values = [f(row(n)) for n in names if row(n) is not None]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in values), F.lit(""))


def direction(c) -> Column:
    return lookup(v.DIRECTION_CODES, token(c))


def street_type(c) -> Column:
    return lookup(v.STREET_TYPE_CODES, token(c))


def unit_type(c) -> Column:
    return lookup(v.UNIT_TYPE_CODES, token(c))


def state(c) -> Column:
    return lookup({**v.STATE_CODES, **{n.replace(" ", ""): a for a, n in v.STATES.items()}}, token(c))


def title(c: Column) -> Column:
    """Capitalized words; words with digits and known abbreviations in upper case."""

    def word(w: Column) -> Column:
        upper = F.upper(w)
        capital = F.concat(F.substring(upper, 1, 1), F.lower(F.substring(w, 2, 10_000)))
        return F.when(w.rlike(r"\d") | F.regexp_replace(upper, "[^A-Z0-9]+", "").isin(*v.KEPT_UPPER), upper).otherwise(capital)

    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), word), " ")


def house_number(c: Column | str) -> Column:
    """Upper case without spaces, with a digit other than 0; whole numbers in any notation as digits; 24 characters."""
    text = F.regexp_replace(F.upper(clean(c)), r"\s+", "")

    def made(x: Column) -> Column:
        value = x.try_cast("decimal(38,10)")
        whole = (value == F.floor(value)) & x.rlike(r"^[+-]?\d+(\.\d+)?(E[+-]?\d+)?$")
        return (
            F.when(~F.regexp_replace(x, r"\D+", "").rlike("[1-9]"), "")
            .when(whole & (value != 0), F.floor(value).cast("string"))
            .otherwise(F.substring(F.trim(x, F.lit(",;")), 1, 24))
        )

    return let(text, made)


def zip_code(c) -> Column:
    return F.regexp_extract(clean(c), r"\d{5}", 0)


def zip_fits_state(zip_: Column, state_: Column) -> Column:
    """Blank zips and states without a list fit."""
    ok = F.lit(True)
    for code, prefixes in v.STATE_ZIP_PREFIXES.items():
        ok = F.when(state_ == code, F.substring(zip_, 1, 3).isin(*prefixes)).otherwise(ok)
    return (zip_ == "") | ok


def place(c) -> Column:
    """City name without 'City of' or 'County', titled; '' for placeholders."""
    text = F.trim(F.regexp_replace(F.replace(clean(c), F.lit("_"), F.lit(" ")), r"\s+", " "), F.lit(" ,"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)^(city|town|village)\s+of\s+", ""), r"(?i)\s+(city|town|village|county)$", "")
    return let(title(text), lambda out: F.when(F.regexp_replace(F.upper(out), "[^A-Z0-9]+", "").isin(*v.PLACE_PLACEHOLDERS), "").otherwise(out))


def street_name(c) -> Column:
    text = F.regexp_replace(F.replace(clean(c), F.lit("/"), F.lit(" ")), r"[,\t]+", " ")
    return title(F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(" .")))


def without_side(c) -> Column:
    return F.regexp_replace(clean(c), v.SIDE_OF_ROAD, "")


_DESCRIPTOR = (
    rf"^$|^({'|'.join(v.DESCRIPTOR_STARTS)})( |$)|^({'|'.join(v.DIRECTION_CODES)}|CORNER) OF( |$)"
    rf"|^({'|'.join(v.DESCRIPTOR_LAND)}) ({'|'.join(v.DESCRIPTOR_WHERE)})( |$)|{v.DESCRIPTOR_DATE[4:]}"
)


def is_descriptor(c) -> Column:
    """Lines that tell where a parcel lies rather than its address."""
    return F.upper(street_name(without_side(c))).rlike(_DESCRIPTOR)


def without_last_type(name: Column, kind: Column) -> Column:
    """Street name without a last word that repeats the type."""
    last = street_type(F.regexp_extract(name, r" (\S+)$", 1))
    return F.when((kind != "") & (last == kind), F.regexp_replace(name, r" \S+$", "")).otherwise(name)


def unit(c) -> Column:
    """struct(unit_type, unit_value): a known type and the rest, or UNIT and all; 24 characters."""

    def made(x: Column) -> Column:
        value = F.when((x.kind != "") & (x.rest != ""), x.rest).otherwise(x.text)
        return F.struct(F.when(x.text == "", "").when(x.kind != "", x.kind).otherwise("UNIT").alias("unit_type"), F.substring(F.upper(value), 1, 24).alias("unit_value"))

    def split(text: Column) -> Column:
        words = F.regexp_replace(F.trim(F.replace(text, F.lit("#"), F.lit(" # "))), r"\s+", " ")
        return F.struct(text.alias("text"), unit_type(F.substring_index(words, " ", 1)).alias("kind"), F.regexp_replace(words, r"^\S+ ?", "").alias("rest"))

    return let(let(clean(c), split), made)


_HOUSE_LINE = r"(?i)^\s*([0-9]+[A-Z0-9\-/]*)\s+(.+)$"


def split_house(line: Column) -> Column:
    """struct(house, rest): a leading number and what follows, or '' and the whole line."""
    house = house_number(F.regexp_extract(line, _HOUSE_LINE, 1))
    return F.struct(house.alias("house"), F.regexp_replace(line, _HOUSE_LINE, "$2").alias("rest"))


def street_parts(line) -> Column:
    """struct(predir, street_name, street_type, suffixdir) of a street line."""
    first, last = r"^(\S+) ?", r" ?(\S+)$"

    def before(c: Column) -> Column:
        return let(direction(F.regexp_extract(c, first, 1)), lambda d: F.struct(c.alias("all"), d.alias("pre"), F.when(d != "", F.regexp_replace(c, first, "")).otherwise(c).alias("rest")))

    def after(x: Column) -> Column:
        return let(direction(F.regexp_extract(x.rest, last, 1)), lambda d: F.struct(x["all"].alias("all"), x.pre.alias("pre"), d.alias("suf"), F.when(d != "", F.regexp_replace(x.rest, last, "")).otherwise(x.rest).alias("rest")))

    def typed(x: Column) -> Column:
        return let(street_type(F.regexp_extract(x.rest, last, 1)), lambda k: F.struct(x["all"].alias("all"), x.pre.alias("pre"), x.suf.alias("suf"), k.alias("kind"), F.when(k != "", F.regexp_replace(x.rest, last, "")).otherwise(x.rest).alias("rest")))

    def done(x: Column) -> Column:
        whole = (x.rest == "") & (x.pre != "") & (x.kind != "")
        name = F.when(whole, F.initcap(lookup(v.DIRECTIONS, x.pre))).when(x.rest == "", x["all"]).otherwise(x.rest)
        named = let(name, lambda n: without_last_type(n, x.kind))
        return F.struct(F.when(whole, "").otherwise(x.pre).alias("predir"), named.alias("street_name"), x.kind.alias("street_type"), x.suf.alias("suffixdir"))

    return let(let(let(let(street_name(without_side(line)), before), after), typed), done)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
