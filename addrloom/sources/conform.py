"""Source configurations compiled to columns: field, list, leading number, street after it, pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as c
from ..functions import vocab as v
from ..functions.text import normalize_spaces
from .formats import Row, Steps

FALLBACK_LINES = ("FULL_ADDR", "FullAddr", "FULL_ADDRESS", "ADDRESS", "ADDR", "SITEADD", "SITUS_ADDR")
OUT = ("NUMBER", "STREET", "UNIT", "CITY", "REGION", "POSTCODE", "SOURCE", "SOURCE_ID", "COUNTY", "LOCALITY_STATUS")


def _field(r: Row, name) -> Column:
    """A column by name, then whatever its case, then by letters and digits alone; '' if there is none."""
    plain = lambda x: re.sub("[^A-Z0-9]+", "", str(x).upper())
    own = r(str(name)) if name else None
    if own is None and name:
        own = next((r(n) for n in r.names if plain(n) == plain(name)), None)
    return F.lit("") if own is None else c.clean(own)


def value(r: Row, spec) -> Column:
    """One output value as a configuration describes it."""
    if spec is None:
        return F.lit("")
    if isinstance(spec, str):
        return _field(r, spec)
    if isinstance(spec, list):
        return F.trim(normalize_spaces(F.concat_ws(" ", *(value(r, s) for s in spec))))
    if not isinstance(spec, dict):
        return c.clean(F.lit(str(spec)))
    field = _field(r, spec.get("field"))
    kind = str(spec.get("function", "")).lower()
    if kind == "prefixed_number":
        return c.split_house(field).house
    if kind == "postfixed_street":
        return c.street_name(c.split_house(field).rest)
    if kind == "regexp":
        pattern, to = str(spec.get("pattern", "")), str(spec.get("replace", "$1"))
        groups = re.compile(pattern).groups
        to = to or ("$1" if groups else "")
        pieces = [F.regexp_extract(field, pattern, int(p[1:])) if re.fullmatch(r"\$\d+", p) and int(p[1:]) <= groups else F.lit(p) for p in re.split(r"(\$\d+)", to) if p]
        return F.when(field.rlike(pattern), c.clean(F.concat(*pieces) if pieces else F.lit(""))).otherwise("")
    return F.lit("")


def has_locality(conform: dict, coverage: dict) -> bool:
    return bool(conform.get("city") or conform.get("postcode") or (coverage or {}).get("city"))


def _state_code(text) -> str:
    text = re.sub("[^A-Z]+", "", str(text or "").upper())
    return v.STATE_CODES.get(text) or next((a for a, n in v.STATES.items() if n.replace(" ", "") == text), "")


def county_only(conform: dict, coverage: dict) -> bool:
    """Layers with house and street but no place, of a known county of the state."""
    coverage = coverage or {}
    return bool(conform.get("number") and conform.get("street") and not conform.get("city") and not conform.get("postcode") and _state_code(coverage.get("state")) == "MS" and coverage.get("county"))


def normalize(rows: DataFrame, conform: dict, source: str, coverage: dict | None = None, allow_county_only: bool = False) -> DataFrame:
    """Rows of a layer in the shape OUT; rows without house, street or place, or with a zip of another state, go."""
    r, let, coverage = Row(rows), Steps(rows), coverage or {}
    house, street = let(c.house_number(value(r, conform.get("number")))), let(value(r, conform.get("street")))
    for name in dict.fromkeys(n.lower() for n in FALLBACK_LINES):
        if r(name) is None:
            continue
        line = let(_field(r, name))
        found = let(c.split_house(line))
        ask = (line != "") & ((house == "") | (street == ""))
        house, street = let(F.when(ask & (house == ""), found.house).otherwise(house)), let(F.when(ask & (street == ""), found.rest).otherwise(street))
    city, region, zip_code = let(c.place(let(value(r, conform.get("city"))))), let(c.state(let(value(r, conform.get("region"))))), let(c.zip_code(value(r, conform.get("postcode"))))
    if coverage.get("city"):
        city = let(F.when(city == "", c.place(F.lit(str(coverage["city"])))).otherwise(city))
    region = F.when(region == "", F.lit(_state_code(coverage.get("state")) or "MS")).otherwise(region)
    county = str(coverage.get("county") or "")
    may = bool(allow_county_only and county and _state_code(coverage.get("state")) == "MS")
    status = F.when((city == "") & (zip_code == ""), v.COUNTY_ONLY_STATUS).otherwise("situs_locality")
    columns = (house, c.street_name(street), F.substring(F.upper(value(r, conform.get("unit"))), 1, 24), city, region, zip_code, F.lit(source), value(r, conform.get("id")), F.lit(county), status)
    out = let.df.select(*(x.alias(n) for n, x in zip(OUT, columns)))
    placed = (F.col("CITY") != "") | (F.col("POSTCODE") != "") | ((F.col("REGION") == "MS") & F.lit(may))
    return out.where((F.col("NUMBER") != "") & (F.col("STREET") != "") & placed & c.zip_fits_state(F.col("POSTCODE"), F.col("REGION")))
