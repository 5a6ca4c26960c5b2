"""Address tables of six formats to one shape, with reject reasons and first-wins dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as c
from ..functions import vocab as v
from ..functions.generic import full_address
from ..functions.text import canonical_line, query_key
from ..functions.vocab import PARTS
from ..storage import stored


def detect(columns: list[str], requested: str = "auto") -> str:
    """Format of a header."""
    if requested != "auto":
        return requested
    exact = {x.replace("﻿", "") for x in columns}
    low = {x.lower() for x in exact}
    if {"siteadd", "scity"} <= low:
        return "maris_parcels"
    if {"NUMBER", "STREET"} <= exact:
        return "openaddresses"
    if {"add_number", "st_name"} <= low:
        return "nad"
    if low & {"fulladdr", "fullname"} or {"stnum", "name", "type"} <= low or {"address", "street", "streettype"} <= low or {"street_add", "road_name"} <= low:
        return "maris"
    if {"house_number", "street_name", "state"} <= low:
        return "address_record"
    return "generic" if low & set(v.FULL_ADDRESS_FIELDS) else "openaddresses"


class Row:
    """Columns of a table by name, whatever their case; names that the table lacks are None."""

    def __init__(self, df: DataFrame):
        self.names: dict[str, str] = {}
        for n in df.columns:
            self.names.setdefault(n.replace("﻿", "").lower(), n)

    def __call__(self, name: str) -> Column | None:
        own = self.names.get(name.lower())
        return None if own is None else F.col(f"`{own}`")

    def get(self, *names: str, f=c.clean) -> Column:
        return c.first_of(self, names, f)

    def all(self) -> Column:
        return F.concat_ws(" ", *(F.nullif(c.clean(F.col(f"`{n}`")), F.lit("")) for n in self.names.values()))


class Steps:
    """A table that gains a column per step, so that no expression holds another one twice."""

    def __init__(self, df: DataFrame):
        self.df, self.n = df, 0

    def __call__(self, c: Column) -> Column:
        self.n += 1
        self.df = self.df.withColumn(f"_step{self.n}", c)
        return F.col(f"_step{self.n}")


def _or(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def _own_house(let: Steps, house: Column, line: Column) -> tuple[Column, Column]:
    """House and street, where the line may start with the number."""
    house, line = let(house), let(line)
    found = let(c.split_house(line))
    return let(F.when(house == "", found.house).otherwise(house)), let(F.when((house == "") | (found.house == house), found.rest).otherwise(line))


def _openaddresses(let: Steps, r: Row, state: str) -> dict[str, Column]:
    house, line = _own_house(let, r.get("NUMBER", f=c.house_number), r.get("STREET"))
    street, unit = let(c.street_parts(line)), let(c.unit(let(r.get("UNIT"))))
    return {
        "house_number": house, **{p: street[p] for p in PARTS[1:5]}, "unit_type": unit.unit_type, "unit_value": unit.unit_value,
        "city": r.get("CITY", "DISTRICT", "LOCALITY", f=c.place), "state": _or(c.state(r.get("REGION", "STATE")), F.lit(state)), "zip_code": c.zip_code(r.get("POSTCODE", "ZIP", "ZIP_CODE")),
    }


def _nad(let: Steps, r: Row, state: str) -> dict[str, Column]:
    house = _or(let(c.house_number(r.get("AddNo_Full"))), c.house_number(F.concat_ws(" ", *(F.nullif(r.get(n), F.lit("")) for n in ("AddNum_Pre", "Add_Number", "AddNum_Suf")))))
    kind = let(c.street_type(r.get("St_PosTyp")))
    words = (r.get("St_PreMod"), F.when(kind == "", r.get("St_PreTyp")).otherwise(""), r.get("St_Name"), r.get("St_PosMod"))
    name = let(c.street_name(let(F.concat_ws(" ", *(F.nullif(w, F.lit("")) for w in words)))))
    whole = let(c.street_parts(let(r.get("StNam_Full"))))
    lacks = name == ""
    filled = lambda own, p: F.when(lacks & (own == ""), whole[p]).otherwise(own)
    units = [let(c.unit(let(r.get(n)))) for n in ("Unit", "Room", "Building", "Floor")]
    first = F.coalesce(*(F.when(u.unit_type != "", u) for u in units), units[0])
    return {
        "house_number": house, "predir": filled(c.direction(r.get("St_PreDir")), "predir"), "street_name": F.when(lacks, whole.street_name).otherwise(name),
        "street_type": filled(kind, "street_type"), "suffixdir": filled(c.direction(r.get("St_PosDir")), "suffixdir"), "unit_type": first.unit_type, "unit_value": first.unit_value,
        "city": r.get(*v.NATIONAL_CITY_FIELDS, f=c.place), "state": c.state(r.get("State")), "zip_code": c.zip_code(r.get("Zip_Code")),
    }


def _generic(let: Steps, r: Row, state: str) -> dict[str, Column]:
    kind = let(r.get("street_type", "road_type", "type"))
    own = {
        "house_number": r.get("house_number", "number", "addr_num", "address_number", f=c.house_number), "predir": c.direction(r.get("predir", "pre_dir", "prefix_direction")),
        "street_name": c.street_name(r.get("street_name", "road_name", "name")), "street_type": _or(c.street_type(kind), c.token(kind)),
        "suffixdir": c.direction(r.get("suffixdir", "sufdir", "post_dir", "suffix_direction")), "unit_type": c.unit_type(r.get("unit_type")),
        "unit_value": F.substring(F.upper(r.get("unit_value", "unit", "suite", "apt")), 1, 24), "city": r.get(*v.CITY_FIELDS, f=c.place),
        "state": _or(c.state(r.get(*v.STATE_FIELDS)), F.lit(state)), "zip_code": c.zip_code(r.get(*v.ZIP_FIELDS)),
    }
    own = {p: let(x) for p, x in own.items()}
    if not any(n in r.names for n in v.FULL_ADDRESS_FIELDS):
        return own
    line = F.when((own["house_number"] == "") | (own["street_name"] == ""), r.get(*v.FULL_ADDRESS_FIELDS)).otherwise("")
    read = let(full_address(let(line), own["city"], own["state"], own["zip_code"]))
    found = let(c.split_house(read.street))
    street = let(c.street_parts(found.rest))
    whole = {"house_number": found.house, **{p: street[p] for p in PARTS[1:5]}, "city": c.place(read.city), "state": read.state, "zip_code": read.zip_code}
    return {p: _or(own[p], F.coalesce(whole[p], F.lit(""))) if p in whole else own[p] for p in PARTS}


def _maris(let: Steps, r: Row, state: str) -> dict[str, Column]:
    general, line = let(r.get("ADDRESS")), let(r.get("STREET_ADD", "FULL_ADDR", "FullAddr", "FULL_ADDRE"))
    line = F.when((line == "") & general.rlike(r"\d") & general.rlike("[A-Za-z]") & general.contains(" "), general).otherwise(line)
    house, line = _own_house(let, r.get("ADDR_NUM", "ADDRESS_NU", "ADDRNUM", "NUMBER", "STNUM", "ST_NUMBER", "ADDRESS", "AddPre", "STNUM_L", f=c.house_number), line)
    base = let(r.get("ROAD_NAME", "ROAD_NAME_", "NAME", "STREET_NAM", "ST_NAME", "Street", "ST_NAME_1", "LgcyStreet", "LABEL", f=c.street_name))
    before = c.street_name(r.get("PreMod"))
    name = let(c.street_name(let(F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(base, F.lit(""))))))
    kind = let(r.get("TYPE", "ROAD_TYPE", "STREET_TYP", "ST_TYPE", "ST_TYPE_1", "ST_TYPE_2", "StreetType", "LgcyType", "TYPE_1", "TYPE_2", f=c.street_type))
    # a type still missing may end the base name, the full name or the line: the first that splits gives all it has
    usable = []
    for text in (base, r.get("FULLNAME", "StNam_Full"), line):
        own = let(c.street_name(let(text)))
        got = let(c.street_parts(own))
        splits = got.street_type.isin(*v.STREET_TYPES) & (got.street_name != "") & (c.token(got.street_name) != c.token(own))
        usable.append(F.when((own != "") & splits, F.struct(got.alias("got"), own.alias("own"))))
    fallback = let(F.when(kind == "", F.coalesce(*usable)))
    has = fallback.isNotNull()
    renamed = has & ((name == "") | (c.token(name) == c.token(fallback.own)))
    pre = let(c.direction(r.get("PRE_DIR", "PREDIR", "PREFIX_DIR", "ST_PREFIXD", "ST_PREDIR", "LgcyPreDir")))
    post = let(c.direction(r.get("POST_DIR", "SUFDIR", "SUFFIX_DIR", "ST_SUFFIXD", "ST_POSTDIR", "LgcySufDir")))
    filled = lambda own, p: F.when(has & (own == ""), fallback.got[p]).otherwise(own)
    street = {"predir": filled(pre, "predir"), "street_name": F.when(renamed, fallback.got.street_name).otherwise(name), "street_type": filled(kind, "street_type"), "suffixdir": filled(post, "suffixdir")}
    street = {p: let(x) for p, x in street.items()}
    whole, lacks = let(c.street_parts(line)), street["street_name"] == ""
    value = let(F.substring(F.upper(r.get("UNIT", "UNIT_ID", "UNIT_NUM", "BldgUnit", "BLDG_UNITS", "Room", "Floor", "BUILDING")), 1, 24))
    own_unit, parsed = let(c.unit_type(r.get("UNIT_TYPE"))), let(c.unit(value))
    bare = (value != "") & (own_unit == "")
    return {
        "house_number": house, **{p: F.when(lacks & (x == ""), whole[p]).otherwise(x) for p, x in street.items()},
        "unit_type": F.when(bare, parsed.unit_type).otherwise(own_unit), "unit_value": F.when(bare, parsed.unit_value).otherwise(value),
        "city": r.get(*v.POINT_CITY_FIELDS, f=c.place), "state": F.lit(state or "MS"), "zip_code": c.zip_code(r.get(*v.POINT_ZIP_FIELDS)),
    }


def _parcels(let: Steps, r: Row, state: str) -> dict[str, Column]:
    found = let(c.split_house(let(r.get(*v.PARCEL_LINE_FIELDS))))
    street = let(c.street_parts(found.rest))
    return {
        "house_number": F.when(c.is_descriptor(found.rest), "").otherwise(found.house), **{p: street[p] for p in PARTS[1:5]}, "unit_type": F.lit(""), "unit_value": F.lit(""),
        "city": r.get(*v.PARCEL_CITY_FIELDS, f=c.place), "state": _or(c.state(r.get("SSTATE", "STATE")), F.lit(state or "MS")), "zip_code": c.zip_code(r.get(*v.PARCEL_ZIP_FIELDS)),
    }


PROJECTIONS = {"openaddresses": _openaddresses, "nad": _nad, "generic": _generic, "address_record": _generic, "maris": _maris, "maris_parcels": _parcels}
_LOCAL = {"nad": (v.NATIONAL_CITY_FIELDS, ("Zip_Code",)), "maris_parcels": (v.PARCEL_CITY_FIELDS, v.PARCEL_ZIP_FIELDS), "maris": (v.POINT_CITY_FIELDS, v.POINT_ZIP_FIELDS)}
_OTHER_LOCAL = (("CITY", "DISTRICT", "LOCALITY", *v.CITY_FIELDS), ("POSTCODE", "ZIP", "ZIP_CODE", *v.ZIP_FIELDS))
_HOUSE_FIELDS = ("NUMBER", "ADDR_NUM", "ADDRESS_NU", "ADDRNUM", "STNUM", "ST_NUMBER", "AddNo_Full", "Add_Number", "STREET_NUM", "PHYNUM", "ADDNUM", "SITUSADDR", "SITEADD", "ADDRESS")
_STREET_FIELDS = ("STREET", "ROAD_NAME", "ROAD_NAME_", "NAME", "STREET_NAM", "ST_NAME", "FULLNAME", "StNam_Full", "SITEADD", "ADDR", "ADDRESS")


def reject_reason(let: Steps, r: Row, kind: str, state: str) -> Column:
    """Why a row that gave no address was refused, by the first reason that holds."""
    given = {"nad": ("State",), "maris_parcels": ("SSTATE", "STATE"), "generic": v.STATE_FIELDS, "address_record": v.STATE_FIELDS}.get(kind, ("REGION", "STATE", "SSTATE"))
    own = let(c.state(let(r.get(*given))))
    own = own if kind == "nad" else let(_or(own, F.lit(state)))
    cities, zips = _LOCAL.get(kind, _OTHER_LOCAL)
    zip_code = let(c.zip_code(r.get(*zips)))
    county_only = c.token(r.get("LOCALITY_STATUS")) == v.COUNTY_ONLY_STATUS.replace("_", "").upper()
    house = c.any_of(c.house_number(r(n)) != "" for n in _HOUSE_FIELDS if r(n) is not None)
    street = let(c.clean(let(F.concat_ws(" ", *(c.clean(r(n)) for n in _STREET_FIELDS if r(n) is not None), F.lit("")))))
    if kind == "maris_parcels":
        street = let(c.split_house(let(r.get(*v.PARCEL_LINE_FIELDS))).rest)
    return (
        F.when((F.lit(state) != "") & (own != "") & (own != state), "state_mismatch")
        .when((zip_code != "") & (own != "") & ~c.zip_fits_state(zip_code, own), "non_ms_zip")
        .when((r.get(*cities, f=c.place) == "") & (zip_code == "") & ~county_only, "missing_locality")
        .when(~house & (c.split_house(let(r.all())).house == ""), "missing_or_invalid_house_number")
        .when((street != "") & c.is_descriptor(street), "parcel_location_descriptor")
        .when(street == "", "missing_street").otherwise("unparseable")
    )


def project(rows: DataFrame, kind: str = "auto", state: str = "MS", order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Every row with the ten parts, source_quality, reject ('' for usable rows), canonical and its key.

    ``order`` names the columns that keep the order of the source; ``columns``
    those of the source itself, where the rows have more.
    """
    kind = detect(columns or rows.columns, kind)
    r, let = Row(rows.select(*(f"`{n}`" for n in columns)) if columns else rows), Steps(rows)
    parts = {p: let(x) for p, x in PROJECTIONS[kind](let, r, state).items()}
    extra = order or []
    county_only = (c.token(r.get("LOCALITY_STATUS")) == v.COUNTY_ONLY_STATUS.replace("_", "").upper()) & (kind == "openaddresses")
    with_county = county_only & (F.lit(state or "MS") == "MS") & (r.get("COUNTY", "COVERAGE_COUNTY") != "")
    quality = F.when(county_only, F.lit(v.COUNTY_ONLY_QUALITY)).otherwise(F.lit(v.SOURCE_QUALITY.get(kind, v.OTHER_QUALITY)))
    why = reject_reason(let, r, kind, state)
    base = let.df.select(*extra, *(x.alias(p) for p, x in parts.items()), quality.alias("source_quality"), with_county.alias("_county"), why.alias("_why"))
    for (st, zip_code, city, street, type_), right in v.STREET_CORRECTIONS.items():
        hit = (F.upper("state") == st) & (F.col("zip_code") == zip_code) & (F.upper("city") == city) & (F.upper("street_name") == street) & (F.upper("street_type") == type_)
        base = base.withColumn("street_name", F.when(hit, right).otherwise(F.col("street_name")))
    base = base.withColumn("street_name", c.without_last_type(F.col("street_name"), F.col("street_type")))
    located = (F.col("city") != "") | (F.col("zip_code") != "") | F.col("_county")
    usable = (
        (F.col("house_number") != "") & (F.col("street_name") != "") & (F.col("state") != "") & (located | F.lit(kind in ("generic", "address_record")))
        & ((F.lit(state) == "") | (F.col("state") == state)) & c.zip_fits_state(F.col("zip_code"), F.col("state"))
        & ~c.is_descriptor("_line")
    )
    base = base.withColumn("_line", F.concat_ws(" ", "street_name", F.nullif(F.col("street_type"), F.lit(""))))
    out = base.withColumn("reject", F.when(usable, "").otherwise(F.col("_why"))).drop("_county", "_why", "_line").withColumn("canonical_address", canonical_line())
    return out.withColumn("dedupe_key", query_key("canonical_address"))


def first_rows(projected: DataFrame, order: list[str]) -> DataFrame:
    """Usable rows, the first of each key."""
    w = Window.partitionBy("dedupe_key").orderBy(*order)
    return projected.where("reject = ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def load(sources: list[tuple[DataFrame, str]], state: str = "MS", order: tuple[str, ...] = ("file_ord", "row_ord"), limit: int | None = None, keep=stored) -> tuple[DataFrame, DataFrame]:
    """(records, stats) of (table, format) pairs with the order columns: dedupe within and across sources, first wins.

    The projected rows are kept once (``keep``) for both, and so that what follows is planned on a table.

    stats: source_ord, reason ('loaded', 'duplicate', 'duplicate_across_sources'
    or a reject), rows.
    """
    # tables of one shape are read as one
    shapes: dict[tuple, DataFrame] = {}
    for i, (rows, kind) in enumerate(sources):
        shape, own = (detect(rows.columns, kind), *rows.columns), rows.withColumn("source_ord", F.lit(i))
        shapes[shape] = shapes[shape].unionByName(own) if shape in shapes else own
    both = None
    for (kind, *columns), rows in shapes.items():
        own = project(rows, kind, state, ["source_ord", *order], columns)
        both = own if both is None else both.unionByName(own)
    both = keep(both)
    inside, across = Window.partitionBy("source_ord", "dedupe_key").orderBy(*order), Window.partitionBy("dedupe_key").orderBy("source_ord", *order)
    usable = both.where("reject = ''").withColumns({"_in": F.row_number().over(inside), "_all": F.row_number().over(across)})
    reason = F.when(F.col("_in") > 1, "duplicate").when(F.col("_all") > 1, "duplicate_across_sources").otherwise("loaded")
    marked = usable.withColumn("reason", reason)
    stats = marked.groupBy("source_ord", "reason").count().unionByName(both.where("reject != ''").groupBy("source_ord", F.col("reject").alias("reason")).count()).withColumnRenamed("count", "rows")
    records = marked.where("reason = 'loaded'").drop("_in", "_all", "reason", "reject")
    if limit is not None:
        records = records.orderBy("source_ord", *order).limit(limit)
    return records, stats
