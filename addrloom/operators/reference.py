"""The reference table: normalized rows, places, postings, union with first-wins dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.freeform import Places
from ..functions.text import normalize_text, s, standardize, street_core, street_signature, tokens, phonetic_signature, soundex_code
from ..functions.vocab import PARTS
from ..storage import numbered

#: A place table beyond this many rows isn't sent to readers.
MOST_PLACES = 2_000_000


def prepare(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Reference rows from any table with an address_id and the ten parts.

    Parts are normalized, source_quality is clamped to [0, 1] and .5 if missing,
    ref_ord keeps the order of insertion (of ids if no ``order`` is given).
    """
    has = set(rows.columns)
    quality = F.coalesce(F.expr("try_cast(source_quality AS double)"), F.lit(0.5)) if "source_quality" in has else F.lit(0.5)
    line = s("canonical_address") if "canonical_address" in has else standardize(lambda p: normalize_text(p))
    base = rows.select(
        F.col("address_id").cast("string").alias("address_id"), *((normalize_text(p) if p in has else F.lit("")).alias(p) for p in PARTS),
        line.alias("canonical_address"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)).alias("source_quality"),
        (order if order is not None else F.col("address_id").cast("string")).alias("ref_ord"),
    )
    return base.withColumns({"standardized_address": standardize(), "signature": street_signature(), "core": street_core()})


def place_counts(ref: DataFrame) -> DataFrame:
    """city, state, zip_code, n, last: one row per distinct place, with the place of its last row in the order."""
    return ref.groupBy("city", "state", "zip_code").agg(F.count(F.lit(1)).alias("n"), F.max("ref_ord").alias("last"))


def places(ref: DataFrame, most: int = MOST_PLACES) -> Places:
    """The distinct places for readers; an error if there are too many to send."""
    rows = place_counts(ref).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} places")
    return Places.of([tuple(r) for r in rows])


def city_lookup(ref: DataFrame) -> DataFrame:
    """city_key (words of the city) -> city of its last row."""
    return ref.where("city != ''").groupBy(F.array_join(F.split("city", " "), " ").alias("city_key")).agg(F.max_by("city", "ref_ord").alias("city"))


def only_states(ref: DataFrame) -> DataFrame:
    """Cities that lie in one state alone."""
    return ref.where("city != '' AND state != ''").groupBy("city").agg(F.countDistinct("state").alias("n"), F.min("state").alias("state")).where("n = 1").drop("n")


def canonical_index(ref: DataFrame) -> DataFrame:
    """Normalized canonical line -> row added last."""
    return ref.groupBy(normalize_text("canonical_address").alias("canonical_key")).agg(F.max_by("address_id", "ref_ord").alias("address_id"))


def augment(primary: DataFrame, extra: DataFrame, prefix: str = "AUG") -> tuple[DataFrame, DataFrame]:
    """Union of two prepared tables, first row of equal parts kept; taken ids of added rows become PREFIX_0000001...

    Returns the rows and one row of counts.
    """
    both = primary.withColumn("_side", F.lit(0)).unionByName(extra.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*PARTS).orderBy("_side", "ref_ord", "address_id")
    first = both.withColumn("_n", F.row_number().over(w))
    kept = first.where("_n = 1")
    own = kept.where("_side = 0")
    new = kept.where("_side = 1").withColumn("_twice", F.row_number().over(Window.partitionBy("address_id").orderBy("ref_ord")))
    taken = primary.select("address_id").distinct().withColumn("_taken", F.lit(True))
    marked = new.join(taken, "address_id", "left").withColumn("_clash", F.col("_taken").isNotNull() | (F.col("_twice") > 1))
    renamed = numbered(marked.where("_clash"), ["ref_ord", "address_id"], "_k")
    renamed = renamed.withColumn("address_id", F.format_string(f"{prefix}_%07d", F.col("_k")))
    rows = own.select(*primary.columns).unionByName(marked.where("NOT _clash").select(*primary.columns)).unionByName(renamed.select(*primary.columns))
    stats = first.agg(
        F.count_if(F.expr("_side = 0")).alias("primary_rows"), F.count_if(F.expr("_side = 1")).alias("extra_rows"), F.count_if(F.expr("_side = 1 AND _n = 1")).alias("added_rows"),
        F.count_if(F.expr("_side = 1 AND _n > 1")).alias("duplicate_rows"), F.count_if(F.expr("_n = 1")).alias("total_rows"),
    ).crossJoin(renamed.agg(F.count(F.lit(1)).alias("renamed_ids")))
    return rows, stats


#: Blocking as data: name -> (key columns, weight, postings kept of a key). token and sound stand for each word of the
#: street of three letters or more and its code; city_token for each such word of the city.
BLOCKS = {
    "house_zip_signature": (("house_number", "zip_code", "signature"), 12.0, 10),
    "house_zip_name": (("house_number", "zip_code", "street_name"), 10.0, 12),
    "house_zip": (("house_number", "zip_code"), 11.0, 120),
    "house_city_signature": (("house_number", "city", "state", "signature"), 9.0, 12),
    "house_city_name": (("house_number", "city", "state", "street_name"), 8.0, 15),
    "house_city": (("house_number", "city", "state"), 11.0, 160),
    "zip": (("zip_code",), 7.0, 50),
    "house_zip3": (("house_number", "zip3"), 8.5, 160),
    "zip3": (("zip3",), 2.5, 70),
    "city": (("city", "state"), 5.5, 60),
    "city_signature": (("city", "state", "signature"), 7.5, 80),
    "city_name": (("city", "state", "street_name"), 7.0, 100),
    "city_token": (("city", "state", "token"), 10.0, None),
    "city_sound": (("city", "state", "sound"), 9.0, None),
    "state": (("state",), 1.0, 90),
    "house": (("house_number",), 6.0, 60),
    "zip3_token": (("zip3", "token"), 6.0, 120),
    "zip3_sound": (("zip3", "sound"), 5.0, 140),
    "street_token": (("token",), 1.8, 35),
    "city_word": (("city_token",), 0.8, 25),
}
_MANY = {"token": "_tokens", "sound": "_sounds", "city_token": "_city_tokens"}
_SEP = "\x1f"


def with_keys(rows: DataFrame, name: str = "_keys", blocks=tuple(BLOCKS)) -> DataFrame:
    """Adds ``name``: an array of (block, key) for every rule of ``blocks`` whose parts are all present."""
    long_ = lambda c: F.filter(tokens(c), lambda t: F.length(t) >= 3)
    ready = rows.withColumns({"zip3": F.substring("zip_code", 1, 3), "_tokens": long_("street_name"), "_city_tokens": long_("city")})
    ready = ready.withColumn("_sounds", F.filter(F.transform("_tokens", soundex_code), lambda x: x != ""))

    def keys(name: str) -> Column:
        columns = BLOCKS[name][0]
        fixed = [c for c in columns if c not in _MANY]
        many = next((_MANY[c] for c in columns if c in _MANY), None)
        start = F.concat_ws(_SEP, F.lit(name), *(F.col(c) for c in fixed))
        present = F.lit(True)
        for c in fixed:
            present = present & (F.col(c) != "")
        each = F.transform(many, lambda t: F.concat_ws(_SEP, start, t)) if many else F.array(start)
        return F.when(present, F.transform(each, lambda k: F.struct(F.lit(name).alias("block"), k.alias("key")))).otherwise(F.array())

    return ready.withColumn(name, F.concat(*(keys(n) for n in blocks))).drop("zip3", *_MANY.values())


def block_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """keep..., block, key for every rule whose parts are all present."""
    return with_keys(rows).select(*keep, F.explode("_keys").alias("_b")).select(*keep, "_b.block", "_b.key")


def postings(ref: DataFrame) -> DataFrame:
    """block, key, address_id: of each key the first rows that its rule keeps, in the order of insertion."""
    limit = F.create_map(*(x for n, (_, _, most) in BLOCKS.items() if most for x in (F.lit(n), F.lit(most))))
    keyed = block_keys(ref, "address_id", "ref_ord").distinct()
    w = Window.partitionBy("key").orderBy("ref_ord", "address_id")
    most = max(m for _, _, m in BLOCKS.values() if m)
    unlimited = [n for n, (_, _, m) in BLOCKS.items() if not m]
    # the common bound stands as a filter on the rank alone, which Spark applies before the shuffle
    limited = keyed.where(~F.col("block").isin(unlimited)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where(F.col("_n") <= limit[F.col("block")])
    return limited.drop("_n").unionByName(keyed.where(F.col("block").isin(unlimited))).drop("ref_ord")


def with_sounds(ref: DataFrame) -> DataFrame:
    return ref.withColumns({"name_sound": phonetic_signature("street_name"), "city_sound": phonetic_signature("city")})
