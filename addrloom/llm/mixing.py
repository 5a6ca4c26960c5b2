"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source, documents stand in the order of their size class, a hash and
their id; each adds its expected copies to a running sum that starts at one
random offset, and is taken once per integer boundary its step crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows (source, size); one row a source is gathered.

    Weights 1, 2, 3 repeat over the sources by code point, null last. A source
    stops at ``most`` times its size; what it leaves goes to the others by
    weight, until none is above: with the sources in order of cap / weight, the
    level is the first that the next source's cap doesn't undercut.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = one.withColumn("_weight", (F.row_number().over(w) - 1) % 3 + 1).withColumn("_cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    leveled = ranked.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_weight").over(everything)).withColumn("_level", level)
    # the level of the first source that stays below its cap holds for all; capped sources come before it
    open_ = leveled.withColumn("_open", F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.col("_level"))).withColumn("_at", F.first("_open", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_at").isNull() | (F.col("_cap") <= F.col("_at") * F.col("_weight")), F.col("_cap").cast("double")).otherwise(F.col("_at") * F.col("_weight"))
    return open_.select("source", "source_size", target.alias("target"))


def _class(size: Column) -> Column:
    """Order of sizes by their binary length and six leading digits."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 6))


def _offset(source: Column, seed: int) -> Column:
    """Random in [0, 1), from the source and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x01null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out: str = "_mix") -> DataFrame:
    """Adds struct column ``out`` to every row of ``docs``: size, source_size, target and copies (0 to 3).

    Null text counts as empty; empty documents have size 0 and take part. Null
    sources form a source of their own. Ties and repeated rows are rows of their
    own: equal rows may get different copies. An empty table stays empty. All
    other columns are kept, whatever their names; only one named ``out`` is replaced.
    """
    docs = docs.drop(out)
    names = docs.columns
    column = {name: F.col(f"c{i}") for i, name in enumerate(names)}
    doc_id, source = column[id_col], column[source_col].cast("string")
    named = numbered(docs).withColumn("size", size_of(column[text_col].cast("string")))
    targets = source_targets(named.select(source.alias("source"), "size"))
    # a key that is never null, so that windows and joins share one partitioning
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    salt = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 2)
    salted = named.select("*", key(source).alias("key"), _class(F.col("size")).alias("class"), salt.alias("salt"))
    keys = ["key", "class", "salt"]
    order = Window.partitionBy("key").orderBy("class", "salt")
    before = (
        salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(order) - F.col("n"))
        .join(targets.select(key(F.col("source")).alias("key"), "source_size", "target"), "key").select(*keys, "before", "source_size", "target")
    )
    local = salted.withColumn("row", F.row_number().over(Window.partitionBy(*keys).orderBy("size", doc_id)))
    rank = F.col("before") + F.col("row")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = _offset(source, seed)
    copies = F.floor(rank * share + u) - F.floor((rank - 1) * share + u)
    mixed = F.struct("size", "source_size", "target", copies.alias("copies"))
    return local.join(before, keys).select(*(column[c].alias(c) for c in names), mixed.alias(out))


def emit(mixed: DataFrame, out: str = "_mix") -> DataFrame:
    """The mix itself: each row as often as it is taken, without ``out``."""
    once = mixed.where(F.col(out).copies > 0)
    times = F.sequence(F.lit(1), F.col(out).copies.cast("int"))
    return once.withColumn(out, F.explode(times)).drop(out)


#: DuckDB SQL for the same steps over a view ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), one AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM one
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, (SELECT level FROM leveled WHERE cap > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS best FROM leveled
), targets AS (
  SELECT source, source_size, CASE WHEN best IS NULL OR cap <= best * weight THEN cap::DOUBLE ELSE best * weight END AS target FROM opened
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 6),
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, doc_id) AS k FROM sized
), shared AS (
  SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    ('0x' || substr(md5('5|' || coalesce(p.source, chr(1) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(k * e + u) - floor((k - 1) * e + u)) * size)::BIGINT AS taken FROM shared
"""
