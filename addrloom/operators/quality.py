"""Audits and enrichment of sources: zip-city consensus, net-new rows, skip reasons, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical_line, normalize_text, query_key

LEAST_RECORDS, LEAST_SHARE = 25, 0.98


def zip_city_consensus(records: DataFrame, order: list[str], least: int = LEAST_RECORDS, share: float = LEAST_SHARE) -> DataFrame:
    """zip_code, city of zips where one city has at least ``share`` of at least ``least`` records.

    A city's spelling is that of its first record anywhere; of equal counts the
    city that came first wins.
    """
    given = records.where("zip_code != '' AND city != ''").withColumn("city_key", normalize_text("city")).where("city_key != ''")
    spelling = given.groupBy("city_key").agg(F.min_by("city", F.struct(*order)).alias("display"))
    counts = given.groupBy("zip_code", "city_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy("zip_code")
    top = counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "_first"))})
    good = top.where((F.col("rank") == 1) & (F.col("total") >= least) & (F.col("n") / F.col("total") >= share))
    return good.join(spelling, "city_key").select("zip_code", F.col("display").alias("city"))


def zip_city_enrichment(records: DataFrame, order: list[str], **how) -> DataFrame:
    """Rows to add: records without a city at the city of their zip, unless their key is taken; the first of equal ones."""
    consensus = zip_city_consensus(records, order, **how)
    filled = records.where("city = '' AND zip_code != ''").drop("city").join(consensus, "zip_code")
    keyed = filled.withColumn("dedupe_key", query_key(canonical_line()))
    w = Window.partitionBy("dedupe_key").orderBy(*order)
    first = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    taken = records.select(query_key(canonical_line()).alias("dedupe_key")).distinct()
    return first.join(taken, "dedupe_key", "left_anti")


def record_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct cities and zips, and rows without them."""
    city = F.when(F.col("city") != "", F.upper(normalize_text("city")))
    return records.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(city).alias("city_count"), F.countDistinct(F.nullif("zip_code", F.lit(""))).alias("zip_count"),
        F.count_if(F.expr("city = ''")).alias("blank_city_records"), F.count_if(F.expr("zip_code = ''")).alias("blank_zip_records"),
    )


def net_new(records: DataFrame, order: list[str]) -> DataFrame:
    """source_ord, rows, net_new, duplicates against earlier sources of rows with dedupe_key.

    Rows of one source are unique by key already. Each key counts as new for the
    first source that has it.
    """
    w = Window.partitionBy("dedupe_key").orderBy("source_ord", *order)
    marked = records.withColumn("_first", F.row_number().over(w) == 1)
    return marked.groupBy("source_ord").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("_first")).alias("net_new"), F.count_if(F.expr("NOT _first")).alias("duplicates"))


def audit(records: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a source: rows seen, loaded, skipped, reasons as a map, and the summary of its records."""
    per = stats.groupBy("source_ord").agg(
        F.sum("rows").alias("rows_seen"), F.sum(F.when(F.col("reason") == "loaded", F.col("rows")).otherwise(0)).alias("net_new"),
        F.sum(F.when(F.col("reason").isin("loaded", "duplicate_across_sources"), F.col("rows")).otherwise(0)).alias("rows_loaded"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "rows")))).alias("reasons"),
    )
    return per.join(record_summary(records, ["source_ord"]), "source_ord", "left").fillna(0)


def audit_summary(sources: list[dict], covered: list[str], missing: list[str], baseline: int | None = None) -> dict:
    """Totals over the rows of ``audit``, counties covered, and whether the new records outnumber a baseline."""
    reasons: dict[str, int] = {}
    for one in sources:
        for reason, n in (one.get("reasons") or {}).items():
            reasons[reason] = reasons.get(reason, 0) + n
    total = lambda name: sum(int(one.get(name) or 0) for one in sources)
    skipped = {r: n for r, n in sorted(reasons.items()) if r not in ("loaded", "duplicate", "duplicate_across_sources")}
    out = {
        "source_count": len(sources), "rows_seen": total("rows_seen"), "rows_loaded": total("rows_loaded"), "rows_skipped": sum(skipped.values()), "skip_reasons": skipped, "net_new_records": total("net_new"),
        "duplicate_rows": reasons.get("duplicate", 0), "duplicate_against_prior_sources": reasons.get("duplicate_across_sources", 0), "covered_counties": covered, "missing_counties": missing,
    }
    return out if baseline is None else {**out, "baseline_reference_count": baseline, "beats_baseline": out["net_new_records"] > baseline}
