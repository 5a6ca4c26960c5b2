"""What the address service does, as DataFrame functions: zips, verified addresses, reports, answers, feedback."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_line, joined, s
from ..functions.vocab import PARTS, STATE_ZIP_PREFIXES
from ..storage import numbered, stored
from . import reading
from .reference import places, prepare

HOME_STATE = "MS"
REPORT = (
    "source_row", "source_id", "original_address", "standardized_address", "resolved_address", "confidence", "needs_review", "match_id", "stage",
    "top_candidate_1", "top_candidate_1_score", "top_candidate_2", "top_candidate_2_score", "top_candidate_3", "top_candidate_3_score",
)
#: Keys under which a reference may know the zip of a street, the surest first; the first one that the reference has at all decides.
ZIP_KEYS = (("house_number", "city", "state", "signature"), ("house_number", "city", "state", "street_name"), ("city", "state", "street_name", "street_type"))


def inferred_zips(parsed: DataFrame, ref: DataFrame) -> DataFrame:
    """Adds ``inferred_zip`` to rows with the ten parts: the own zip, else the only one that the reference has for the same house, or else street.

    Each key is an equi-join with one row a key; rows without city or state, and
    keys with several zips, get ''.
    """
    out = parsed.withColumn("signature", joined("predir", "street_name", "street_type", "suffixdir"))
    names = []
    for i, key in enumerate(ZIP_KEYS):
        zips = F.nullif(F.col("zip_code"), F.lit(""))
        known = ref.groupBy(*key).agg(F.min(zips).alias("low"), F.max(zips).alias("high"))
        only = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("")
        names.append(f"_zip{i}")
        out = out.join(known.select(*key, only.alias(names[-1])), list(key), "left")
    found = F.when((F.col("city") == "") | (F.col("state") == ""), "").otherwise(F.coalesce(*names, F.lit("")))
    return out.withColumn("inferred_zip", F.when(F.col("zip_code") != "", F.col("zip_code")).otherwise(found)).select(*parsed.columns, "inferred_zip")


def manual_records(asked: DataFrame, ref: DataFrame, keep=stored) -> DataFrame:
    """row_ord, address, the ten parts and ``error`` (null where the address may be added) of rows (row_ord, address)."""
    raw = asked.select(F.coalesce("address", F.lit("")).alias("raw"))
    parsed = reading.read_all(raw, ref, places(ref), keep).select("raw", "parts.*")
    ready = inferred_zips(parsed, ref).withColumn("zip_code", F.col("inferred_zip")).withColumn("state", F.coalesce(F.nullif("state", F.lit("")), F.lit(HOME_STATE)))
    fits = F.substring("zip_code", 1, 3).isin(*STATE_ZIP_PREFIXES[HOME_STATE])
    error = (
        F.when(F.col("state") != HOME_STATE, "the address is in another state").when((F.col("house_number") == "") | (F.col("street_name") == ""), "a house number and a street are needed")
        .when(F.col("city") == "", "a city is needed").when(F.col("zip_code") == "", "a zip is needed, or one that the reference tells").when(~fits, "the zip is in another state")
    )
    return asked.select("row_ord", F.coalesce("address", F.lit("")).alias("raw")).join(ready.select("raw", *PARTS, error.alias("error")), "raw").withColumnRenamed("raw", "address")


def next_number(rows: DataFrame, prefix: str = "REF_", column: str = "address_id") -> int:
    """One more than the largest number after the prefix."""
    number = F.expr(f"try_cast(regexp_extract({column}, '^{re.escape(prefix)}([0-9]+)$', 1) AS long)")
    return int(rows.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]) + 1


def add_verified(asked: DataFrame, ref: DataFrame, note: str = "", manual: DataFrame | None = None, keep=stored) -> DataFrame:
    """row_ord, address, status (added, existing or failed), address_id, manual_id, canonical_address, error, source_note and the parts.

    Rows are added in order if no reference row and no earlier row has their
    standard form; new ids go on after the largest ones (``manual`` holds the
    supplement so far). Zips are inferred from the reference as it is before.
    """
    records = keep(manual_records(asked, ref, keep))
    good = records.where("error IS NULL")
    rows = prepare(good.withColumn("address_id", F.lit("")).withColumn("source_quality", F.lit(1.0)).withColumn("canonical_address", canonical_line()), F.col("row_ord"))
    rows = keep(rows.withColumnRenamed("ref_ord", "row_ord"))
    known = ref.groupBy("standardized_address").agg(F.min_by(F.struct("address_id", "canonical_address"), "ref_ord").alias("known"))
    first = rows.groupBy("standardized_address").agg(F.min("row_ord").alias("first_ord"))
    new = numbered(first.join(known, "standardized_address", "left_anti"), ["first_ord"], "_k")
    at, manual_at = next_number(ref), 1 if manual is None else next_number(manual, "MANUAL_MS_")
    ids = new.select(
        "standardized_address", "first_ord", F.format_string("REF_%07d", F.col("_k") + at - 1).alias("new_id"), F.format_string("MANUAL_MS_%06d", F.col("_k") + manual_at - 1).alias("manual_id"),
    )
    joined_ = rows.join(known, "standardized_address", "left").join(ids, "standardized_address", "left")
    added = F.col("row_ord") == F.col("first_ord")
    done = joined_.select(
        "row_ord", F.when(added, "added").otherwise("existing").alias("status"), F.coalesce("known.address_id", "new_id").alias("address_id"), F.when(added, F.col("manual_id")).alias("manual_id"),
        F.coalesce("known.canonical_address", "canonical_address").alias("canonical_address"),
    )
    said = F.trim(F.regexp_replace(F.concat_ws(" ", F.lit(note), F.concat(F.lit("row:"), F.col("row_ord").cast("string"))), r"\s+", " "))
    return records.join(done, "row_ord", "left").select(
        "row_ord", "address", F.coalesce("status", F.lit("failed")).alias("status"), "address_id", "manual_id", "canonical_address", "error", F.substring(said, 1, 240).alias("source_note"), *PARTS,
    )


def outcome(added: DataFrame, first: int = 10) -> dict:
    """Counts by status, and the first rows of each."""
    counts = {r.status: r["count"] for r in added.groupBy("status").count().collect()}
    listed = lambda status: [r.asDict() for r in added.where(F.col("status") == status).orderBy("row_ord").limit(first).select("row_ord", "address", "address_id", "canonical_address", "error").collect()]
    out = {"row_count": sum(counts.values())}
    for status in ("added", "existing", "failed"):
        out |= {f"{status}_count": counts.get(status, 0), status: listed(status)}
    return out


def titled(c: Column) -> Column:
    """Each letter that follows no letter in capitals, the others small."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(x)).otherwise(F.lower(x))), "")


def manual_rows(added: DataFrame) -> DataFrame:
    """Added rows as the supplement keeps them."""
    parts = {p: titled(F.col(p)) if p in ("street_name", "city") else F.col(p) for p in PARTS}
    return added.where("status = 'added'").select(F.col("manual_id").alias("address_id"), *(parts[p].alias(p) for p in PARTS), "source_note")


def reference_rows(added: DataFrame) -> DataFrame:
    """Added rows as a reference file keeps them."""
    parts = {p: titled(F.col(p)) if p in ("street_name", "city") else F.col(p) for p in PARTS}
    return added.where("status = 'added'").select("address_id", *(parts[p].alias(p) for p in PARTS), "canonical_address", F.format_string("%.3f", F.lit(1.0)).alias("source_quality"))


def append(rows: DataFrame, path: str) -> None:
    """Append to a CSV table, in the columns that it has; a new table takes the rows' own."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    columns = spark.read.option("header", True).csv(path).columns if there else rows.columns
    rows.select(*((s(c) if c in rows.columns else F.lit("")).alias(c) for c in columns)).write.mode("append").option("header", True).csv(path)


def added_reference(ref: DataFrame, added: DataFrame) -> DataFrame:
    """The prepared reference with added rows after its own; an id that it has already is an error."""
    new = prepare(added.where("status = 'added'").withColumn("source_quality", F.lit(1.0)), F.col("row_ord"))
    if ref.join(new.select("address_id"), "address_id", "left_semi").limit(1).count():
        raise ValueError("an added id is taken")
    last = ref.agg(F.max("ref_ord").alias("m"))
    shifted = new.crossJoin(F.broadcast(last)) if dict(ref.dtypes)["ref_ord"] in ("int", "bigint") else new.withColumn("m", F.lit(0))
    order = (F.coalesce("m", F.lit(0)) + F.col("ref_ord")) if dict(ref.dtypes)["ref_ord"] in ("int", "bigint") else F.concat(F.lit("￿"), F.format_string("%012d", "ref_ord"))
    return ref.unionByName(shifted.withColumn("ref_ord", order.cast(dict(ref.dtypes)["ref_ord"])).drop("m"))


def metadata_with(metadata: dict, n: int, manual_path: str) -> dict:
    """Counters and sources of a dataset's metadata after n verified rows."""
    if n <= 0:
        return metadata
    out = dict(metadata)
    for key in ("rows_seen", "rows_loaded", "reference_records"):
        out[key] = int(out.get(key, 0)) + n
    sources = [dict(x) for x in out.get("sources", [])]
    own = next((x for x in sources if x.get("source_format") == "address_record"), None)
    if own is None:
        sources.append(own := {"source_format": "address_record", "state": HOME_STATE, "rows_seen": 0, "rows_loaded": 0, "rows_skipped": 0, "input_paths": [manual_path]})
    own |= {key: int(own.get(key, 0)) + n for key in ("rows_seen", "rows_loaded")}
    out["sources"] = sources
    if "source_format" in out and "address_record" not in str(out["source_format"]).split("+"):
        out["source_format"] = f"{out['source_format']}+address_record"
    out["input_paths"] = [*out.get("input_paths", []), *([manual_path] if manual_path not in out.get("input_paths", []) else [])]
    return out


def with_lines(resolved: DataFrame, ref: DataFrame, key: str, top: int = 5) -> DataFrame:
    """Adds ``candidates``: the first top candidates with their canonical lines, in order. ``key`` names a row."""
    one = resolved.select(key, F.posexplode(F.slice("top_candidates", 1, top)).alias("k", "c")).select(key, "k", "c.reference_id", "c.score")
    lines = ref.select(F.col("address_id").alias("reference_id"), "canonical_address")
    listed = one.join(lines, "reference_id", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "reference_id", "score", F.coalesce("canonical_address", F.lit("")).alias("canonical_address")))).alias("_c"))
    shape = lambda c: F.struct(c.reference_id.alias("reference_id"), c.score.alias("score"), c.canonical_address.alias("canonical_address"))
    empty = F.array().cast("array<struct<reference_id:string,score:double,canonical_address:string>>")
    return resolved.join(listed, key, "left").withColumn("candidates", F.coalesce(F.transform("_c", shape), empty)).drop("_c")


def report(resolved: DataFrame, ref: DataFrame) -> DataFrame:
    """The fifteen text columns of a batch report, for rows with source_row, source_id and query_address."""
    full = with_lines(resolved, ref, "source_row", 3)
    line = lambda i: F.coalesce(F.get("candidates", F.lit(i)).canonical_address, F.lit(""))
    score = lambda i: F.when(F.size("candidates") > i, F.format_string("%.4f", F.get("candidates", F.lit(i)).score)).otherwise("")
    values = [
        F.col("source_row").cast("string"), s("source_id"), s("query_address"), s("standardized_query_address"), s("predicted_canonical_address"), F.format_string("%.4f", F.coalesce("confidence", F.lit(0.0))),
        F.when(F.col("needs_review"), "yes").otherwise("no"), s("predicted_match_id"), s("stage"), *(x for i in range(3) for x in (line(i), score(i))),
    ]
    return full.select(F.col("source_row").alias("_row"), *(v.alias(n) for v, n in zip(values, REPORT))).orderBy("_row").drop("_row")


def report_name(upload: str) -> str:
    stem = re.sub(r"[^A-Za-z0-9_.-]+", "_", PurePath(upload).stem or "addresses").strip("._")
    return f"{stem or 'addresses'}_resolved.xlsx"


def answers(resolved: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """key, answer: each resolution as the service's JSON, with the summaries of its stages where the rows have them."""
    summary = lambda p: F.struct(*(F.col(f"{p}.{a}").alias(b) for a, b in _SUMMARY.items()))
    full = with_lines(resolved, ref, key)
    more = [summary(p).alias(p) for p in ("stage1", "stage2") if p in resolved.columns]
    fields = [F.col("query_address").alias("input_address"), *(F.col(a).alias(b) for a, b in _SUMMARY.items()), F.col("candidates").alias("top_candidates"), *more]
    return full.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("answer"))


_SUMMARY = {
    "standardized_query_address": "standardized_address", "predicted_match_id": "predicted_match_id", "predicted_canonical_address": "predicted_canonical_address",
    "confidence": "confidence", "needs_review": "needs_review", "stage": "stage",
}


def health(ref: DataFrame, model, overrides: DataFrame | None = None, log: DataFrame | None = None, **more) -> dict:
    return {
        "reference_count": ref.count(), "accept_threshold": model.accept, "review_threshold": model.review, "feedback_override_count": overrides.count() if overrides is not None else 0,
        "feedback_row_count": log.count() if log is not None else 0, **more,
    }


def feedback_rows(said: DataFrame, resolved: DataFrame, added: DataFrame | None, created_at: str) -> DataFrame:
    """Rows of the feedback log from (row_ord, query_address, feedback_type, correct_address), the answers given, and what ``add_verified`` made of the corrections."""
    kinds = ("correct", "wrong", "correction")
    if said.where(~F.col("feedback_type").isin(*kinds) | ((F.col("feedback_type") == "correction") & (s("correct_address") == ""))).limit(1).count():
        raise ValueError("feedback is correct, wrong or a correction with its address")
    given = resolved.select("row_ord", "standardized_query_address", "predicted_match_id", "predicted_canonical_address", "confidence", "stage", F.to_json("top_candidates").alias("top_candidates"))
    found = said.join(given, "row_ord")
    if added is not None:
        found = found.join(added.select("row_ord", F.col("address_id").alias("correct_reference_id"), F.col("canonical_address").alias("correct_canonical_address")), "row_ord", "left")
    else:
        found = found.withColumns({"correct_reference_id": F.lit(""), "correct_canonical_address": F.lit("")})
    return found.select(
        "row_ord", F.lit(created_at).alias("created_at"), "feedback_type", F.col("query_address").alias("input_address"), F.col("standardized_query_address").alias("standardized_address"), "predicted_match_id",
        "predicted_canonical_address", F.format_string("%.4f", "confidence").alias("confidence"), "stage", s("correct_address").alias("correct_address"), s("correct_reference_id").alias("correct_reference_id"),
        s("correct_canonical_address").alias("correct_canonical_address"), "top_candidates",
    )

