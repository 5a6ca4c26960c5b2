"""Labelled noisy datasets from real records: samples, near-miss negatives, queries, checks and export."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import noise
from ..functions.similarity import similarities
from ..functions.text import query_key, canonical_line
from ..functions.vocab import PARTS
from ..storage import numbered, stored


@F.pandas_udf(T.StringType())
def stable_split(keys: pd.Series) -> pd.Series:
    """train (70%), validation (15%) or test by a hash of the key: the same on any partitioning."""

    def split(key: str) -> str:
        x = int.from_bytes(hashlib.blake2b((key or "").encode(), digest_size=8).digest(), "big") / 2.0**64
        return "train" if x < 0.70 else "validation" if x < 0.85 else "test"

    return pd.Series([split(k) for k in keys])


def shuffled(pool: DataFrame, seed: int) -> DataFrame:
    """The first record of each canonical line, with a seeded order that doesn't depend on partitions."""
    keyed = pool.withColumn("canonical_address", canonical_line())
    order = F.xxhash64(F.lit(seed), "canonical_address", "address_id")
    w = Window.partitionBy("canonical_address").orderBy(order, "address_id")
    return keyed.withColumns({"_n": F.row_number().over(w), "_order": order}).where("_n = 1").drop("_n")


def take(pool: DataFrame, n: int, prefix: str, exclude: DataFrame | None = None) -> DataFrame:
    """The first n records of a shuffled pool that aren't excluded, as PREFIX_000001...; too few are an error."""
    free = pool if exclude is None else pool.join(exclude.select("canonical_address"), "canonical_address", "left_anti")
    first = free.orderBy("_order", "address_id").limit(n)
    named = numbered(first, ["_order", "address_id"], "_k").withColumn("address_id", F.format_string(f"{prefix}_%06d", F.col("_k"))).drop("_k")
    if n and named.count() < n:
        raise ValueError(f"fewer than {n} unused records for {prefix}")
    return named


_STREET = ("predir", "street_name", "street_type", "suffixdir")
#: reason -> key columns; pairs of a key with an empty column don't count.
NEIGHBOURS = {
    "same_house_city": ("house_number", "city", "state"), "same_street_city": (*_STREET, "city", "state"),
    "same_house_zip": ("house_number", "zip_code"), "same_street_zip": (*_STREET, "zip_code"),
}


def neighbours(candidates: DataFrame, reference: DataFrame, strict: bool = True) -> DataFrame:
    """canonical_address, reason, n_ (the neighbour's parts): one row per pair, first reason first.

    ``strict`` asks for every part of a street key, directions included. A pair is
    dropped where it meets if an earlier key joins it too, so that pairs are never
    shuffled; only those of repeated lines or ids are compared with one another.
    """
    names = {c: f"n_{c}" for c in PARTS}
    right = reference.select(F.col("address_id").alias("n_id"), *(F.col(c).alias(n) for c, n in names.items()))
    once, many = _by_count(candidates, "canonical_address")
    r_once, r_many = _by_count(right, "n_id")

    def met(own: DataFrame, other: DataFrame) -> DataFrame:
        out, before = None, F.lit(False)
        for i, (reason, key) in enumerate(NEIGHBOURS.items()):
            given = F.lit(True)
            for c in key if strict else [c for c in key if c not in ("predir", "suffixdir", "street_type")]:
                given = given & (F.col(c) != "")
            same = F.lit(True)
            for c in key:
                same = same & (F.col(c) == F.col(names[c]))
            pairs = own.where(given).join(other, same).where(~before).withColumns({"reason": F.lit(reason), "_r": F.lit(i)})
            out = pairs if out is None else out.unionByName(pairs)
            before = before | F.coalesce(given & same, F.lit(False))
        return out

    w = Window.partitionBy("canonical_address", "n_id").orderBy("_r")
    unsure = met(many, right).unionByName(met(once, r_many))
    return met(once, r_once).unionByName(unsure.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))


def _by_count(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key no other row has, and the rest."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return counted.where("_n = 1").drop("_n"), counted.where("_n > 1").drop("_n")


def neighbour_score(pairs: DataFrame) -> DataFrame:
    """Adds score: how easily the candidate is taken for its neighbour."""
    same = lambda *cs: F.expr(" AND ".join(f"{c} = n_{c}" for c in cs))
    city, zip_ = same("city", "state") & (F.col("n_city") != ""), same("zip_code") & (F.col("n_zip_code") != "")
    near, house, street = city | zip_, same("house_number"), same(*_STREET)
    gap = F.abs(F.expr("try_cast(house_number AS long) - try_cast(n_house_number AS long)"))
    gap = F.when(F.col("house_number").rlike(r"^\d+$") & F.col("n_house_number").rlike(r"^\d+$"), gap).otherwise(F.lit(999))
    like, by_house = F.col("_like"), F.col("reason").isin("same_house_city", "same_house_zip")
    zero = F.lit(0.0)
    score = F.greatest(
        F.when(house & near, 0.68 + 0.25 * like).otherwise(zero), F.when(street & near & gap.between(1, 20), 0.76 + 0.20 * (1 - F.least(gap, F.lit(20)) / 20)).otherwise(zero),
        F.when(by_house & (like >= 0.45), 0.55 + 0.35 * like).otherwise(zero), F.when(~by_house & gap.between(1, 30), 0.58 + 0.30 * (1 - F.least(gap, F.lit(30)) / 30)).otherwise(zero),
    )
    # pairs of a street key have one street: only the others are measured
    measured = similarities({"street": (F.upper("n_street_name"), F.upper("street_name"), ("ratio",))})
    likes = pairs.where(by_house).withColumn("_like", measured["street_ratio"]).unionByName(pairs.where(~by_house).withColumn("_like", F.lit(1.0)))
    return likes.withColumn("score", score).drop("_like")


def near_misses(pool: DataFrame, reference: DataFrame, n: int, exclude: DataFrame, strict: bool = True) -> DataFrame:
    """n records most like reference rows without being one; filled up with any unused ones (reason fallback_holdout)."""
    free = pool.join(exclude.select("canonical_address").unionByName(reference.select("canonical_address")).distinct(), "canonical_address", "left_anti")
    scored = neighbour_score(neighbours(free, reference, strict)).where("score > 0")
    best = scored.groupBy("canonical_address").agg(F.max_by("reason", F.struct("score", -F.col("_r"))).alias("reason"), F.max("score").alias("score"))
    near = free.join(best, "canonical_address").withColumn("reason", F.concat(F.lit("near_neighbor_"), "reason"))
    rest = free.join(best, "canonical_address", "left_anti").withColumns({"reason": F.lit("fallback_holdout"), "score": F.lit(0.0)})
    top = near.unionByName(rest).orderBy(F.desc("score"), "_order", "address_id").limit(n)
    named = numbered(top, [F.desc("score"), "_order", "address_id"], "_k")
    return named.withColumn("address_id", F.format_string("NEG_ADV_%06d", F.col("_k"))).drop("_k", "score")


#: Chances of the difficulties of negatives.
_NEGATIVE = {"easy": 0.16, "medium": 0.44, "hard": 0.40}
#: Attempts at a text, some at a time: few rows need more than the first.
_ROUNDS = (4, 16, 20)


def cities_by_state(pool: DataFrame) -> DataFrame:
    """state, cities: the known cities of each state, sorted."""
    return pool.where("state != '' AND city != ''").groupBy("state").agg(F.array_sort(F.collect_set("city")).alias("cities"))


def variants(records: DataFrame, seed: int, plan: str, per: int = 1) -> DataFrame:
    """records x variants: variant, difficulty and _seed.

    ``plan`` is positive (difficulties planned over ``per`` variants), negative
    or hard. All draws are hashes of the record's id and the seed.
    """
    own = F.xxhash64(F.lit(seed), F.lit(plan), "address_id")
    if plan == "positive":
        wanted = noise.planned(own, per)
    elif plan == "negative":
        wanted = F.array(*(noise.drawn(noise.fraction(own, F.lit("level"), F.lit(i)), _NEGATIVE) for i in range(per)))
    else:
        wanted = F.array(*[F.lit("hard")] * per)
    each = records.select("*", F.posexplode(wanted).alias("variant", "difficulty"))
    return each.withColumn("_seed", F.xxhash64(own, "variant"))


def noisy(wanted: DataFrame, cities: DataFrame | None, attempts: range = range(1)) -> DataFrame:
    """Rows of ``variants`` with attempt, query_address and noise_tags, once an attempt."""
    known = wanted.withColumn("cities", F.lit(None).cast("array<string>")) if cities is None else wanted.join(cities, "state", "left")
    tried = known.withColumn("attempt", F.explode(F.array(*map(F.lit, attempts))))
    made = tried.withColumn("_state", noise.states(F.col("cities"), F.col("difficulty"), F.xxhash64("_seed", "attempt")))
    text, tags = noise.corrupted("_state")
    return made.withColumns({"query_address": text, "noise_tags": tags}).drop("cities", "_state")


def label_is_safe(made: DataFrame, reference: DataFrame, label: int) -> DataFrame:
    """Rows whose text names no reference row but the true one, and not two."""
    index = reference.select(query_key("canonical_address").alias("_key"), "address_id").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("address_id").alias("_named"))
    joined = made.withColumn("_key", query_key("query_address")).join(index, "_key", "left")
    ok = F.col("_n").isNull()
    return joined.where(ok | ((F.col("_n") == 1) & (F.col("_named") == F.col("address_id"))) if label else ok).drop("_key", "_n", "_named")


def labelled(wanted: DataFrame, cities: DataFrame | None, reference: DataFrame, label: int, rounds: tuple[int, ...] = _ROUNDS, keep=stored) -> DataFrame:
    """One text with a safe label for every row of ``variants``: the first of its attempts, 40 in all; rows without one are an error.

    Only rows that are still without a text go through the next round.
    """
    key, done, start = ["address_id", "variant"], [], 0
    left = wanted
    for n in rounds:
        made = label_is_safe(noisy(left, cities, range(start, start + n)), reference, label)
        best = made.groupBy(*key).agg(F.min_by(F.struct("query_address", "noise_tags"), "attempt").alias("_best"))
        done.append(keep(left.join(best, key).select(*left.columns, "_best.*")))
        left, start = keep(left.join(done[-1].select(*key), key, "left_anti")), start + n
        if left.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out.drop("_seed")
    raise ValueError(f"{left.count()} records got no text with a safe label in {start} attempts, such as {left.first().address_id}")


def build(pool: DataFrame, size: int, holdouts: int, adversarial: int, per: int = 3, seed: int = 4633) -> dict[str, DataFrame]:
    """reference, negatives, adversarial and queries of a pool (address_id and the ten parts)."""
    ready = stored(shuffled(pool, seed))
    cities = stored(cities_by_state(pool))
    reference = stored(take(ready, size, "REF"))
    negatives = stored(take(ready, holdouts, "NEG", reference))
    hard = stored(near_misses(ready, reference, adversarial, negatives))
    groups = ((reference, "positive", per, 1, "reference_variant"), (negatives, "negative", 1, 0, "holdout_no_match"), (hard, "hard", 1, 0, "adversarial_no_match"))
    queries = None
    for i, (records, plan, n, label, source) in enumerate(groups):
        safe = labelled(variants(records, seed, plan, n), cities, reference, label)
        tags = F.concat_ws("|", F.lit("adversarial_base"), "reason", "noise_tags") if plan == "hard" else F.col("noise_tags")
        own = safe.select(
            F.lit(i).alias("_g"), "address_id", "variant", stable_split("address_id").alias("split"), F.lit(label).alias("label"), F.when(F.lit(label == 1), F.col("address_id")).otherwise("").alias("true_match_id"),
            F.col("address_id").alias("base_address_id"), F.lit(source).alias("source"), "difficulty", tags.alias("noise_tags"), "query_address",
            F.when(F.lit(label == 1), F.col("canonical_address")).otherwise("NO_MATCH").alias("canonical_address"),
        )
        queries = own if queries is None else queries.unionByName(own)
    named = numbered(queries, ["_g", "address_id", "variant"], "_k").withColumn("query_id", F.format_string("Q_%07d", F.col("_k")))
    return {"reference": reference, "negatives": negatives, "adversarial": hard, "queries": named.drop("_k", "_g", "variant", "address_id")}


def problems(d: dict[str, DataFrame]) -> DataFrame:
    """check, violations: ids and lines unique and disjoint across the tables, safe labels, one split per base."""
    ids = None
    for name in ("reference", "negatives", "adversarial"):
        own = d[name].select(F.lit(name).alias("t"), "address_id", "canonical_address")
        ids = own if ids is None else ids.unionByName(own)
    twice = lambda c: ids.groupBy(c).count().where("count > 1")
    q = d["queries"].withColumn("_key", query_key("query_address"))
    named = d["reference"].select(query_key("canonical_address").alias("_key"), F.col("address_id").alias("_named"))
    wrong = q.join(named, "_key").where("label = 0 OR _named != true_match_id")
    splits = q.groupBy("base_address_id").agg(F.countDistinct("split").alias("n")).where("n > 1")
    checks = {"repeated_id": twice("address_id"), "repeated_line": twice("canonical_address"), "unsafe_label": wrong, "split_bases": splits, "repeated_query_id": q.groupBy("query_id").count().where("count > 1")}
    out = None
    for name, rows in checks.items():
        own = rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
        out = own if out is None else out.unionByName(own)
    return out


def summary(queries: DataFrame) -> DataFrame:
    """kind, key, n: counts by split and label, difficulty, source, both, and the fifteen commonest tags."""
    grouped = (
        queries.groupBy(F.lit("split_label").alias("kind"), F.concat_ws("|", "split", F.col("label").cast("string")).alias("key")).count()
        .unionByName(queries.groupBy(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("key")).count())
        .unionByName(queries.groupBy(F.lit("source").alias("kind"), F.col("source").alias("key")).count())
        .unionByName(queries.groupBy(F.lit("source_difficulty").alias("kind"), F.concat_ws("|", "source", "difficulty").alias("key")).count())
    )
    tags = queries.select(F.explode(F.split("noise_tags", r"\|")).alias("key")).groupBy(F.lit("tag").alias("kind"), "key").count().orderBy(F.desc("count"), "key").limit(15)
    return grouped.unionByName(tags).withColumnRenamed("count", "n")


def export(d: dict[str, DataFrame], path: str, config: dict | None = None) -> dict:
    """Five CSV tables and a metadata.json, through Spark's writers alone."""
    shape = ("address_id", *PARTS, "canonical_address")
    names = {"reference_addresses": d["reference"].select(*shape), "negative_addresses": d["negatives"].select(*shape), "adversarial_negative_addresses": d["adversarial"].select(*shape), "queries": d["queries"], "resolver_input": d["queries"].select("query_id", "split", "query_address")}
    for name, df in names.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    meta = {"config": config or {}, "rows": {n: df.count() for n, df in names.items()}, "summary": [r.asDict() for r in summary(d["queries"]).orderBy("kind", "key").collect()]}
    spark = d["queries"].sparkSession
    spark.createDataFrame([(json.dumps(meta, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def preview(queries: DataFrame, limit: int = 8) -> DataFrame:
    """The first queries: label, difficulty, noise_tags, text and its canonical line."""
    return queries.orderBy("query_id").limit(limit).select("query_id", "label", "difficulty", "noise_tags", "query_address", "canonical_address")
