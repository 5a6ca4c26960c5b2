"""Training of the ranker: hard negatives, pairwise hinge and logistic steps, accept tree, thresholds."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocab import FEATURES
from . import evaluate, ranking


def featured_candidates(queries: DataFrame, read: DataFrame, ref: DataFrame, base: int = 40, keep=lambda df: df) -> DataFrame:
    """query_id, label, is_true, address_id and features of each query's candidates, the true row always among them."""
    q = queries.select("query_id", "label", "true_match_id", F.col("query_address").alias("raw"))
    found = keep(ranking.candidates(read, ref, base, keep).select("raw", "address_id", "cand_ord"))
    forced = q.where("label = 1").join(ref.select("address_id"), F.col("true_match_id") == F.col("address_id")).select("raw", "address_id").distinct()
    extra = forced.join(found, ["raw", "address_id"], "left_anti").withColumn("cand_ord", F.lit(1_000_000))
    pairs = ranking.features(found.unionByName(extra), read, ref)
    return q.join(pairs, "raw").withColumn("is_true", (F.col("label") == 1) & (F.col("address_id") == F.col("true_match_id")))


def base_rows(featured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, calibration): the four negatives roughest in score for each positive; two with less weight to calibrate."""
    w = Window.partitionBy("query_id").orderBy(F.desc("original_rough"), "cand_ord", "address_id")
    negatives = featured.where("NOT is_true").withColumn("k", F.row_number().over(w)).where("k <= 4")
    positives = featured.where("is_true").select("query_id", F.col("values").alias("pos"))
    pairs = positives.join(negatives.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "values"))).alias("neg")), "query_id")
    pairs = pairs.select("query_id", "pos", F.transform("neg", lambda x: x["values"]).alias("neg"))
    with_true = positives.select("query_id")
    usable = negatives.where("k <= 2").where("label = 0").unionByName(negatives.where("k <= 2 AND label = 1").join(with_true, "query_id", "left_semi"))
    weight = F.when(F.col("label") == 1, 0.5).otherwise(0.35)
    calibration = positives.select("query_id", F.lit(0).alias("k"), F.col("pos").alias("values"), F.lit(1).alias("y"), F.lit(1.0).alias("weight")).unionByName(
        usable.select("query_id", "k", "values", F.lit(0).alias("y"), weight.alias("weight"))
    )
    return pairs, calibration


def mined_rows(featured: DataFrame, weights: list[float], limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs, calibration) from a first model's own errors: up to three competitive wrong rows of a positive query, twice if the true row isn't first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "cand_ord")
    scored = featured.withColumn("rank_score", ranking.rank_score(weights)).withColumn("rank", F.row_number().over(w))
    true = scored.where("is_true").select("query_id", F.col("rank").alias("true_rank"), F.col("rank_score").alias("true_score"), F.col("values").alias("pos"))
    wrong = scored.where(f"NOT is_true AND rank <= {limit}").join(true, "query_id")
    rival = (F.col("true_rank") != 1) | (F.col("rank_score") >= 0.40) | (F.col("true_score") - F.col("rank_score") < 0.20)
    taken = wrong.where("label = 1").where(rival).withColumn("k", F.row_number().over(w)).where("k <= 3")
    grouped = taken.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "values"))).alias("neg"), F.first("pos").alias("pos"), F.first("true_rank").alias("true_rank"))
    pairs = grouped.withColumn("_r", F.explode(F.sequence(F.lit(1), F.when(F.col("true_rank") != 1, 2).otherwise(1)))).select("query_id", "pos", F.transform("neg", lambda x: x["values"]).alias("neg"))
    no_match = scored.where("label = 0 AND rank <= 3 AND rank_score >= 0.35")
    calibration = taken.select("query_id", "k", "values", F.lit(0).alias("y"), F.lit(0.85).alias("weight")).unionByName(no_match.select("query_id", F.col("rank").alias("k"), "values", F.lit(0).alias("y"), F.lit(0.9).alias("weight")))
    return pairs, calibration


def _epochs(rows: list, epochs: int, rate: float, decay: float, seed: int):
    rows, rng = list(rows), random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(rows)
        for row in rows:
            yield rate, row
        rate *= decay


def fit_weights(pairs: list, calibration: list, pair_epochs: int = 10, epochs: int = 6) -> list[float]:
    """Hinge steps on (positive, negatives), then weighted logistic steps on (values, y, weight), in seeded order on the driver.

    The rows are a bounded training sample of 28 numbers each.
    """
    w, free = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    free[0] = 0.0  # the bias isn't shrunk
    for rate, (pos, negs) in _epochs(pairs, pair_epochs, 0.08, 0.92, 17):
        for neg in negs:
            apart = pos - neg
            if w @ apart < 0.35:
                w += rate * (apart - 1e-4 * w * free)
    positives = sum(y for _, y, _ in calibration)
    scale = (len(calibration) - positives) / positives if 0 < positives < len(calibration) else 1.0
    for rate, (x, y, weight) in _epochs(calibration, epochs, 0.04, 0.9, 29):
        error = (y - 1 / (1 + np.exp(-np.clip(w @ x, -700, 700)))) * weight * (scale if y else 1.0)
        w += rate * (error * x - 2e-4 * w * free)
    return w.tolist()


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 1 - p * p - (1 - p) * (1 - p)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 4, least: int = 30) -> dict:
    """Probability tree by Gini gain over about twelve thresholds a column."""
    leaf = {"leaf": True, "probability": float(y.mean()) if len(y) else 0.0, "count": int(len(y))}
    if depth == 0 or len(y) <= 2 * least or len(set(y.tolist())) < 2:
        return leaf
    best = None
    for i, column in enumerate(x.T):
        values = np.unique(column)
        step = max(1, len(values) // 12)
        for t in values[step::step]:
            low = column <= t
            n = int(low.sum())
            if t == values[-1] or n < least or len(y) - n < least:
                continue
            gain = _gini(y) - n / len(y) * _gini(y[low]) - (len(y) - n) / len(y) * _gini(y[~low])
            if best is None or gain > best[0]:
                best = gain, i, float(t), low
    if best is None or best[0] <= 0:
        return leaf
    _, i, t, low = best
    return {"leaf": False, "feature_idx": i, "threshold": t, "left": fit_tree(x[low], y[low], depth - 1, least), "right": fit_tree(x[~low], y[~low], depth - 1, least)}


def _pairs(df: DataFrame) -> list:
    return [(np.array(r.pos), [np.array(n) for n in r.neg]) for r in df.orderBy("query_id").collect()]


def _calibration(df: DataFrame) -> list:
    return [(np.array(r["values"]), r.y, r.weight) for r in df.orderBy("query_id", "k", "weight").collect()]


def fit(queries: DataFrame, read: DataFrame, ref: DataFrame, keep, most_queries: int = 100_000) -> ranking.Model:
    """Rows, weights, mining, weights again, tree and thresholds from at most ``most_queries`` labelled queries.

    The bound keeps the training sample, which the driver gathers, to some
    hundred megabytes; more queries are an error, to be sampled by the caller.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} training queries")
    featured = keep(featured_candidates(queries, read, ref, keep=keep))
    pairs, calibration = (f(x) for f, x in zip((_pairs, _calibration), base_rows(featured)))
    first = fit_weights(pairs, calibration)
    mined = [f(x) for f, x in zip((_pairs, _calibration), mined_rows(featured, first))]
    weights = fit_weights(pairs + mined[0], calibration + mined[1]) if any(mined) else first
    own = featured.where("cand_ord <= 40")
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "cand_ord")
    scored = own.withColumn("rank_score", ranking.rank_score(weights)).withColumns({"rank": F.row_number().over(w), "margin": F.col("rank_score") - F.coalesce(F.lead("rank_score").over(w), F.lit(0.0))})
    best = keep(scored.where("rank = 1").withColumn("x", F.array(*ranking.accept_inputs())))
    rows = best.select("query_id", "x", F.col("is_true").cast("int").alias("y")).orderBy("query_id").collect()
    tree = fit_tree(np.array([r.x for r in rows]), np.array([r.y for r in rows]), 4, 40) if rows else None
    model = ranking.Model(weights, tree, metadata={"stage2_training": {"pair_rows": len(pairs) + len(mined[0]), "calibration_rows": len(calibration) + len(mined[1]), "accept_rows": len(rows)}})
    decided = best.select("query_id", "label", "true_match_id", F.col("address_id").alias("candidate_id"), ranking.decision_score(tree).alias("score"))
    without = queries.join(decided.select("query_id"), "query_id", "left_anti").select("query_id", "label", "true_match_id", F.lit("").alias("candidate_id"), F.lit(0.0).alias("score"))
    top = evaluate.accept_threshold(decided.unionByName(without)).first()
    model.accept = top.threshold if top else 0.70
    return model
