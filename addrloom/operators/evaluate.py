"""Metrics of resolutions, threshold sweeps, impurity splits and the predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("accuracy", "top3_accuracy", "precision", "recall", "resolved_rate", "coverage", "accepted_accuracy")


def correct() -> Column:
    """Positive queries need their id, negative ones none."""
    return F.when(F.col("label") == 1, F.col("predicted_match_id") == F.col("true_match_id")).otherwise(F.col("predicted_match_id") == "")


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def metrics(resolved: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, top-3 accuracy, precision, recall and shares of rows with label, true_match_id and a resolution."""
    has_top = "top_candidates" in resolved.columns
    in_top = F.exists(F.slice("top_candidates", 1, 3), lambda c: c.reference_id == F.col("true_match_id")) if has_top else F.col("predicted_match_id") == F.col("true_match_id")
    n, predicted, positive, accepted = F.count(F.lit(1)), F.count_if(F.col("predicted_match_id") != ""), F.count_if(F.col("label") == 1), F.count_if(~F.col("needs_review"))
    true_positive = F.count_if((F.col("label") == 1) & (F.col("predicted_match_id") == F.col("true_match_id")))
    return resolved.groupBy(*(by or [])).agg(
        F.lit(name).alias("name"), _ratio(F.count_if(correct()), n).alias("accuracy"), _ratio(F.count_if((F.col("label") == 1) & in_top), positive).alias("top3_accuracy"),
        _ratio(true_positive, predicted).alias("precision"), _ratio(true_positive, positive).alias("recall"), predicted.alias("resolved_count"), (n - predicted).alias("unresolved_count"),
        _ratio(predicted, n).alias("resolved_rate"), _ratio(accepted, n).alias("coverage"), _ratio(F.count_if(~F.col("needs_review") & correct()), accepted).alias("accepted_accuracy"),
        _ratio(F.count_if(F.col("stage").startswith("stage1")), n).alias("stage1_share"), _ratio(F.count_if(~F.col("stage").startswith("stage1")), n).alias("stage2_share"),
    )


def deltas(challenger: DataFrame, baseline: DataFrame, name: str) -> DataFrame:
    """Differences of two one-row metric tables, and whether the challenger holds up."""
    a = challenger.select(*(F.col(m).alias(f"_a_{m}") for m in METRICS))
    b = baseline.select(*(F.col(m).alias(f"_b_{m}") for m in METRICS))
    up = lambda m: F.col(f"_a_{m}") >= F.col(f"_b_{m}")
    return a.crossJoin(b).select(
        F.lit(name).alias("name"), *(F.round(F.col(f"_a_{m}") - F.col(f"_b_{m}"), 4).alias(f"{m}_delta") for m in METRICS),
        *(up(m).alias(f"{m}_gte_baseline") for m in ("accuracy", "recall", "precision", "accepted_accuracy")), (up("accuracy") & up("recall")).alias("overall_better_or_equal"),
    )


def stage_variants(resolved: DataFrame) -> dict[str, DataFrame]:
    """Rows with stage1 and stage2 structs as three tables of resolutions: stage1, stage2, combined."""
    own = [c for c in resolved.columns if c in ("query_id", "label", "true_match_id", "split")]
    return {**{n: resolved.select(*own, f"{n}.*") for n in ("stage1", "stage2")}, "combined": resolved.drop("stage1", "stage2")}


def compare_variants(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of the two stages and of both combined, differences of the combined ones to each stage)."""
    found = {n: metrics(rows, n) for n, rows in stage_variants(resolved).items()}
    each = found["stage1"].unionByName(found["stage2"]).unionByName(found["combined"])
    return each, deltas(found["combined"], found["stage1"], "combined_vs_stage1").unionByName(deltas(found["combined"], found["stage2"], "combined_vs_stage2"))


def _sweep(rows: DataFrame, score: str, low: int, high: int) -> DataFrame:
    """rows against thresholds low/100..high/100 as a histogram: per threshold step the rows by the last step they reach."""
    step = F.least(F.lit(high), F.floor(F.col(score) * 100 + 1e-9)).cast("int")
    return rows.withColumn("step", F.greatest(F.lit(low - 1), step))


def accept_threshold(scored: DataFrame, low: int = 25, high: int = 97) -> DataFrame:
    """threshold, accuracy for rows (label, true_match_id, candidate_id, score): the lowest of the best thresholds first.

    Rows are counted once by the last threshold that they reach; the table of
    thresholds has a row a step.
    """
    hit = (F.col("label") == 1) & (F.col("candidate_id") == F.col("true_match_id"))
    none = (F.col("label") == 0) | ((F.col("label") == 1) & (F.col("true_match_id") == ""))
    bins = _sweep(scored, "score", low, high).groupBy("step").agg(F.count_if(hit).alias("hits"), F.count_if(none).alias("negatives"), F.count(F.lit(1)).alias("n"))
    steps = scored.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    total = bins.agg(F.sum("n").alias("total"))
    at = steps.join(bins, F.lit(True), "cross").groupBy("t").agg(F.sum(F.when(F.col("step") >= F.col("t"), F.col("hits")).otherwise(F.col("negatives"))).alias("right"))
    return at.crossJoin(total).select((F.col("t") / 100).alias("threshold"), (F.col("right") / F.col("total")).alias("accuracy")).orderBy(F.desc("accuracy"), "threshold")


def review_threshold(resolved: DataFrame, target: float = 0.97, low: int = 60, high: int = 99, default: float = 0.90) -> DataFrame:
    """threshold, coverage, accuracy: of thresholds that keep the accuracy the widest, lowest first; the default if none does."""
    bins = _sweep(resolved, "confidence", low, high).groupBy("step").agg(F.count_if(correct()).alias("right"), F.count(F.lit(1)).alias("n"))
    steps = resolved.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    total = bins.agg(F.sum("n").alias("total"))
    at = steps.join(bins, F.col("step") >= F.col("t")).groupBy("t").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    good = at.crossJoin(total).select((F.col("t") / 100).alias("threshold"), (F.col("n") / F.col("total")).alias("coverage"), (F.col("right") / F.col("n")).alias("accuracy")).where(F.col("accuracy") >= target)
    fallback = resolved.sparkSession.range(1).select(F.lit(default).alias("threshold"), F.lit(-1.0).alias("coverage"), F.lit(None).cast("double").alias("accuracy"))
    return good.unionByName(fallback).orderBy(F.desc("coverage"), "threshold").limit(1)


def gini(positives: Column, n: Column) -> Column:
    p = positives / n
    return F.when(n == 0, 0.0).otherwise(1 - p * p - (1 - p) * (1 - p))


def gini_splits(rows: DataFrame, value: str, label: str, bins: int = 12) -> DataFrame:
    """threshold, gain of splits at every (distinct / bins)-th distinct value, best first."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    w = Window.orderBy("v")
    run = counts.withColumns({"k": F.row_number().over(w) - 1, "ln": F.sum("n").over(w), "lp": F.sum("pos").over(w)})
    total = counts.agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"), F.count(F.lit(1)).alias("d"))
    at = run.crossJoin(total).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("d") / bins))).where((F.col("k") > 0) & (F.col("k") % F.col("step") == 0) & (F.col("k") < F.col("d") - 1))
    left, right = gini(F.col("lp"), F.col("ln")), gini(F.col("pos_all") - F.col("lp"), F.col("n_all") - F.col("ln"))
    split = F.col("ln") / F.col("n_all") * left + (F.col("n_all") - F.col("ln")) / F.col("n_all") * right
    return at.select(F.col("v").alias("threshold"), (gini(F.col("pos_all"), F.col("n_all")) - split).alias("gain"))


def predictions(resolved: DataFrame) -> DataFrame:
    """The thirteen text columns of a predictions file."""
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "NO_MATCH").otherwise(F.col(c)).alias(c)
    flag = lambda c: F.when(c, "True").otherwise("False")
    listed = F.array_join(F.transform("top_candidates", lambda c: F.concat(c.reference_id, F.lit(":"), F.format_string("%.3f", c.score))), "; ")
    return resolved.select(
        "query_id", "split", F.col("query_address").alias("input_address"), F.col("standardized_query_address").alias("standardized_address"), named("predicted_match_id"), named("predicted_canonical_address"),
        F.format_string("%.4f", "confidence").alias("confidence"), flag(F.col("needs_review")).alias("needs_review"), F.col("stage").alias("resolution_stage"), F.col("label").alias("true_label"),
        named("true_match_id"), flag(correct()).alias("correct"), listed.alias("top_candidates"),
    )


def write_predictions(resolved: DataFrame, path: str) -> None:
    predictions(resolved).write.option("header", True).mode("overwrite").csv(path)
