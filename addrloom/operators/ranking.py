"""Stage 2: weighted blocking, candidate scores, features, linear rank, accept tree and decision.

Joins, sums and decisions are DataFrame plans; only string similarities leave
the JVM, in Arrow batches over the pairs that blocking has kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import similarities
from ..functions.vocab import ACCEPT_INPUTS, FEATURES, PARTS
from ..storage import merged
from . import blocking

BASE_LIMIT, MOST_LIMIT, LEAST_POOL = 28, 40, 240
AMBIGUOUS = 0.01


@dataclass
class Model:
    """Weights by feature, accept tree (nodes: leaf, probability or feature_idx, threshold, left, right), thresholds."""

    weights: list[float]
    tree: dict | None = None
    accept: float = 0.5
    review: float = 0.9
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.weights) > len(FEATURES):
            raise ValueError(f"{len(self.weights)} weights for {len(FEATURES)} features")
        self.weights = [*map(float, self.weights), *[0.0] * (len(FEATURES) - len(self.weights))]  # older models lack the last ones

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        m = d["model"]
        return cls(m["weights"], m.get("accept_tree") or None, float(d["accept_threshold"]), float(d["review_threshold"]), d.get("metadata", {}))

    def to_json(self) -> str:
        model = {"weights": self.weights, "accept_tree": self.tree, "training_metadata": self.metadata.get("stage2_training", {})}
        return json.dumps({"model": model, "accept_threshold": self.accept, "review_threshold": self.review, "metadata": self.metadata}, indent=2)


def candidate_limit(base: int = BASE_LIMIT) -> Column:
    """Of a row with the parts of the original reading: more for every missing part, 40 at most."""
    missing = sum(((F.col(c) == "").cast("int") for c in ("house_number", "street_name", "city", "state", "zip_code")), F.lit(0))
    more = F.when(F.col("zip_code") == "", 4).otherwise(0) + F.when((F.col("city") == "") | (F.col("house_number") == ""), 2).otherwise(0)
    return F.least(F.lit(base) + 4 * missing + more, F.lit(MOST_LIMIT))


def blocked(variants: DataFrame, ref: DataFrame, base: int = BASE_LIMIT, most: int | None = None) -> DataFrame:
    """raw, address_id, block_score, ref_ord, k, pool (rank): the best ``max(8k, 240)`` rows of each text by summed weights, of these the first ``most``."""
    signed = variants.withColumn("signature", _joined("predir", "street_name", "street_type", "suffixdir"))
    return blocking.best(signed, ref, candidate_limit(base), LEAST_POOL, 8, most)


def _joined(*names: str) -> Column:
    return F.concat_ws(" ", *(F.nullif(F.col(n), F.lit("")) for n in names))


def _similar(full: bool) -> Column:
    """Similarities of a variant's parts and a row's (r_...); ``full`` adds those of the features."""
    own = lambda n: F.col(n)
    row = lambda n: F.col(f"r_{n}")
    wanted = {
        "street": (own("street_name"), row("street_name"), ("ratio", "blended", "phonetic")), "sig": (own("signature"), row("signature"), ("ratio", "overlap", "phonetic")),
        "city": (own("city"), row("city"), ("blended", "ratio", "phonetic") if full else ("blended",)), "house": (own("house_number"), row("house_number"), ("numeric",)),
    }
    if full:
        wanted["full"] = (own("standardized"), row("standardized_address"), ("ratio",))
    return similarities(wanted)


def _same(name: str) -> Column:
    return F.col(name) == F.col(f"r_{name}")


def _given(name: str) -> Column:
    return (F.col(name) != "") & _same(name)


def _zip3() -> Column:
    three = F.substring("zip_code", 1, 3)
    return (three != "") & (three == F.substring("r_zip_code", 1, 3))


def _one(c: Column) -> Column:
    return c.cast("double")


def _sim(name: str) -> Column:
    return F.col(f"sim.{name}")


def _at(city: str, state: str) -> Column:
    return F.concat_ws("\t", city, state)


#: What formulas ask of a pair, as columns; ``pairs.Pairs`` answers the same as arrays. ``own_places`` are those of the variant's zip, ``r_places`` those of the row's.
COLUMNS = SimpleNamespace(
    sim=_sim, same=_same, given=_given, zip3=_zip3, one=_one, blank=lambda name: F.col(name) == "", r_blank=lambda name: F.col(f"r_{name}") == "", row=lambda name: F.col(f"r_{name}"),
    greatest=F.greatest, least=F.least, pick=lambda when, then, other: F.when(when, then).otherwise(other), lit=F.lit, const=F.lit, reread=lambda: F.col("reason") != "original",
    placed=lambda: F.col("own_places").isNotNull(), in_own=lambda: F.array_contains("own_places", _at("r_city", "r_state")), in_theirs=lambda: F.coalesce(F.array_contains("r_places", _at("city", "state")), F.lit(False)),
)


def rough_score(x=COLUMNS) -> Column:
    """Of a variant and a row with their similarities ``sim``."""
    return (
        0.28 * x.sim("house_numeric") + 0.24 * x.sim("street_blended") + 0.14 * x.sim("sig_overlap") + 0.12 * x.sim("city_blended")
        + 0.10 * x.one(x.given("zip_code")) + 0.06 * x.one(x.zip3()) + 0.06 * x.one(x.given("state"))
    )


def generation_score(x=COLUMNS) -> Column:
    """The rough score, raised on strong street and place evidence and held down where the street doesn't fit."""
    rough, city, state, zip_exact, zip3, house = rough_score(x), x.sim("city_blended"), x.one(x.given("state")), x.one(x.given("zip_code")), x.one(x.zip3()), x.sim("house_numeric")
    text = x.greatest(x.sim("street_blended"), x.sim("street_ratio"), x.sim("sig_ratio"), x.sim("sig_overlap"))
    street = x.greatest(text, 0.90 * x.sim("street_phonetic"), 0.90 * x.sim("sig_phonetic"))
    place = x.greatest(city, state, zip_exact, zip3)
    strong = 0.34 + 0.30 * street + 0.10 * city + 0.05 * state + 0.05 * zip_exact + 0.04 * zip3 + 0.08 * house
    weak = 0.22 + 0.35 * text + 0.08 * place + 0.10 * house
    held = x.pick((place >= 0.86) & ~x.blank("house_number"), x.least(rough, weak), rough)
    raised = x.pick((place >= 0.86) & (street >= 0.66) & (text >= 0.58), x.greatest(rough, strong), held)
    return x.pick(x.blank("street_name"), rough, raised)


def feature_values(x=COLUMNS) -> dict[str, Column]:
    """The features of a variant and a row, by name."""
    street = x.greatest(x.sim("street_ratio"), 0.95 * x.sim("sig_ratio"))
    sound = x.greatest(x.sim("street_phonetic"), x.sim("sig_phonetic"))
    city, house = x.sim("city_ratio"), x.sim("house_numeric")
    other = x.pick(~x.r_blank("zip_code") & ~x.blank("city") & ~x.blank("state"), x.one(x.in_theirs()), 0.5)
    houses = ~x.blank("house_number") & ~x.r_blank("house_number") & ~x.same("house_number")
    apart = houses & (x.greatest(street, sound) >= 0.88) & ((city >= 0.86) | x.given("zip_code"))
    found = {
        "bias": x.const(1.0), "full_similarity": x.sim("full_ratio"), "street_name_similarity": street, "street_signature_overlap": x.sim("sig_overlap"), "city_similarity": city, "house_similarity": house,
        "zip_exact": x.given("zip_code"), "zip_prefix": x.zip3(), "type_exact": x.given("street_type"), "type_missing": x.blank("street_type"), "predir_exact": x.same("predir"), "suffixdir_exact": x.same("suffixdir"),
        "unit_exact": x.given("unit_type") & x.same("unit_value"), "unit_missing": x.blank("unit_type") & x.blank("unit_value"), "state_exact": x.given("state"), "city_state_exact": (city == 1.0) & x.given("state"),
        "house_exact": x.given("house_number"), "street_exact": x.given("street_name"), "locality_corrected": x.reread(), "missing_city": x.blank("city"), "missing_state": x.blank("state"), "missing_zip": x.blank("zip_code"),
        "rough": rough_score(x), "street_phonetic_similarity": sound, "city_phonetic_similarity": x.sim("city_phonetic"), "zip_city_consistency": x.pick(x.placed(), x.one(x.in_own()), other), "house_mismatch_strong_context": apart, "source_quality": x.row("source_quality"),
    }
    return {n: x.one(found[n]) for n in FEATURES}


def variant_order(v, x=COLUMNS) -> Column:
    """How well a variant fits the row; ``v`` gives its features by name."""
    return (
        v("full_similarity") + x.greatest(v("street_name_similarity"), 0.92 * v("street_phonetic_similarity")) + v("house_similarity")
        + 0.5 * x.greatest(v("city_similarity"), 0.9 * v("city_phonetic_similarity")) - 0.2 * v("house_mismatch_strong_context")
    )


_ROW = ("standardized_address", "signature", "source_quality", *PARTS)


def stage2_variants(read: DataFrame) -> DataFrame:
    """raw, variant, reason, parts and signature of the stage-2 readings."""
    one = read.select("raw", F.posexplode("stage2").alias("variant", "_v")).select("raw", "variant", "_v.*")
    return one.withColumn("signature", _joined("predir", "street_name", "street_type", "suffixdir"))


def _rows(ref: DataFrame, names=_ROW) -> DataFrame:
    return ref.select("address_id", *(F.col(c).alias(f"r_{c}") for c in names))


def zip_places(ref: DataFrame) -> DataFrame:
    """zip_code, places: its distinct 'city, tab, state'."""
    return ref.where("zip_code != ''").select("zip_code", F.concat_ws("\t", "city", "state").alias("p")).distinct().groupBy("zip_code").agg(F.array_sort(F.collect_list("p")).alias("places"))


def candidates(read: DataFrame, ref: DataFrame, base: int = BASE_LIMIT, keep=lambda df: df) -> DataFrame:
    """raw, address_id, cand_ord: the k best rows of each text's pool by generation score, then block score.

    Texts whose keys hit nothing but that have a street meet the whole table, as
    blocks of it; such texts are rare, and only their own scores are kept.
    """
    variants = keep(stage2_variants(read))
    pool = keep(blocking.scored(variants, ref, candidate_limit(base), LEAST_POOL, 8, generation_score))
    names = ("raw", "address_id", "cand_ord", F.col("score").alias("generation_score"), "block_score")
    return pool.select(*names).unionByName(_of_whole_table(keep(_lost(variants, pool)), variants, ref, base).select(*names))


def _lost(variants: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with a street that have no row."""
    return merged(variants.where("street_name != ''").select("raw").distinct(), found.select("raw").distinct(), "raw", "left_anti")


def _of_whole_table(lost: DataFrame, variants: DataFrame, ref: DataFrame, base: int) -> DataFrame:
    """raw, address_id, cand_ord, score, block_score: the k best rows of the whole table."""
    limits = variants.where("variant = 0").select("raw", candidate_limit(base).alias("k"))
    whole = lost.join(limits, "raw").join(ref.select("address_id", "ref_ord"), F.lit(True), "cross").select("raw", "address_id", "ref_ord", "k")
    needed = ("house_number", "street_name", "signature", "city", "state", "zip_code")
    pairs = whole.join(_rows(ref, needed), "address_id").join(variants.select("raw", *needed), "raw")
    each = pairs.withColumn("sim", _similar(False)).withColumn("score", generation_score())
    scored = each.groupBy("raw", "address_id").agg(F.max("score").alias("score"), *(F.first(c).alias(c) for c in ("ref_ord", "k")))
    w = Window.partitionBy("raw").orderBy(F.desc("score"), "ref_ord", "address_id")
    return scored.withColumn("cand_ord", F.row_number().over(w)).where("cand_ord <= k").withColumn("block_score", F.lit(0.0))


def pair_features(pairs: DataFrame, read: DataFrame, ref: DataFrame) -> DataFrame:
    """pairs (raw, address_id, ...) with every variant of the text: variant, its parts, the row's (r_...), sim and values (as FEATURES)."""
    zips = zip_places(ref)
    from ..functions.text import standardize

    variants = stage2_variants(read).withColumn("standardized", standardize()).join(zips.withColumnRenamed("places", "own_places"), "zip_code", "left")
    rows = _rows(ref).join(zips.select(F.col("zip_code").alias("r_zip_code"), F.col("places").alias("r_places")), "r_zip_code", "left")
    each = pairs.join(rows, "address_id").join(variants, "raw").withColumn("sim", _similar(True))
    return each.withColumn("values", F.array(*feature_values().values()))


def features(pairs: DataFrame, read: DataFrame, ref: DataFrame) -> DataFrame:
    """pairs with reason, standardized, has_house, has_street, values (as FEATURES) of the variant that fits the row best, and original_rough."""
    each = pair_features(pairs, read, ref)
    key = F.struct(variant_order(value).alias("o"), value("rough").alias("r"), (-F.col("variant")).alias("v"))
    told = F.struct("reason", "standardized", (F.col("house_number") != "").alias("has_house"), (F.col("street_name") != "").alias("has_street"), "values")
    others = [c for c in pairs.columns if c not in ("raw", "address_id")]
    best = each.groupBy("raw", "address_id").agg(*(F.first(c).alias(c) for c in others), F.max_by(told, key).alias("_best"), F.max(F.when(F.col("variant") == 0, value("rough"))).alias("original_rough"))
    return best.select(*pairs.columns, "_best.*", "original_rough")


def value(name: str) -> Column:
    return F.col("values")[FEATURES.index(name)]


def linear_score(weights: list[float]) -> Column:
    return F.expr(" + ".join(f"values[{i}] * {w!r}D" for i, w in enumerate(weights)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def _text(x=COLUMNS, value=value) -> Column:
    return x.greatest(value("street_name_similarity"), value("street_signature_overlap"))


def _evidence(x=COLUMNS, value=value) -> Column:
    return x.greatest(_text(x, value), 0.90 * value("street_phonetic_similarity"))


def _place(x=COLUMNS, value=value) -> Column:
    return x.greatest(*map(value, ("city_similarity", "zip_exact", "zip_prefix", "state_exact", "city_state_exact")))


def rank_score(weights: list[float]) -> Column:
    """Probability, floored on strong street and locality evidence and capped on weak street evidence."""
    return _bounded(sigmoid(linear_score(weights)), F.col("has_street"))


def _bounded(p: Column, has_street: Column, x=COLUMNS, value=value) -> Column:
    text, street, place = _text(x, value), _evidence(x, value), _place(x, value)
    floor = 0.42 * street + 0.18 * value("city_similarity") + 0.08 * value("state_exact") + 0.08 * value("zip_city_consistency") + 0.08 * value("source_quality") + 0.12 * value("house_similarity") + 0.04 * value("type_exact")
    cap = 0.20 + 0.30 * text + 0.08 * place + 0.12 * value("house_similarity")
    strong, weak = (place >= 0.86) & (street >= 0.66) & (text >= 0.58), (place >= 0.86) & (text < 0.58)
    adjusted = x.pick(strong, x.greatest(p, x.least(x.lit(0.93), floor)), x.pick(weak, x.least(p, cap), p))
    return x.pick(has_street, x.greatest(x.lit(0.0), x.least(x.lit(1.0), adjusted)), p)


#: Ranks are Spark's; a row whose score in numpy is at most this much below the last wanted one goes to Spark too.
NEAR = 1e-9
_NEAR = {"raw": "object", "address_id": "object", "cand_ord": "int64", "n_ranked": "int64", "reason": "object", "standardized": "object", "has_house": "bool", "has_street": "bool", "values": "object"}


def _nearest(group: blocking.Group, weights: list[float], top: int):
    """Of each text's candidates those that may be among the ``top`` first, with the features of the variant that fits best."""
    ids, reason, line, variant = group.rows["address_id"].to_numpy(), *(group.texts[c].to_numpy() for c in ("reason", "standardized", "variant"))
    for text, at, _, _, cand_ord in group.chosen(LEAST_POOL, 8, generation_score):
        x, first = group.meet(text, at)
        each = feature_values(x)
        own = np.repeat(np.arange(len(text)), group.readings[text])
        best = np.lexsort((variant[x.i], -each["rough"], -variant_order(each.__getitem__, x), own))[first]
        of = {n: c[best] for n, c in each.items()}
        house, street = (~x.blank(n)[best] for n in ("house_number", "street_name"))
        total = sum((of[n] * w for n, w in zip(FEATURES[1:], weights[1:])), of[FEATURES[0]] * weights[0])
        score = _bounded(1.0 / (1.0 + np.exp(-total)), street, x, of.__getitem__)
        order = np.lexsort((cand_ord, -score, text))
        last = np.full(len(group.raws), -np.inf)
        rank = blocking.places(text[order])
        last[text[order[rank == top]]] = score[order[rank == top]]
        n = np.bincount(text, minlength=len(group.raws))
        kept = np.flatnonzero(score >= last[text] - NEAR)
        values, t, reading = np.stack([of[f][kept] for f in FEATURES], axis=1), text[kept], x.i[best[kept]]
        yield pd.DataFrame({
            "raw": group.raws[t], "address_id": ids[at[kept]], "cand_ord": cand_ord[kept], "n_ranked": n[t], "reason": reason[reading], "standardized": line[reading],
            "has_house": house[kept], "has_street": street[kept], "values": list(values),
        })


def first_ranks(read: DataFrame, ref: DataFrame, weights: list[float], top: int = 5, base: int = BASE_LIMIT, keep=lambda df: df) -> DataFrame:
    """Of the candidates, ranked among all of their text, those that ``decide`` looks at: the ``top`` first and what comes close.

    Candidates, features and near ranks are found where the pools are; only
    texts whose keys hit nothing go through the plan.
    """
    from ..functions.text import standardize

    zips = zip_places(ref)
    variants = keep(stage2_variants(read).withColumn("standardized", standardize()).join(zips, "zip_code", "left"))
    rows = ref.select("address_id", "ref_ord", "signature", "source_quality", F.col("standardized_address").alias("standardized"), *PARTS).join(zips, "zip_code", "left")
    schema = "raw string, address_id string, cand_ord int, n_ranked long, reason string, standardized string, has_house boolean, has_street boolean, values array<double>"
    common = (*PARTS, "signature", "standardized")
    near = keep(blocking.chosen(variants, rows, candidate_limit(base), common, lambda group: _nearest(group, weights, max(2, top)), _NEAR, schema, ("reason", "places")))
    lost = keep(_lost(variants, near))
    if not lost.isEmpty():
        found = keep(_of_whole_table(lost, variants, ref, base).select("raw", "address_id", "cand_ord"))
        count = F.count(F.lit(1)).over(Window.partitionBy("raw"))
        near = near.unionByName(features(found, read, ref).withColumn("n_ranked", count).select(*near.columns))
    return ranked(near, weights)


def ranked(featured: DataFrame, weights: list[float]) -> DataFrame:
    """Adds rank_score, rank (from 1), margin to the next, and n_ranked if it isn't there."""
    w = Window.partitionBy("raw").orderBy(F.desc("rank_score"), "cand_ord")
    scored = featured.withColumn("rank_score", rank_score(weights))
    counted = {} if "n_ranked" in featured.columns else {"n_ranked": F.count(F.lit(1)).over(Window.partitionBy("raw"))}
    return scored.withColumns({"rank": F.row_number().over(w), "margin": F.col("rank_score") - F.coalesce(F.lead("rank_score").over(w), F.lit(0.0)), **counted})


def accept_inputs() -> list[Column]:
    named = {"best_score": F.col("rank_score"), "margin": F.greatest(F.lit(0.0), F.col("margin"))}
    return [named[n] if n in named else value(n) for n in ACCEPT_INPUTS]


def tree_probability(tree: dict, inputs: list[Column]) -> Column:
    if tree.get("leaf"):
        return F.lit(float(tree["probability"]))
    below = inputs[int(tree["feature_idx"])] <= float(tree["threshold"])
    return F.when(below, tree_probability(tree["left"], inputs)).otherwise(tree_probability(tree["right"], inputs))


#: Weights of the decision where a model has no tree.
PLAIN_DECISION = {
    "rough": 0.34, "full_similarity": 0.15, "street_name_similarity": 0.12, "street_signature_overlap": 0.08, "house_similarity": 0.11, "city_similarity": 0.07,
    "zip_exact": 0.04, "zip_prefix": 0.02, "state_exact": 0.03, "city_state_exact": 0.02, "street_phonetic_similarity": 0.04, "city_phonetic_similarity": 0.02,
    "zip_city_consistency": 0.03, "source_quality": 0.02, "house_mismatch_strong_context": -0.12,
}


def decision_score(tree: dict | None) -> Column:
    if tree:
        return tree_probability(tree, accept_inputs())
    total = sum((w * value(n) for n, w in PLAIN_DECISION.items()), 0.01 * F.col("rank_score") + 0.01 * F.greatest(F.lit(0.0), F.col("margin")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def guarded(score: Column) -> Column:
    """At most .39 for another house on a fitting street, or the house on another street."""
    place = _place() >= 0.86
    other_house = F.col("has_house") & (value("house_similarity") < 0.45) & (_evidence() >= 0.66) & place
    other_street = F.col("has_street") & (value("house_exact") > 0) & (_text() < 0.55) & place
    return F.when(other_house | other_street, F.least(score, F.lit(0.39))).otherwise(score)


def exact_match() -> Column:
    return (value("house_exact") > 0) & (value("street_exact") > 0) & ((value("city_state_exact") > 0) | (value("zip_exact") > 0)) & (value("zip_city_consistency") >= 0.5)


def decide(ranks: DataFrame, read: DataFrame, model: Model, top: int = 5) -> DataFrame:
    """raw, predicted_match_id, standardized_query_address, confidence, needs_review, stage, top_candidates for every text."""
    listed = ranks.where(F.col("rank") <= top).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("rank", "address_id", "rank_score"))).alias("_t"))
    best = ranks.where("rank = 1").withColumn("score", guarded(decision_score(model.tree)))
    taken = F.col("score") >= model.accept
    unsure = taken & (F.col("n_ranked") > 1) & (F.col("margin") < AMBIGUOUS) & ~exact_match()
    against = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("score")))
    made = merged(best.select(
        "raw", F.when(taken & ~unsure, F.col("address_id")).otherwise("").alias("predicted_match_id"), F.col("standardized").alias("_standard"),
        F.when(taken, F.col("score")).otherwise(against).alias("confidence"),
        F.when(unsure, True).when(taken, F.col("score") < model.review).otherwise(against < model.review).alias("needs_review"),
        F.when(unsure, "stage2_ambiguous_margin").when(taken, F.concat(F.lit("stage2_model_"), "reason")).otherwise("stage2_no_match").alias("stage"),
    ), listed, "raw")
    own = read.select("raw", F.concat_ws("", F.lit("")).alias("_x"), F.col("parts").alias("p")).withColumn("_own", _standard_of("p"))
    empty = F.array().cast("array<struct<reference_id:string,score:double>>")
    return merged(own, made, "raw", "left").select(
        "raw", F.coalesce("predicted_match_id", F.lit("")).alias("predicted_match_id"), F.coalesce("_standard", "_own").alias("standardized_query_address"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce("stage", F.lit("stage2_no_candidates")).alias("stage"),
        F.coalesce(F.transform("_t", lambda t: F.struct(t.address_id.alias("reference_id"), t.rank_score.alias("score"))), empty).alias("top_candidates"),
    )


def _standard_of(struct: str) -> Column:
    from ..functions.text import standardize

    return standardize(lambda p: F.col(f"{struct}.{p}"))


def combine(stage1: DataFrame, stage2: DataFrame, on: str = "raw") -> DataFrame:
    """Stage 1 unless it is empty, unsure where stage 2 is sure, or less sure of the same row."""
    fields = ("predicted_match_id", "standardized_query_address", "confidence", "needs_review", "stage", "top_candidates")
    own = F.array(F.struct(F.col("predicted_match_id").alias("reference_id"), F.col("confidence").alias("score")))
    one = stage1.withColumn("top_candidates", F.when(F.col("predicted_match_id") != "", own).otherwise(F.array().cast("array<struct<reference_id:string,score:double>>")))
    pair = merged(one.select(on, F.struct(*fields).alias("a")), stage2.select(on, F.struct(*fields).alias("b")), on)
    second = (
        F.when(F.col("a.predicted_match_id") == "", True).when(F.col("b.predicted_match_id") == "", False)
        .when((F.col("a.predicted_match_id") == F.col("b.predicted_match_id")) & (F.col("b.confidence") > F.col("a.confidence")), True)
        .otherwise(F.col("a.needs_review") & ~F.col("b.needs_review") & (F.col("b.confidence") >= F.col("a.confidence")))
    )
    return pair.select(on, F.when(second, F.col("b")).otherwise(F.col("a")).alias("_r")).select(on, "_r.*")
