"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Features are words, punctuation marks and pairs of neighbours, hashed; a word
that repeats its neighbour gives one shared feature. A score is the sparse dot
product of root term frequencies and weights, through the logistic function.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, sampled_rows, stratified_sample

_TOKEN = re.compile(r"\w+|[^\w\s]")
_BLOCK = 1 << 20


class _Hashes(dict):
    """token -> 32-bit hash; bounded."""

    def __missing__(self, token: str) -> int:
        value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(self) >= 120_000:
            self.clear()
        self[token] = value
        return value


_HASHES = _Hashes()
_REPEAT, _START = np.uint32(zlib.crc32(b"<repeat>")), zlib.crc32(b"<start>")


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of the whole text: distinct indices and their counts."""
    tokens = np.fromiter(map(_HASHES.__getitem__, _TOKEN.findall(text)), dtype=np.uint32)
    if not len(tokens):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    left = np.concatenate([np.array([_START], dtype=np.uint32), tokens[:-1]])
    pairs = np.where(left == tokens, _REPEAT, left * np.uint32(2654435761) ^ tokens * np.uint32(2246822519))
    both = np.concatenate([tokens * np.uint32(2654435761), pairs * np.uint32(3266489917)]) >> np.uint32(32 - bits)
    at, n = np.unique(both, return_counts=True)
    return at.astype(np.int64), n.astype(np.float64)


def values(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / counts.sum()) if len(counts) else counts


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: str) -> float:
        at, n = grams(text, self.bits)
        z = self.bias + float(self.weights[at] @ values(n))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int, float]], bits: int, passes: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01) -> Model:
    """FTRL-Proximal over (indices, counts, label, weight) in the given order."""
    size = (1 << bits) + 1  # the last one is the bias
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(passes):
        for at, counts, label, weight in rows:
            at, x = np.append(at.astype(np.int64), size - 1), np.append(values(counts.astype(np.float64)), 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
            g = weight * (p - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500, bits: int = 18) -> Model | None:
    """Learn from at most ``per_label`` rows of either label, whole texts, in the order of a hash of the id.

    Rows with a null text count as empty; labels other than 0 and 1 don't take
    part. None if no row is left.
    """
    rows = labelled.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(label_col).cast("int").alias("_label"))
    rows = rows.where(F.col("_label").isin(0, 1))
    sample = stratified_sample(rows, "_label", "_id", per_label)

    def sparse(batches):
        for pdf in batches:
            found = []
            for key, label, text in zip(pdf["_order"], pdf["_label"], pdf["_text"]):
                at, n = grams(text, bits)
                found.append((key, label, at.astype("<u4").tobytes(), n.astype("<u4").tobytes()))
            yield pd.DataFrame(found, columns=["o", "label", "at", "n"])

    got = sample.select(F.xxhash64(F.lit(9), "_id").alias("_order"), "_label", "_text").mapInPandas(sparse, "o long, label int, at binary, n binary").collect()
    if not got:
        return None
    got.sort()
    ones = sum(r[1] for r in got)
    weight = {1: len(got) / 2 / max(1, ones), 0: len(got) / 2 / max(1, len(got) - ones)}
    return train_ftrl([(np.frombuffer(at, "<u4"), np.frombuffer(n, "<u4"), label, weight[label]) for _, label, at, n in got], bits)


def scorer(model: Model | None):
    """Pandas UDF of a text column: probability of label 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series([0.5 if model is None else model.score(t or "") for t in texts], dtype="float64")
        give_back()
        return out

    return score


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "_quality") -> DataFrame:
    """Adds double column ``out`` from 0 to 1.

    Null and empty texts get the score of no features (the bias alone); without
    a model every score is 0.5. Repeated rows get the same score.
    """
    return docs.withColumn(out, scorer(model)(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(F.col(id_col), 3) == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> Model | None:
    """Sample the labels first, so that only chosen texts are joined to them."""
    own = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    own = stratified_sample(own.where(F.col("quality").isin(0, 1)), "quality", "doc_id", per_label)
    return fit(sampled_rows(docs.select("doc_id", "text"), own, "doc_id", 2 * per_label), per_label=per_label)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit_on(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), model, "text", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
