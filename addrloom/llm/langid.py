"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one binary classifier over hashed
byte n-grams predicts each bit, and loss-weighted decoding picks the codeword
of least loss. Texts whose two best codewords are close are flagged.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, stratified_sample

ORDERS = (1, 2, 3, 4)
_MULTIPLIER = 2654435761
_CHUNK = 1 << 20
UNKNOWN = "und"


def ngram_counts(data: bytes, buckets: int) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text, a chunk at a time."""
    out = np.zeros(buckets, dtype=np.int64)
    shift = 32 - (buckets.bit_length() - 1)
    for start in range(0, len(data), _CHUNK):
        b = np.frombuffer(data, dtype=np.uint8, count=min(_CHUNK + max(ORDERS) - 1, len(data) - start), offset=start).astype(np.uint32)
        gram = np.zeros(len(b), dtype=np.uint32)
        for n in ORDERS:
            if len(b) < n:
                break
            gram = (gram[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
            own = gram[:_CHUNK]  # each n-gram counts in the chunk where it starts
            out += np.bincount(((own ^ np.uint32(n * 0x9E3779)) * np.uint32(_MULTIPLIER)) >> np.uint32(shift), minlength=buckets)
    return out


def features(text: str, buckets: int) -> np.ndarray:
    counts = ngram_counts(b" " + text.lower().encode() + b" ", buckets)
    return np.sqrt(counts / counts.sum(), dtype=np.float32, casting="unsafe")


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code up to 5 languages, else a random dense one."""
    if n == 1:
        return np.ones((1, 1), dtype=np.float32)
    if n <= 5:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.float32).T.copy()
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([1, -1], dtype=np.float32), size=(n, width))
        apart = (width - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    share: np.ndarray
    buckets: int

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and its lead over the second, for rows of features."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.share[None]
        total = -loss.sum(axis=2) * self.code.shape[1]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))
        best = p[rows, order[:, 0]]
        lead = best - (p[rows, order[:, 1]] if p.shape[1] > 1 else 0)
        return order[:, 0], best, lead


def train(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 150, rate: float = 0.3, l2: float = 1e-6) -> Model:
    """Logistic classifiers for all bits at once, languages weighing alike (Adam, full batch)."""
    code = codewords(len(langs))
    target = code[y]
    per_row = (1.0 / np.bincount(y, minlength=len(langs))[y] / len(langs)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        slope = -target * per_row / (1 + np.exp(np.clip(target * (x @ w + b), -50, 50)))
        for value, grad, i in ((w, x.T @ slope + l2 * w, 0), (b, slope.sum(axis=0), 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 1] = 0.999 * moments[i + 1] + 0.001 * grad**2
            value -= (rate * moments[i] / (1 - 0.9**t) / (np.sqrt(moments[i + 1] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    right = (target * (x @ w + b) > 0).astype(np.float32)
    # loss weights: how often the bit is right for rows of the language
    share = np.array([right[y == k].mean(axis=0) + 1e-3 for k in range(len(langs))])
    return Model(langs, code, w, b, (share / share.sum(axis=1, keepdims=True)).astype(np.float32), x.shape[1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, buckets: int = 1 << 13) -> Model | None:
    """Learn from at most ``per_lang`` labelled rows of each language, whole texts.

    Rows with a null language, a null text or no letter don't take part. None if
    no row is left.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = stratified_sample(rows.where(F.col("_text").rlike(r"\p{L}")), "_lang", "_id", per_lang)

    def sparse(batches):
        for pdf in batches:
            found = []
            for lang, text in zip(pdf["_lang"], pdf["_text"]):
                counts = ngram_counts(b" " + text.lower().encode() + b" ", buckets)
                at = np.flatnonzero(counts)
                found.append((lang, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            yield pd.DataFrame(found, columns=["lang", "at", "n"])

    sample = rows.select("_lang", "_text").mapInPandas(sparse, "lang string, at binary, n binary").collect()
    if not sample:
        return None
    sample.sort()
    langs = sorted({r[0] for r in sample})
    x = np.zeros((len(sample), buckets), dtype=np.float32)
    for row, (_, at, n) in zip(x, sample):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
    x /= x.sum(axis=1, keepdims=True)
    return train(np.sqrt(x, out=x), np.array([langs.index(r[0]) for r in sample]), langs)


def predictor(model: Model | None, least_lead: float = 0.1, block: int = 256):
    """Pandas UDF of a text column: struct (lang_pred, score, ambiguous)."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        lang, score, ambiguous = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
        known = [i for i, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
        values = texts.to_numpy()
        for start in range(0, len(known), block):
            at = known[start : start + block]
            best, p, lead = model.decode(np.stack([features(values[i], model.buckets) for i in at]))
            lang[at], score[at], ambiguous[at] = [model.langs[k] for k in best], p, lead < least_lead
        give_back()
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "ambiguous": ambiguous})

    return predict


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "_language") -> DataFrame:
    """Adds struct column ``out``: lang_pred, score (0 to 1), ambiguous.

    Null, empty and letterless texts, and every text if there is no model, are
    ``und`` with score 0 and ambiguous. Repeated rows get the same answer.
    """
    return docs.withColumn(out, predictor(model)(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row; learns outside the held-out fold."""
    model = fit(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col)
    scored = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), model, "_text")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "_language.*")
