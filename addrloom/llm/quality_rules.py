"""Quality rules: counts of the whole text, and a linear-chain CRF over its lines.

Viterbi decoding labels each line content or boilerplate; the share of words in
content lines decides retention.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled_rows, stratified_sample

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
LABELS = ("boilerplate", "content")
FEATURES = (
    "bias", "first line", "last line", "one word", "up to 3 words", "over 12 words", "symbol share", "symbols over a tenth", "upper-case share",
    "all upper case", "digit share", "ends a sentence", "equals an earlier line", "repeats its last word", "distinct word share", "pipes", "exclamation pairs", "mean word length over 9",
)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly these six characters
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) < 1 << 20:
            window = pair[:-1] * len(number) + ids[2:]
        else:
            window = np.unique(pair, return_inverse=True)[1][:-1] * len(number) + ids[2:]
        order = np.argsort(window, kind="stable")
        equal = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : k + n - 2] |= twice
        repeated = int(covered.sum())
    return n, len(text) - len(_SPACE.findall(text)), len(_SYMBOL.findall(text)), dup, repeated


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and word counts of the lines that have a word."""
    lines = [(line, words) for line in text.split("\n") if (words := line.split())]
    x, n_words = np.zeros((len(lines), len(FEATURES)), dtype=np.float32), np.zeros(len(lines))
    seen: set[str] = set()
    for row, i, (line, words) in zip(x, range(len(lines)), lines):
        n = n_words[i] = len(words)
        size = sum(map(len, words))
        symbols = len(_SYMBOL.findall(line))
        upper = sum(map(str.isupper, words))
        row[:] = (
            1, i == 0, i == len(lines) - 1, n == 1, n <= 3, n > 12, symbols / size, symbols > 0.1 * size, upper / n,
            upper == n, sum(any(c.isdigit() for c in w) for w in words) / n, line.rstrip()[-1] in ".!?", line in seen, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, line.count("|") / n, line.count("!!") / n, size > 9 * n,
        )
        seen.add(line)
    return x, n_words


@dataclass
class Crf:
    """emit: features x 2; move: label before x label."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best label of each line (1: content), ties to content."""
        score = x @ self.emit
        n = len(score)
        if not n:
            return np.zeros(0, dtype=np.int8)
        back = np.zeros((n, 2), dtype=np.int8)
        (b, c), ((bb, bc), (cb, cc)) = score[0].tolist(), self.move.tolist()
        for i, (sb, sc) in enumerate(score.tolist()[1:], 1):
            back[i] = cb + c >= bb + b, cc + c >= bc + b
            b, c = max(bb + b, cb + c) + sb, max(bc + b, cc + c) + sc
        path = np.zeros(n, dtype=np.int8)
        path[-1] = c >= b
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of labels y, by forward and backward sums."""
        s, n = x @ self.emit, len(x)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = s[0]
        for i in range(1, n):
            ahead[i] = s[i] + np.logaddexp(ahead[i - 1, 0] + self.move[0], ahead[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp(self.move[:, 0] + s[i + 1, 0] + behind[i + 1, 0], self.move[:, 1] + s[i + 1, 1] + behind[i + 1, 1])
        total = np.logaddexp(*ahead[-1])
        own = np.exp(ahead + behind - total)
        d_emit = x.T @ (np.eye(2)[y] - own)
        d_move = np.zeros((2, 2))
        if n > 1:
            both = np.exp(ahead[:-1, :, None] + self.move + (s + behind)[1:, None, :] - total).sum(axis=0)
            np.add.at(d_move, (y[:-1], y[1:]), 1)
            d_move -= both
        return d_emit, d_move


def train(rows: list[tuple[np.ndarray, np.ndarray]], passes: int = 4, rate: float = 0.2, l2: float = 1e-3) -> Crf:
    """Stochastic gradient over (features, labels of the lines) in the given order."""
    crf = Crf(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    seen = [np.full_like(crf.emit, 1e-6), np.full_like(crf.move, 1e-6)]
    for _ in range(passes):
        for x, y in rows:
            for value, grad, total in zip((crf.emit, crf.move), crf.gradient(x, y), seen):
                grad = np.clip(grad / len(y), -1, 1) - l2 * value
                total += grad**2
                value += rate * grad / np.sqrt(total)
    return crf


def weak_labels(x: np.ndarray, quality: int) -> np.ndarray:
    """Labels for training: lines of good documents are content unless they repeat an earlier line, all lines of bad ones boilerplate."""
    return np.where(x[:, FEATURES.index("equals an earlier line")] > 0, 0, quality).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 400) -> Crf | None:
    """Train on all lines of at most ``per_label`` labelled documents of either quality (a bound of the training sample alone).

    Rows of ``docs`` that repeat an id count as documents of their own, within the bound.
    """
    own = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    own = stratified_sample(own.where(F.col("quality").isin(0, 1)), "quality", "doc_id", per_label)

    def sparse(batches):
        for pdf in batches:
            found = [(key, q, line_features(text or "")[0].astype("<f4").tobytes()) for key, q, text in zip(pdf["_order"], pdf["quality"], pdf["text"])]
            yield pd.DataFrame(found, columns=["o", "q", "x"])

    sample = stratified_sample(sampled_rows(docs.select("doc_id", "text"), own, "doc_id", 2 * per_label), "quality", "doc_id", per_label)
    got = sample.select(F.xxhash64(F.lit(6), "doc_id").alias("_order"), "quality", "text").mapInPandas(sparse, "o long, q int, x binary").collect()
    rows = [(np.frombuffer(x, "<f4").reshape(-1, len(FEATURES)).astype(np.float64), q) for _, q, x in sorted(got) if x]
    return train([(x, weak_labels(x, q)) for x, q in rows]) if rows else None


def judge(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5, least_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, n_lines, n_content_lines, content_share, kept.

    Null text: no words, which fails the base rules. Without a model every line
    is content. Repeated rows get the same answer; other columns aren't returned.
    """

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            x, n = line_features(text)
            path = crf.viterbi(x) if crf else np.ones(len(x), dtype=np.int8)
            rows.append((*base_counts(text), len(x), int(path.sum()), float((n * path).sum() / max(1, n.sum()))))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share"])

    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col).cast("string")).alias("_m")).select("doc_id", "_m.*")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= least_share))
