"""Embedding near-dedup by randomised-rotation binary codes.

Unit vectors are rotated at random; a vector keeps the signs of its rotated
components and a correction factor, the inner product of the vector and its
code. Runs of the signs name the buckets in which vectors meet. In a bucket,
codes alone are compared first: a pair whose signs agree too seldom for the
threshold is out. For the rest, code and factor of one vector give an unbiased
estimate of its cosine with the other vector and a bound on the error; only
pairs that the bound leaves open are computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import dealt, forest, in_cells, sides, whole_cells
from .common import discard, materialize
from .components import components

COSINE = 0.9
#: Signs of a code at least; more rotations make up what the dimension lacks.
LEAST_SIGNS = 128
_STRIP = 512


@lru_cache(8)
def rotations(dim: int, n: int, seed: int = 7) -> np.ndarray:
    """n random orthogonal matrices side by side: dim x (n * dim). Kept by each worker."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def sign_agreement(cosine: float) -> float:
    """Chance that a random direction gives two vectors at ``cosine`` the same sign."""
    return 1 - math.acos(cosine) / math.pi


def table_count(bits: int, cosine: float, recall: float) -> int:
    """Tables of ``bits`` signs in which a pair at ``cosine`` meets at least once with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - sign_agreement(cosine) ** bits)))


def rotation_count(dim: int, tables: int, bits: int) -> int:
    """Rotations that give the signs of all tables, and LEAST_SIGNS."""
    return math.ceil(max(tables * bits, LEAST_SIGNS) / dim)


def least_agreement(signs: int, cosine: float, sureness: float) -> float:
    """Signs that vectors at ``cosine`` have in common, less ``sureness`` standard errors."""
    p = sign_agreement(cosine)
    return signs * p - sureness * math.sqrt(signs * p * (1 - p))


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (True: not negative) and correction factors of unit rows."""
    y = x @ rotate
    return y >= 0, np.abs(y).sum(axis=1) / math.sqrt(y.shape[1]) / math.sqrt(y.shape[1] / x.shape[1])


def estimate(code: np.ndarray, factor: np.ndarray, other: np.ndarray, dim: int, sureness: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of cosines from the codes (+1/-1) of one side and the rotated other side, and their error bounds."""
    signs = code.shape[1]
    found = np.einsum("ij,ij->i", code, other, dtype=np.float64) / math.sqrt(signs) / math.sqrt(signs / dim) / factor
    return found, sureness * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, signs - 1))


def _signs(blobs, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), -1), axis=1)[:, :n]


def meeting(code: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, tables: int, bits: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell's sides whose codes (0/1) agree in ``least`` signs, taken in the first table where they meet."""
    signs = code.shape[1]
    other = code[right].astype(np.float32) * 2 - 1
    buckets = code[:, : tables * bits].reshape(len(code), tables, bits)
    for start in range(0, len(left), _STRIP):
        strip = left[start : start + _STRIP]
        agree = (code[strip].astype(np.float32) * 2 - 1) @ other.T
        a, b = np.nonzero(agree >= 2 * least - signs - 0.5)
        a, b = strip[a], right[b]
        once = a < b if left is right else np.ones(len(a), dtype=bool)
        a, b = a[once], b[once]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            first = (buckets[x] == buckets[y]).all(axis=2).argmax(axis=1) == table[x]
            if first.any():
                yield x[first], y[first]


def near(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, recall: float = 0.999, sureness: float = 5.0, block: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(members, found): id, rep, copies of every valid vector; found has a, b, n as in the Jaccard join's links.

    Signs a bucket are so many that buckets have about ``block`` vectors, and
    tables so many that a pair at ``cosine`` meets with chance ``recall`` (surer
    above it): rows a vector grow with the 0.22th power of the count.
    """
    comps = F.col(vec_col).cast("array<double>")
    valid = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(comps, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(comps, lambda c: c != 0)
    kind = vectors.schema[vec_col].dataType
    own = F.col(vec_col) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else comps
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(valid, own).alias("v")).where("v is not null")
    rows = rows.select("id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    # equal vectors are one class; its smallest id stands for it
    classes = materialize(rows.groupBy("h1", "h2", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    members = rows.select("id", "h1", "h2").join(classes.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).select("id", "rep", "copies")
    total = classes.count()
    bits = max(1, math.ceil(math.log2(max(1, total) / block)))
    tables = table_count(bits, cosine, recall)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def coded(batches):
        for pdf in batches:
            rep, arrays = pdf["rep"].to_numpy(), pdf["v"].tolist()
            size = np.array([len(v) for v in arrays])
            for dim in map(int, np.unique(size)):
                at = np.flatnonzero(size == dim)
                rotate = rotations(dim, rotation_count(dim, tables, bits))
                for start in range(0, len(at), 1000):
                    part = at[start : start + 1000]
                    signs, factor = encode(unit(np.stack([np.asarray(arrays[i], dtype=np.float64) for i in part])), rotate)
                    # the bucket is above the dimension, so that cells hold vectors of one length
                    bucket = (signs[:, : tables * bits].reshape(len(part), tables, bits) @ powers) * (1 << 24) + dim
                    yield pd.DataFrame({"rep": rep[part], "bucket": list(bucket), "code": [c.tobytes() for c in np.packbits(signs, axis=1)], "factor": factor})

    sketch = materialize(classes.select("rep", "v").mapInPandas(coded, "rep long, bucket array<long>, code binary, factor double"), "codes")
    key = ["tab", "bucket"]
    cells = in_cells(sketch.select("rep", "code", F.posexplode("bucket").alias("tab", "bucket")), key, "rep", block)

    def by_dim(pdf):
        """Cells of one length of vectors: (length, its rows, their signs)."""
        dims = pdf["bucket"].to_numpy() & ((1 << 24) - 1)
        for dim in map(int, np.unique(dims)):
            at = np.flatnonzero(dims == dim)
            own = pdf.iloc[at].reset_index(drop=True)
            yield dim, at, own, _signs(own["code"].tolist(), dim * rotation_count(dim, tables, bits))

    def pairs(own, number, code):
        table, least = own["tab"].to_numpy(), least_agreement(code.shape[1], cosine, sureness)
        for left, right in sides(own, number):
            yield from meeting(code, table, left, right, tables, bits, least)

    def active(batches):
        """The vectors of a cell that have a pair there which their codes leave open."""
        for pdf, number in whole_cells(batches, key):
            hit = np.zeros(len(pdf), dtype=bool)
            for _, at, own, code in by_dim(pdf):
                for a, b in pairs(own, number[at], code):
                    hit[at[a]] = hit[at[b]] = True
            yield pdf.loc[hit, [*key, "_block", "_cell_i", "_cell_j", "rep"]]

    hits = materialize(dealt(cells, key).mapInPandas(active, "tab int, bucket long, _block int, _cell_i int, _cell_j int, rep long"), "active-vectors")

    def verify(batches):
        for pdf, number in whole_cells(batches, key):
            rep, copies, arrays = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["v"].tolist()
            n = np.zeros(len(pdf), dtype=np.int64)
            edges_a, edges_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for dim, at, own, code in by_dim(pdf):
                x = unit(np.stack([np.asarray(arrays[i], dtype=np.float64) for i in at]))
                turned = (x @ rotations(dim, rotation_count(dim, tables, bits))).astype(np.float32)
                sign, factor = code.astype(np.int8) * np.int8(2) - np.int8(1), own["factor"].to_numpy()
                for a, b in pairs(own, number[at], code):
                    for start in range(0, len(a), 1 << 13):
                        p, q = a[start : start + (1 << 13)], b[start : start + (1 << 13)]
                        found, bound = estimate(sign[p], factor[p], turned[q], dim, sureness)
                        open_ = found + bound >= cosine
                        p, q = p[open_], q[open_]
                        ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                        p, q = at[p[ok]], at[q[ok]]
                        np.add.at(n, p, copies[q])
                        np.add.at(n, q, copies[p])
                        edges_a.append(rep[p])
                        edges_b.append(rep[q])
            edges = forest(np.concatenate(edges_a), np.concatenate(edges_b))
            some = n > 0
            yield pd.DataFrame({"a": np.concatenate([rep[some], np.array([e[0] for e in edges], dtype=np.int64)]), "b": pd.array([None] * int(some.sum()) + [e[1] for e in edges], dtype="Int64"), "n": np.concatenate([n[some], np.zeros(len(edges), dtype=np.int64)])})

    full = hits.join(classes.select("rep", "v", "copies"), "rep").join(sketch.select("rep", "code", "factor"), "rep")
    found = materialize(dealt(full, key).mapInPandas(verify, "a long, b long, n long"), "vector-links")
    discard(hits, sketch)
    return members, found


def dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors link if their cosine in double precision is 0.9 or more, whatever
    other columns say; vectors of different lengths don't. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing. Rows
    with a null id have component_id null, no links, and are kept. Rows that
    repeat an id get one answer each, the same for all. An empty table stays empty.
    """
    members, found = near(vectors, id_col, vec_col, **how)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    group = components(found.where("b is not null").select("a", "b"))
    per_class = materialize(counts.join(group.withColumnRenamed("id", "rep"), "rep", "full_outer"), "class-links")
    own = members.join(per_class, "rep", "left").groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(own, F.col("vec_id") == F.col("id"), "left")
    alone = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(alone == F.col("vec_id"), F.lit(True)).alias("kept"))
