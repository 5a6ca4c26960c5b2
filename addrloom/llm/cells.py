"""Buckets of any size as bounded cells: blocks of a bucket meet pairwise.

A bucket of more than ``block`` rows is split by a hash of the id into blocks;
each pair of blocks is a cell of its own, so a hot bucket spreads over tasks
and every pair of its rows still meets in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["_cell_i", "_cell_j"]


def in_cells(rows: DataFrame, key: list[str], id_col: str, block: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """Rows of buckets with two rows or more, once per cell, with _block, _cell_i, _cell_j.

    A block has about ``block`` rows at most and, where a column ``weight`` is given,
    rows of about ``block_weight`` in all, so that cells are bounded in bytes too.
    """
    blocks = F.ceil(F.count(F.lit(1)) / block)
    if weight:
        blocks = F.least(F.count(F.lit(1)), F.greatest(blocks, F.ceil(F.sum(weight) / block_weight)))
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), blocks.cast("int").alias("_blocks")).where("_n > 1").drop("_n")
    blocked = rows.join(counts, key).withColumn("_block", F.pmod(F.xxhash64(F.lit(11), id_col), F.col("_blocks")).cast("int"))
    other = blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumn("_cell_i", F.least("_block", "_other")).withColumn("_cell_j", F.greatest("_block", "_other")).drop("_other", "_blocks")


def dealt(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells together in a partition and in order."""
    keys = [*key, *CELL]
    return cells.repartition(*keys).sortWithinPartitions(*keys)


def whole_cells(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut between cells, with the number of the cell of each row."""
    keys, held = [*key, *CELL], []
    for pdf in batches:
        if not len(pdf):
            continue
        tail = pdf[keys].to_numpy()
        last = np.flatnonzero((tail != tail[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut or (held and (held[-1][keys].to_numpy()[-1] != tail[0]).any()):
            done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
            yield done, _numbers(done, keys)
        held.append(pdf.iloc[cut:])
    if held:
        done = pd.concat(held, ignore_index=True)
        if len(done):
            yield done, _numbers(done, keys)


def _numbers(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    k = pdf[keys].to_numpy()
    return np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])


def pairs(pdf: pd.DataFrame, number: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that are to be compared: in one cell, and of its two blocks where it has two."""
    diagonal, block = (pdf["_cell_i"] == pdf["_cell_j"]).to_numpy(), pdf["_block"].to_numpy()
    left = np.arange(len(pdf))
    got, n, step = [], 0, 1
    while len(left):
        left = left[left + step < len(pdf)]
        left = left[number[left] == number[left + step]]
        right = left + step
        use = diagonal[left] | (block[left] != block[right])
        if use.any():
            got.append((left[use], right[use]))
            n += int(use.sum())
        if got and (n >= most or not len(left)):
            yield np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])
            got, n = [], 0
        step += 1
    if got:
        yield np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


def sides(pdf: pd.DataFrame, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each cell the indices of its two sides; a cell of one block has that block on both."""
    block, i, j = (pdf[c].to_numpy() for c in ("_block", *CELL))
    for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(number)) + 1):
        if i[at[0]] == j[at[0]]:
            yield at, at
        else:
            left = block[at] == i[at[0]]
            yield at[left], at[~left]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the given ones."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out
