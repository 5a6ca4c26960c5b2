"""Best-fit packing with Martello-Toth dominance reduction.

The plan works on the histogram of piece lengths (at most ``capacity`` rows,
whatever the corpus): small sets that provably dominate all alternatives are
fixed first, whole length classes at a time, then best fit packs the rest.
Pieces take their places by their rank within their length class, so neither
the plan nor any task ever holds all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column_type, free_name, materialize, shuffle_width

#: ((length, times), ...), sequences of that kind
Pattern = tuple[tuple[tuple[int, int], ...], int]


class _Sizes:
    """Counts by length, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_right(self.order, size) - 1)

    def largest(self, most: int, without: dict[int, int]) -> int:
        """Largest length up to ``most`` of which more is left than ``without`` uses; 0 if none."""
        i = bisect_right(self.order, most) - 1
        while i >= 0 and self.count[self.order[i]] <= without.get(self.order[i], 0):
            i -= 1
        return self.order[i] if i >= 0 else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest items besides one of length ``without``."""
        out: list[int] = []
        for size in self.order:
            out += [size] * min(n - len(out), self.count[size] - (size == without))
            if len(out) == n:
                break
        return out


def _dominating(sizes: _Sizes, size: int, capacity: int) -> tuple[int, ...] | None:
    """The others of a set with ``size`` that dominates every feasible set with it, or None.

    A set dominates another if the other's items can be parted into groups, each
    no longer than an item of its own in the set.
    """
    room = capacity - size
    least = sizes.smallest(3, size)
    if not least or least[0] > room:
        return ()
    first = sizes.largest(room, {size: 1})
    if first == room or len(least) < 2 or least[0] + least[1] > room:
        return (first,)  # fills the sequence, or no set holds two others
    if len(least) == 3 and sum(least) <= room:
        return None  # sets of four and more: left to best fit
    best_sum, best_low = 0, 0  # over pairs of others
    for high in reversed(sizes.order):
        if high + least[0] > room:
            continue
        if 2 * high <= best_low:
            break
        low = sizes.largest(min(room - high, high), {size: 1} if high != size else {size: 2})
        if low == high and sizes.count[high] - (high == size) < 2:
            low = sizes.largest(high - 1, {size: 1})
        if low:
            best_sum, best_low = max(best_sum, high + low), max(best_low, low)
    if best_sum <= first:
        return (first,)
    second = sizes.largest(room - first, {size: 1} if first != size else {size: 2})
    if second == first and sizes.count[first] - (first == size) < 2:
        second = sizes.largest(first - 1, {size: 1})
    return (first, second) if second and best_low <= second else None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix dominating sets; returns their patterns and the counts that remain."""
    sizes, fixed = _Sizes(counts), []
    for size in sorted(counts, reverse=True):
        while size in sizes.count:
            others = _dominating(sizes, size, capacity)
            if others is None:
                break
            members = (size, *others)
            uses = {s: members.count(s) for s in members}
            # taking items away only raises the smallest ones, so the reason holds until a length runs out
            n = min(sizes.count[s] // k for s, k in uses.items())
            for s, k in uses.items():
                sizes.take(s, n * k)
            fixed.append((tuple(sorted(uses.items(), reverse=True)), n))
    return fixed, sizes.count


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over whole length classes."""
    open_: dict[int, list[list]] = {}
    room_order: list[int] = []

    def put(room: int, runs: tuple, n: int) -> None:
        if room not in open_:
            open_[room] = []
            room_order.insert(bisect_right(room_order, room), room)
        open_[room].append([runs, n])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_right(room_order, size - 1)
            room = room_order[i] if i < len(room_order) else capacity
            each = room // size
            bins = open_[room][-1] if i < len(room_order) else [(), max(1, left // each)]
            n = min(bins[1], left // each)
            put_each = each if n else left
            n = n or 1
            left -= n * put_each
            bins[1] -= n
            if i < len(room_order) and not bins[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    room_order.pop(i)
            put(room - put_each * size, (*bins[0], (size, put_each)), n)
    return [(tuple(runs), n) for kinds in open_.values() for runs, n in kinds]


def pack_counts(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item once, lengths from 1 to capacity."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, times a sequence, first offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for runs, n in patterns:
        at = 0
        for size, times in runs:
            rows.setdefault(size, []).append((rank.get(size, 0), sequence, times, at))
            rank[size] = rank.get(size, 0) + n * times
            at += size * times
        sequence += n
    return {size: np.array(x, dtype=np.int64) for size, x in rows.items()}


def ranked(df: DataFrame, key: str, ties: list[str]) -> tuple[DataFrame, str]:
    """Adds a gapless rank from 0 within ``key``, and says its column's name; a hot key is dealt out by a hash of ``ties``."""
    salt, row, before, n = (free_name(df, c) for c in ("_salt", "_row", "_before", "_n"))
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*ties), F.lit(shuffle_width(df.sparkSession))).cast("int"))
    counts = salted.groupBy(key, salt).agg(F.count(F.lit(1)).alias(n))
    first = counts.select(key, salt, (F.sum(n).over(Window.partitionBy(key).orderBy(salt)) - F.col(n)).alias(before))
    local = salted.withColumn(row, F.row_number().over(Window.partitionBy(key, salt).orderBy(*ties)))
    return local.join(first, [key, salt]).withColumn(row, F.col(before) + F.col(row) - 1).drop(salt, before), row


def pack(pieces: DataFrame, capacity: int, ties: list[str], length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to capacity.

    ``pieces`` must be a stored table (it is read twice). Rows with a null or
    other length are an error. Equal rows take different places. An empty table
    stays empty. Columns named sequence_id or offset are replaced.
    """
    counts = dict(pieces.groupBy(length).agg(F.count(F.lit(1))).collect())  # at most capacity rows
    if any(s is None or not 0 < s <= capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places = _places(pack_counts(counts, capacity))
    rows, own = ranked(pieces.drop("sequence_id", "offset"), length, ties)
    names = [c for c in rows.columns if c != own]

    def place(batches):
        for pdf in batches:
            size, rank = pdf[length].to_numpy(), pdf[own].to_numpy()
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                table = places[int(size[at[0]])]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                step = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + step // row[:, 2], row[:, 3] + step % row[:, 2] * size[at]
            yield pdf[names].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return rows.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: ids by the tokenizer file, then ``end_id``.

    A document longer than capacity is cut so that every piece but the first is
    full. Null text: empty, which is the end id alone. Null or repeated ids are
    kept as they are, a document a row. Other columns are not returned.
    """

    def cut(batches):
        from .tokens import encoder

        end = np.array([end_id], dtype="<u4")
        for b in batches:
            for at, some in encoder(tokenizer).many(b.column(1)):
                rows = []
                for row, ids in enumerate(some, at):
                    data = memoryview(np.concatenate([ids, end]).tobytes())
                    n = len(data) // 4
                    first = (n - 1) % capacity + 1
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if start == 0 else capacity
                        rows.append((row, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                row, piece, *rest = (np.array(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, rest)], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = column_type(docs, id_col).simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, 0, id_col, text_col), "pieces")
    return pack(pieces, capacity, [id_col, "piece", "start", "ids_crc32"])
