"""N-gram Jaccard join by a MinHash LSH forest.

A document's signature is cut into trees; in a tree, the signature's part is a
label, and documents with a common prefix of their labels share a node of the
sorted trie. Prefixes begin at their full depth and are shortened level by
level: each level adds the pairs that meet there first, and from the similarity
of all pairs found so far and their chance to be found the recall is estimated.
Shortening ends at the target recall, or at the depth where a pair at the
threshold meets with the target chance whatever was found. Pairs are then
verified on whole sets of hashed word shingles. Texts with the same words are
one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import dealt, forest, in_cells, pairs, whole_cells
from .common import discard, give_back, materialize
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 1 << 16


class _Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= 120_000:
            self.clear()
        self[word] = value
        return value


_WORDS = _Words()


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the runs of five words, in order; fewer words: one run of all."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    k = min(SHINGLE, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * _P + w[i : n - k + 1 + i]
    h = (h ^ (h >> np.uint64(30))) * _M1
    return (h ^ (h >> np.uint64(27))) * _M2


def prefix_depth(trees: int, depth: int, similarity: float, recall: float) -> int:
    """Longest prefix, from ``depth`` down, that a pair at ``similarity`` shares in some tree with chance ``recall``."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(sets: list[np.ndarray], width: int, seed: int = 10) -> np.ndarray:
    """Minima of ``width`` hash functions over each set of shingles; none may be empty."""
    rng = np.random.default_rng(seed)
    xor, odd = rng.integers(0, 1 << 63, width, dtype=np.uint64), rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(sets), width), 0xFFFFFFFF, dtype=np.uint32)
    rows, parts, size = [], [], 0

    def flush():
        h = np.concatenate(parts)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        at = np.array(rows)
        for i in range(width):
            low = np.minimum.reduceat(((h ^ xor[i]) * odd[i]) >> np.uint64(32), starts).astype(np.uint32)
            np.minimum.at(out[:, i], at, low)

    for row, h in enumerate(sets):
        for start in range(0, len(h), _CHUNK):
            part = h[start : start + _CHUNK]
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= _CHUNK:
                flush()
                rows, parts, size = [], [], 0
    if parts:
        flush()
    return out


def slices(texts: pd.Series, rows: int = 500, chars: int = 1 << 21) -> Iterator[slice]:
    """Positions of a batch in runs of at most ``rows`` texts and ``chars`` characters, a longer text alone: lists of words take many times their text's bytes."""
    start, held = 0, 0
    for i, n in enumerate(len(t or "") for t in texts):
        if i > start and (i - start >= rows or held + n > chars):
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def _sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def sketch(batches):
        for pdf in batches:
            for at in slices(pdf["_text"]):
                part = pdf.iloc[at]
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in part["_text"]]
                full = [i for i, w in enumerate(split) if w]
                sig = signatures([shingles(split[i]) for i in full], width)
                yield pd.DataFrame({
                    "id": part["_id"].to_numpy()[full], "words": [hashlib.blake2b(b" ".join(split[i]), digest_size=16).digest() for i in full],
                    "size": [len(split[i]) for i in full], "sig": [s.astype("<u2").tobytes() for s in sig],
                })
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_id").isNotNull())
    return rows.mapInPandas(sketch, "id long, words binary, size long, sig binary")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < 8 * len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())])
    # many pairs among few sets: products of 0/1 matrices, some shingles at a time
    ids, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(used), len(used)), dtype=np.float32)
    for start in range(0, len(ids), 2048):
        lo, hi = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((len(used), 2048), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    return both[at[: len(a)], at[len(a) :]].astype(np.int64)


def meeting_chance(similarity: np.ndarray, trees: int, level: int) -> np.ndarray:
    """Chance of a pair to share a prefix of ``level`` minima in some tree."""
    return 1 - (1 - similarity**level) ** trees


def estimated_recall(found: np.ndarray, trees: int, level: int, similarity: float, bands: int = 5) -> float:
    """Share of links that prefixes of ``level`` minima find, by what they found.

    ``found`` counts the pairs by their number of equal minima. Each stands for
    the inverse of its chance; the least share of ``bands`` equal parts of the
    range from the threshold up counts, so that many near copies don't hide a
    loss at the threshold. Without a link nothing is known: 0.
    """
    width = len(found) - 1
    s = np.arange(width + 1) / width
    link = (s >= similarity) & (found > 0)
    band = np.minimum(((s - similarity) / (1 - similarity) * bands).astype(int), bands - 1)
    stands_for = found / np.maximum(meeting_chance(s, trees, level), 1e-12)
    shares = [found[own].sum() / stands_for[own].sum() for k in range(bands) if (own := link & (band == k)).any()]
    return min(shares, default=0.0)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, trees: int = 16, depth: int = 6, recall: float = 0.999, block: int = 1000, block_words: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(members, found): id, rep, copies of every document with words; and a, b, n of links between classes.

    Rows of ``found`` with b null carry n, links that one cell found for class a,
    copies counted; rows with b are links of a spanning forest.
    """
    floor, width = prefix_depth(trees, depth, similarity, recall), trees * depth
    # four standard errors below the threshold: the verification decides on the rest
    least = similarity - 4 * (similarity * (1 - similarity) / width) ** 0.5
    rows = materialize(_sketch(docs, id_col, text_col, width), "sketch")
    classes = rows.groupBy("words").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    key = ["level", "tree", "prefix"]
    label = lambda tree: F.substring(F.col("sig"), F.lit(1) + tree * (2 * depth), F.lit(2 * depth))

    # what shares no shortest prefix shares no longer one
    nodes = F.posexplode(F.array(*(F.xxhash64(F.substring("sig", 1 + 2 * depth * t, 2 * floor)) for t in range(trees))))
    keyed = classes.select("rep", nodes.alias("tree", "node"))
    shared = keyed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    forest_rows = keyed.join(shared, ["tree", "node"], "left_semi").join(classes.select("rep", "size", "sig"), "rep").select("tree", label(F.col("tree")).alias("label"), "rep", "size", "sig")
    tries = materialize(forest_rows.repartition("tree", F.substring("label", 1, 2 * floor)).sortWithinPartitions("tree", "label"), "forest")

    def met(pdf, number):
        """Pairs that pass the check where they meet first: the longest prefix, then the first tree; and their equal minima."""
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype="<u2").reshape(len(pdf), width)
        tree, level = pdf["tree"].to_numpy(), pdf["level"].to_numpy()
        for a, b in pairs(pdf, number):
            equal = sig[a] == sig[b]
            total = equal.sum(axis=1)
            near = np.flatnonzero(total >= least * width)
            if not len(near):
                continue
            a, b, total = a[near], b[near], total[near]
            common = np.minimum.accumulate(equal[near].reshape(len(near), trees, depth), axis=2).sum(axis=2)
            longest = np.maximum(common.max(axis=1), floor)
            ok = (longest == level[a]) & (common.argmax(axis=1) == tree[a])
            if ok.any():
                yield a[ok], b[ok], total[ok]

    placed = "level int, tree int, prefix long, _block int, _cell_i int, _cell_j int, rep long, equal int, n long"
    columns = [x.split()[0] for x in placed.split(", ")]

    def active(batches):
        """The classes of a cell that are in a pair there, and the pairs counted by their equal minima (rep null)."""
        for pdf, number in whole_cells(batches, key):
            hit, seen = np.zeros(len(pdf), dtype=bool), np.zeros(width + 1, dtype=np.int64)
            for a, b, total in met(pdf, number):
                hit[a] = hit[b] = True
                seen += np.bincount(total, minlength=width + 1)
            yield pdf.loc[hit, columns[:-2]].assign(equal=None, n=None).astype({"equal": "Int32", "n": "Int64"})
            if at := np.flatnonzero(seen).tolist():
                yield pd.DataFrame({c: pd.array([None] * len(at), dtype="Int64") for c in columns[:-2]}).assign(equal=at, n=seen[at])
        give_back()

    tables, seen = [], np.zeros(width + 1)  # of the levels
    for level in range(depth, floor - 1, -1):
        nodes = tries.select(F.lit(level).alias("level"), "tree", F.xxhash64(F.substring("label", 1, 2 * level)).alias("prefix"), "rep", "size", "sig")
        cells = in_cells(nodes, key, "rep", block, "size", block_words).drop("size")
        level_hits = materialize(dealt(cells, key).mapInPandas(active, placed), f"level-{level}")
        tables.append(level_hits)
        for equal, n in level_hits.where("rep is null").groupBy("equal").agg(F.sum("n")).collect():  # at most a row per number of equal minima
            seen[equal] += n
        if estimated_recall(seen, trees, level, similarity) >= recall:
            break
    hits = reduce(DataFrame.unionByName, tables).where("rep is not null").drop("equal", "n")

    def sets(batches):
        for pdf in batches:
            for at in slices(pdf["_text"]):
                part = pdf.iloc[at]
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in part["_text"]]
                # an id that is repeated with another text belongs to another class
                own = np.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() == x for w, x in zip(split, part["words"])], dtype=bool)
                blobs = [np.unique(shingles(w)).astype("<u8").tobytes() for w, ok in zip(split, own) if ok]
                yield part.loc[own, ["rep", "copies", "sig", "words"]].assign(set=blobs)
            give_back()

    needed = classes.join(hits.select("rep").distinct(), "rep", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("_text"))
    blobs = texts.join(needed, "rep").mapInPandas(sets, "rep long, copies long, sig binary, words binary, set binary").dropDuplicates(["words"]).drop("words")
    full = hits.join(blobs, "rep").select(*key, "_block", "_cell_i", "_cell_j", "rep", "copies", "sig", "set")

    def verify(batches):
        for pdf, number in whole_cells(batches, key):
            own = [np.frombuffer(x, dtype="<u8") for x in pdf["set"]]
            size, rep, copies = np.array([len(x) for x in own]), pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
            n = np.zeros(len(pdf), dtype=np.int64)
            ga, gb = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for a, b, _ in met(pdf, number):
                order = np.argsort(number[a], kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(number[a[order]])) + 1):
                    common = _common(own, a[at], b[at])
                    ok = common >= similarity * (size[a[at]] + size[b[at]] - common) * (1 - 1e-12)
                    x, y = a[at][ok], b[at][ok]
                    np.add.at(n, x, copies[y])
                    np.add.at(n, y, copies[x])
                    ga.append(x)
                    gb.append(y)
            edges = forest(rep[np.concatenate(ga)], rep[np.concatenate(gb)])
            some = n > 0
            yield pd.DataFrame({"a": np.concatenate([rep[some], np.array([e[0] for e in edges], dtype=np.int64)]), "b": pd.array([None] * int(some.sum()) + [e[1] for e in edges], dtype="Int64"), "n": np.concatenate([n[some], np.zeros(len(edges), dtype=np.int64)])})
        give_back()

    found = materialize(dealt(full, key).mapInPandas(verify, "a long, b long, n long"), "links")
    discard(tries, *tables)
    members = rows.select("id", "words").join(classes.select("words", "rep", "copies"), "words").select("id", "rep", "copies")
    return members, found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, class_id, n_links, kept for every row of ``docs``.

    Links join documents whose sets of five-word shingles (words as they stand,
    cut at white space) have a Jaccard similarity of 0.8 or more; a text of one
    to four words has one shingle. class_id is the smallest id reachable by links,
    n_links the number of other rows linked, kept whether the row has that id.
    Null, empty and blank texts have no shingle: they link with nothing. Rows
    with a null id have class_id null, no links, and are kept. Rows that repeat
    an id count as copies if their texts agree and share a class anyway.
    """
    members, found = links(docs, id_col, text_col, **how)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    group = components(found.where("b is not null").select("a", "b"))
    per_class = materialize(counts.join(group.withColumnRenamed("id", "rep"), "rep", "full_outer"), "class-links")
    own = members.join(per_class, "rep", "left").groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("class_id"))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(own, F.col("doc_id") == F.col("id"), "left")
    alone = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", alone.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(alone == F.col("doc_id"), F.lit(True)).alias("kept"))
