"""Token-id output: canonical length-limited Huffman coding in independent blocks.

An output folder holds ``codebook`` (a code length per id, from the counts of
all ids) and ``blocks``: Parquet files whose rows are blocks of whole documents
in ascending order of their ids. A block carries its bits, most significant
first, and the bit offset of every 256th id; decoding goes by one table over
all checkpoints of a block at once. Blocks are written and read by Spark alone,
so any shared store serves, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, scratch_path, shuffle_width

STEP = 256
BLOCK_IDS = 1 << 20


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf_at, merged = [], weight
    for level in range(limit):
        if level:
            n = len(merged) // 2
            packages = merged[: 2 * n : 2] + merged[1 : 2 * n : 2]
            both = np.concatenate([weight, packages])
            at = np.argsort(both, kind="stable")
            merged = both[at]
            leaf_at.append(np.cumsum(at < len(weight)))
        else:
            leaf_at.append(np.arange(1, len(weight) + 1))
    take = 2 * len(weight) - 2
    lengths = np.zeros(len(weight), dtype=np.uint8)
    for leaves in reversed(leaf_at):
        if not take:
            break
        own = int(leaves[take - 1])
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, before = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids and the bit offset of every STEP-th of them.

    Neighbouring codes join to words of up to 64 bits first, so only a fourth
    of the ids (half, if codes are longer than 16 bits) is placed one by one.
    """
    joins = 2 if int(lengths.max(initial=0)) <= 16 else 1
    pad = -len(ids) % (1 << joins)
    size, value = np.pad(lengths[ids].astype(np.uint64), (0, pad)), np.pad(codes[ids], (0, pad))
    for _ in range(joins):
        value = value[::2] << size[1::2] | value[1::2]
        size = size[::2] + size[1::2]
    end = np.cumsum(size)
    at, total = end - size, int(end[-1]) if len(end) else 0
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    if total:
        left = value << (np.uint64(64) - size)  # no group of ids is empty
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[starts]] |= np.bitwise_or.reduceat(left >> off, starts)
        low = np.where(off > 0, left << (np.uint64(64) - off & np.uint64(63)), np.uint64(0))
        words[word[starts] + 1] |= np.bitwise_or.reduceat(low, starts)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[:: STEP >> joins].astype(np.int64)


class Decoder:
    """Table-driven decoding of all checkpoints of a block side by side."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max()) if len(lengths) else 0
        #: by the next bits: symbol and, in the low byte, length
        self.table = np.zeros(1 << self.bits, dtype=np.int64)
        codes = canonical_codes(lengths)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spread = 1 << (self.bits - lengths[used].astype(np.int64))
        first = int(codes[used[0]]) << (self.bits - int(lengths[used[0]])) if len(used) else 0
        assert first == 0
        self.table[: spread.sum()] = np.repeat(used << 8 | lengths[used].astype(np.int64), spread)

    def __call__(self, data: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, dtype=np.uint32)
        b = np.frombuffer(data + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at, out = marks.astype(np.int64).copy(), np.empty((STEP, len(marks)), dtype=np.uint32)
        top, shift = len(window) - 1, np.uint32(32 - self.bits)
        for k in range(STEP):
            look = (window[np.minimum(at >> 3, top)] << (at & 7).astype(np.uint32)) >> shift
            found = self.table[look]
            out[k] = found >> 8
            at += found & 255
        return out.T.reshape(-1)[:n]  # past the last id of the last checkpoint nothing counts


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian 16-bit where all fit, else 32-bit, with a leading width byte) of whole texts."""

    def encode(batches):
        from .tokens import encoder

        end = np.array([end_id], dtype="<u4")
        for b in batches:
            for at, some in encoder(tokenizer).many(b.column(1)):
                blobs = []
                for own in some:
                    ids = np.concatenate([own, end])
                    blobs.append(b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + ids.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(blobs)], pa.array(blobs, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id long, ids binary")


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over the whole table; at most a row per id of the vocabulary is gathered."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                own = np.bincount(np.concatenate([_ids(x) for x in pdf["ids"].iloc[start : start + 2000]]))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    rows = tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r[0] for r in rows), default=-1) + 1, dtype=np.int64)
    for i, n in rows:
        out[i] = n
    return out


def write(tokens: DataFrame, path: str, limit: int = 16, block_ids: int = BLOCK_IDS) -> None:
    """Encode a stored table of (doc_id, ids) in ascending doc_id order, null ids first."""
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens), limit)
    codes = canonical_codes(lengths)
    book = pd.DataFrame({"id": np.flatnonzero(lengths), "bits": lengths[lengths > 0].astype(np.int32)})
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = block = 0

        def closed(docs, held):
            ids = np.concatenate(held)
            bits, marks = pack_bits(ids, lengths, codes)
            return pd.DataFrame([(part, block, before, len(ids), [None if pd.isna(d) else int(d) for d in docs], [len(h) for h in held], bits, marks.astype("<u8").tobytes(), zlib.crc32(bits))], columns=names)

        docs, held, n = [], [], 0
        for pdf in batches:
            for doc, blob in zip(pdf["doc_id"].astype("Int64"), pdf["ids"]):
                ids = _ids(blob)
                docs.append(doc)
                held.append(ids)
                n += len(ids)
                if n >= block_ids:
                    yield closed(docs, held)
                    before, block, docs, held, n = before + n, block + 1, [], [], 0
        if docs:
            yield closed(docs, held)

    names = ["part", "block", "ids_before", "n_ids", "doc_ids", "counts", "bits", "marks", "bits_crc32"]
    schema = "part int, block int, ids_before long, n_ids long, doc_ids array<long>, counts array<long>, bits binary, marks binary, bits_crc32 long"
    ordered = tokens.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(encode, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian 32-bit; null without ``with_ids``) of every document of the files."""
    rows = spark.read.schema("id long, bits int").parquet(f"{path}/codebook").collect()  # a row per id of the vocabulary
    lengths = np.zeros(max((r[0] for r in rows), default=-1) + 1, dtype=np.uint8)
    for i, bits in rows:
        lengths[i] = bits
    schema = "part int, block int, ids_before long, n_ids long, doc_ids array<long>, counts array<long>, bits binary, marks binary, bits_crc32 long"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    base = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("base"))

    def decode(batches):
        decoder = Decoder(lengths)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if zlib.crc32(row.bits) != row.bits_crc32:
                    raise ValueError(f"damaged block {row.block} of part {row.part}")
                data = memoryview(decoder(row.bits, np.frombuffer(row.marks, dtype="<u8"), row.n_ids).astype("<u4").tobytes())
                ends = np.cumsum(row.counts)
                starts = ends - row.counts
                ids = [data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"part": row.part, "doc_id": pd.array([None if pd.isna(d) else int(d) for d in row.doc_ids], dtype="Int64"), "at": row.ids_before + starts, "n_tokens": row.counts, "ids_crc32": [zlib.crc32(x) for x in ids], "ids": [bytes(x) for x in ids] if with_ids else None})

    docs = blocks.mapInPandas(decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, write and read back; a row per row of ``docs``.

    Null and empty texts hold the end id alone. Rows that repeat an id follow
    each other in any order; null ids come first. An empty table gives no row.
    """
    tokens = materialize(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    path = scratch_path(docs.sparkSession, "huffman")
    write(tokens, path)
    discard(tokens)
    return read(docs.sparkSession, path, with_ids=False).drop("ids")
