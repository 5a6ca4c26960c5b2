"""Shared helpers: shared-folder tables, safe columns, bounded samples."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and its master is local (tests) a temporary
    folder is set; on a cluster a missing name is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="addrloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/addrloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def give_back() -> None:
    """Return memory that a worker's allocators hold unused: workers are kept for the tasks to come."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table._scratch)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table by the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: names of an operator's own can't clash with them."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def share_limit(n: int, bound: int) -> int:
    """Hashes below this long number are about ``bound`` of ``n`` evenly spread 64-bit hashes, however large n is."""
    return (1 << 63) - 1 if n <= bound else -(1 << 63) + (1 << 64) * bound // n


def stratified_sample(df: DataFrame, key: str, order: str, bound: int) -> DataFrame:
    """``bound`` rows of each ``key``, those with the smallest hashes of ``order``; all of a smaller one.

    The counts cover all rows. A limit on the hash leaves slightly more rows than
    the bound (by six standard errors), whatever their number; of these the first
    are taken, so that a key has its bound in full and no more. The number of keys
    must be small (languages, labels): their counts pass through the driver.
    Rows with a null key are left out.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().collect()
    if not counts:
        return df.limit(0)
    limit = F.lit(None).cast("long")
    for value, n in counts:
        limit = F.when(F.col(key) == F.lit(value), F.lit(share_limit(n, bound + math.ceil(6 * bound**0.5)))).otherwise(limit)
    own, place = free_name(df, "_hash"), free_name(df, "_place")
    drawn = df.withColumn(own, F.xxhash64(F.lit(7), F.col(order))).where(F.col(key).isNotNull() & (F.col(own) <= limit))
    return drawn.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(own, order))).where(F.col(place) <= bound).drop(own, place)


def sampled_rows(rows: DataFrame, sample: DataFrame, key: str, bound: int) -> DataFrame:
    """Rows whose key is in a sample of at most ``bound`` rows, which is small enough to be sent to every task."""
    return rows.join(F.broadcast(sample.limit(bound)), key)
