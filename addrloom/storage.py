"""Tables between the steps of a plan, in the folder that the session's cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and its master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="addrloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write and read back: the next step's plan starts at a table, and lost executors cost no lineage."""
    path = f"{shared_dir(df.sparkSession)}/addrloom/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: neither is sent through the driver, however small its files look."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``, 1, 2, ... in a total order: ranges are numbered, then the rows within them, so no task holds all rows."""
    at, part, before = (f"{name}{x}" for x in ("_at", "_part", "_before"))
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    first, total = [], 0
    for p, n in ranged.groupBy(F.shiftright(at, 33).alias(part)).count().orderBy(part).collect():  # a row a partition
        first.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(first, f"{part} long, {before} long")
    own = ranged.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(starts), part)
    return own.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, part, before)
