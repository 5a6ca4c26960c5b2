"""The feedback log as a stream: overrides stay up to date, one retraining a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import COLUMNS, latest, ranked_overrides

SCHEMA = "row_ord long, " + ", ".join(f"{c} string" for c in COLUMNS)


def append(rows: DataFrame, path: str) -> None:
    """Append feedback (with row_ord) to the log folder."""
    rows.select(*(F.col(c.split()[0]) for c in SCHEMA.split(", "))).write.mode("append").parquet(path)


def follow(spark: SparkSession, log: str, ref: DataFrame, out: str, checkpoint: str, retrain: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Fold each batch of the log into a table of overrides (one folder a batch); then retrain once.

    A folder keeps with each answer its pass and its place in the log, so the
    table says the same as ``overrides`` of the whole log, however it is cut.
    Feedback that comes while a batch runs waits for the next one, so any number
    of rows leads to one run.
    """

    def fold(batch: DataFrame, number: int) -> None:
        ranked_overrides(batch, ref).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        if retrain:
            retrain(batch, number)

    stream = spark.readStream.schema(SCHEMA).parquet(log)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_FOLDED = "key string, reference_id string, pass int, row_ord long, batch int"


def current(spark: SparkSession, out: str) -> DataFrame:
    """key, reference_id as the whole log up to now gives them."""
    return latest(spark.read.schema(_FOLDED).parquet(out)).select("key", "reference_id")


def compact(spark: SparkSession, out: str, into: str) -> None:
    """One row a key in a new folder, for a log of many batches; the stream then goes on beside it."""
    latest(spark.read.schema(_FOLDED).parquet(out)).coalesce(1).write.parquet(into)
