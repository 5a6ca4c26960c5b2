"""Connected components of a link table by alternating large-star and small-star steps.

Every step is joins and aggregates over links; nothing of the graph is held in
one task or on the driver. Components come out with their smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch_path


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema("u long, v long").parquet(path)


def _join_min(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (u, v) with the least neighbour m of u.

    ``nodes`` is aggregated by u, so a node with very many links meets one row.
    """
    return links.join(nodes, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of links (a, b), longs; self-links name lone ids.

    Large-star: every larger neighbour of u links to u's least neighbour or
    itself. Small-star: u and its smaller neighbours link to the least of them.
    Rounds end when the links no longer change; then every link goes to the root.
    """
    spark = links.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "links"))
        return _store(df, paths[-1])

    now = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.where("u != v").select("u", "v").unionByName(now.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _join_min(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _join_min(large, low)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = keep(small.distinct())
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (found[0], found[1]) == mark:
            break
        mark = (found[0], found[1])
        now = after
    else:
        raise RuntimeError("components did not settle")
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    out = ids.join(after.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    for path in paths[:-1]:
        drop_path(spark, path)
    return out
