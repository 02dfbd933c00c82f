"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm.text import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def tasks_for(rows: int, per_task: int = 100_000) -> int:
    """Tasks for a small table: with one per shuffle partition, files would outnumber rows."""
    return 1 + rows // per_task


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; loops are ignored.

    Only minima per node are gathered, so a node with very many edges does not meet in one task;
    the joins back are plain equi-joins that may be split. Each round is cut off from its past.
    """
    edges = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    before = None
    edges = edges.coalesce(tasks_for(edges.count()))
    for _ in range(max_rounds):
        now = _mark(edges)
        if now == before or not now[0]:
            break
        before, few = now, tasks_for(now[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").coalesce(few).distinct().coalesce(few))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
