"""Connected components of a link table by alternating large-star and small-star joins.

Links are rows (a long, b long). Rounds are joins and partial minima, staged in the shared folder; the driver sees
two numbers a round. A hub's rows are split by adaptive skew handling, and minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(links: DataFrame, stage: Stage, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that links reach, for each node that has a link."""
    edges = stage.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}0")
    mark = _mark(edges)
    for turn in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage.put(small.filter("u <> v").distinct(), f"{name}{turn}")
        stage.drop(f"{name}{turn - 1}")
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
