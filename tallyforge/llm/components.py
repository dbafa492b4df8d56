"""Connected components by alternating large-star and small-star steps over an edge table.

Every step is an aggregation to the smallest neighbour, combined in each task before the shuffle, and a join back, so no vertex's
neighbours are ever gathered in one place; a vertex with very many edges is split by Spark's skew-join handling. Each round's edges are
written to the shared folder: the lineage stays short and a lost executor costs one round. Rounds end as soon as the edges are stars around
their smallest vertices, so edges that come as stars cost one count and no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.textcore import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    moved = near.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is the a of another edge: with a > b, each b is then the smallest of its component."""
    upper, lower = F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.explode(F.array(upper, lower)).alias("e")).groupBy("e.v").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (the smallest vertex it reaches) of every vertex of the edges (a, b), itself the smallest excepted."""
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(now):
        now = written(_small_star(_large_star(now)).where(F.col("a") != F.col("b")).distinct(), "edges")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
