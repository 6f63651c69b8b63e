"""Connected components by alternating large and small stars; nothing is collected, and each turn ends in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), component being its least node; empty without edges.

    Nodes with many edges are split by AQE: each turn joins the edges with one row for each node.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.filter("a <> b").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
