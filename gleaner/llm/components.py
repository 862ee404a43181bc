"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.session_tools import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every vertex ties its larger (else its smaller) neighbours to the smallest around it."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
        )
    return tied.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) of every vertex that is not the smallest of its component.

    ``edges`` has long columns ``u`` and ``v`` without nulls. The number of rounds grows
    with the logarithm of the vertices; each writes the edges it leaves.
    """
    now = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    if now.isEmpty():
        return now.select("u", F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        now = materialize(_star(_star(now, True), False), "stars")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            return now.select("u", F.col("v").alias("component"))
        mark = (row[0], row[1])
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
