"""Connected components of an edge table, without gathering edges in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.workspace import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (id, label): label is the smallest id that links reach.

    Alternates two steps until nothing changes: every vertex hands its smallest
    neighbour to its larger neighbours, then to its smaller ones.  Each step is
    an aggregation with map-side combining and a join of edges with one row per
    vertex; rounds grow with the logarithm of the longest chain.  An empty edge
    table gives an empty result; loops (a = b) and nulls are ignored.
    """
    pairs = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while True:
        large = _star(pairs, upward=True)
        small = materialize(_star(large, upward=False), "edges")
        # settled: every vertex has one edge, to a vertex that has none downward
        state = small.agg(F.count("*").alias("n"), F.count_distinct("u").alias("us")).first()
        hubs = small.select(F.col("v").alias("u")).distinct().join(small.select("u"), "u", "left_semi").limit(1).count()
        pairs = small
        if state.n == state.us and not hubs:
            break
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("label")).union(pairs.select("v", "v")).distinct()


def _star(pairs: DataFrame, upward: bool) -> DataFrame:
    """One step over edges u > v."""
    if upward:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.where("u <> v").union(least)
    return out.where("u <> v").distinct()
