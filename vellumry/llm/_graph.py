"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (those above it for large, those below it for small) to its least neighbour."""
    # aggregated first and joined back: a centre of very many nodes is one row a task, and its edges can be split
    w = pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))
    if large:
        return w.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = w.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return down.unionByName(w.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node of its component. Nodes without an edge are absent; loops are ignored.

    Each round aggregates and joins the edge list twice and ends in a written table; stars need two rounds, paths of
    length n about log n.
    """
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = _fingerprint(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).distinct()
        e = written(_star(large, False).filter("u > v").distinct(), "edges")
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    labels = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return labels.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
