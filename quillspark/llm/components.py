"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds: each points every vertex at a
smaller neighbour, and the edges end as stars around each component's smallest
vertex.  A round is a few aggregations and joins on 16-byte rows.  A hub with a
large part of all edges is folded by partial aggregation; in the joins its rows
are a skewed side that adaptive execution splits.  Each round is written to the
shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every vertex with an edge, the smallest vertex it reaches.

    Edges with a null end are ignored; loops make a component of one.  Repeated
    edges and either direction are fine; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole")).filter("whole").drop("whole").distinct()
    path = new_path(spark, "edges")
    now = written(ends, "edges", path)
    loops = now.filter("hi = lo").select("hi", "lo")
    start, state = path, _state(now)
    while state[0]:
        after = new_path(spark, "edges")
        now = written(_small_star(_large_star(now.filter("hi != lo"))), "edges", after)
        if path != start:
            remove(spark, path)
        path, before = after, state
        state = _state(now)
        if state == before:
            break
    stars = now.filter("hi != lo")
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).unionAll(loops.select(F.col("hi").alias("node"), F.col("lo").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
