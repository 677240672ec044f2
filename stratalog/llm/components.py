"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    """The number of edges, and two independent 64-bit sums over them that take any order."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.xxhash64("v", F.lit(1), "u").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` to ``(u long, root long)``: each node that is not itself the
    smallest of its component, with that smallest node.

    Every round joins each node with the minimum of its neighbourhood (a hash aggregate that
    combines before the shuffle), so no neighbourhood is ever collected; a hot node's join is one
    that adaptive execution can split. Large-star links all larger neighbours to the minimum,
    small-star links smaller neighbours to it; a round leaves at most as many edges as it found.
    Rounds grow with the logarithm of the component size; each is written to the shared folder and
    the one before it deleted.
    Self loops, repeated and null edges are ignored; an empty input gives an empty result.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        last, edges = edges, written(small.where("u <> v").distinct(), "edges")
        discard(last)
        after = _signature(edges)
        if after == before:
            return edges.select("u", F.col("v").alias("root"))
        before = after
    if before[0]:
        raise RuntimeError("components did not settle")
    return edges.select("u", F.col("v").alias("root"))
