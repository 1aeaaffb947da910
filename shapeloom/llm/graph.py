"""Connected components of an edge table by alternating star contractions.

Minima are pre-aggregated per task; nothing but a count and a checksum comes to the driver.
"""
from pyspark.sql import DataFrame, functions as F

from .common import saved


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the component's smallest node.

    After so many `rounds`, if given, roots are what is known by then: nodes of one root are connected, but
    a component may still have several roots.
    """
    e = saved(_down(edges.filter("a <> b")), "edges")
    state = _mark(e)
    while state[0] and rounds != 0:
        rounds = rounds and rounds - 1
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.filter("v > u"), both).select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        e = saved(_down(large.filter("a <> b")), "edges")
        ends = e.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(e, e).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = saved(_down(small.unionByName(ends.select(F.col("u").alias("a"), F.col("m").alias("b")))), "edges")
        now = _mark(e)
        if now == state:
            break
        state = now
    known = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return known.groupBy("node").agg(F.min("root").alias("root"))


def _with_least(rows, edges):
    """rows with m, the least v of their u. The join key differs from the grouping key, so both sides
    are shuffled for the join, and adaptive execution can split a node with very many neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(1)).alias("k"), "m")
    return rows.join(least, F.col("u").bitwiseXOR(F.lit(1)) == F.col("k")).drop("k")


def _down(edges):
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _mark(e):
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
