"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each vertex of ``edges(a, b)`` with the smallest vertex that it reaches.

    Each round links a vertex's larger neighbours to its smallest neighbour
    (large star), then its smaller ones (small star); edges never grow in
    number beyond one a vertex and neighbour, and the rounds are about the
    logarithm of the diameter. Each round's edges are written as a table, whose
    small files Spark reads together.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(e)
    while before[0]:
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # of a vertex's edges that to the smallest one stays, and the others' ends get one to it
        e = written(large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        now = _mark(e)
        if now == before:
            break
        before = now
    # now every vertex has one edge, to its component
    roots = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components(id, component) after more ``edges(a, b)``: only the components that these join are worked out."""
    ends = edges
    for c in ("a", "b"):
        ends = ends.join(roots.select(F.col("id").alias(c), F.col("component").alias(f"{c}_root")), c, "left")
    more = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = roots.join(more.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return written(moved.select("id", F.coalesce("to", "component").alias("component")).union(more).distinct())
