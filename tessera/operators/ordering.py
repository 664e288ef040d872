"""Numbering of whole tables without sending them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import kept


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the given order; ties of all of ``order`` fall as they happen to.

    Rows are range-partitioned and sorted, and each partition's rows are
    numbered; only a count a partition is added up across partitions.
    """
    part, at = "\u0001part", "\u0001at"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the partitions must not be dealt out anew between the two reads
    dealt = kept(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))  # a row a partition
    return dealt.join(F.broadcast(before), part).withColumn(name, F.col("before") + F.col(at) + 1).drop(part, at, "before")


def interleaved(rows: DataFrame, source: str, order: list[str], name: str = "place") -> DataFrame:
    """The first row of each source, then the second of each, and so on, with places from 1."""
    place, least = "\u0001place", "\u0001least"
    one = numbered(rows, [source, *order], place)
    first = one.groupBy(F.col(source).alias("\u0001source")).agg(F.min(place).alias(least))
    turn = one.join(first, F.col(source).eqNullSafe(F.col("\u0001source"))).withColumn(place, F.col(place) - F.col(least)).drop(least, "\u0001source")
    return numbered(turn, [place, source], name).drop(place)
