"""Record linkage and merge, upserts, retention: rows in, rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_key(pmid: Column, doi: Column, pmcid: Column, title: Column, year: Column) -> Column:
    """The first identifier there is, else title and year."""
    given = lambda name, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(name + ":"), F.lower(F.trim(c))))
    return F.coalesce(given("pmid", pmid), given("doi", doi), given("pmcid", pmcid), F.concat(F.lit("title:"), F.lower(F.trim(title)), F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))))


def merge_records(rows: DataFrame, key: str, order: str, longest: list[str], first: list[str], any_true: list[str], lists: list[str]) -> DataFrame:
    """One row a key: the longest of some columns, the first value of others, OR of flags, distinct members of lists in order."""
    length = lambda c: F.struct(F.coalesce(F.length(c), F.lit(-1)), (-F.col(order)))
    columns = [F.max_by(c, length(c)).alias(c) for c in longest]
    columns += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    columns += [F.bool_or(c).alias(c) for c in any_true]
    columns += [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"]))).alias(c) for c in lists]
    return rows.groupBy(key).agg(F.min(order).alias("first_seen"), F.count("*").alias("n_records"), *columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Sources with the same columns as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Existing rows, and the new ones whose keys aren't there: of each key the first by ``order``, then by all columns."""
    rest = [F.col(order)] if order else []
    first = Window.partitionBy(*keys).orderBy(*rest, *[c for c in new.columns if c not in keys], *keys)
    new = new.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def overwrite(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of both sides the row of the largest version of each key."""
    by = Window.partitionBy(*keys).orderBy(F.desc("_version"), F.desc("_side"))
    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1))).withColumn("_version", F.col(version))
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "_side", "_version")


def stale_or_missing(items: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """Items that the index lacks or holds with another digest: what an incremental run has to do."""
    have = index.select(key, F.col(digest).alias("_have"))
    return items.join(have, key, "left").where(F.col("_have").isNull() | ~F.col("_have").eqNullSafe(F.col(digest))).drop("_have")


def priority_link(rows: DataFrame, targets: DataFrame, keys: list[str], row_id: str, target_id: str) -> DataFrame:
    """(row_id, target_id, matched_on): each row's target by the first key that finds one, an equi-join a key.

    Of a key's targets only the smallest meets the rows, so that a row has a match a key at most.
    """
    least = lambda k: targets.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(target_id).alias(target_id))
    found = union_all([rows.where(F.col(k).isNotNull()).select(row_id, k).join(least(k), k).select(row_id, target_id, F.lit(k).alias("matched_on"), F.lit(i).alias("p")) for i, k in enumerate(keys)])
    best = found.groupBy(row_id).agg(F.min(F.struct("p", target_id, "matched_on")).alias("b"))
    return best.select(row_id, F.col(f"b.{target_id}").alias(target_id), F.col("b.matched_on").alias("matched_on"))


def expired(rows: DataFrame, deleted_at: str, days: Column, now: Column) -> DataFrame:
    """Rows deleted at least ``days`` ago."""
    return rows.where(F.col(deleted_at).isNotNull() & (F.col(deleted_at) <= now - F.make_dt_interval(days)))
