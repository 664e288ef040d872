"""Document fingerprints: threshold-scaled sketches, with Spark SQL functions only.

A sketch holds every shingle hash of a text that lies below a fixed fraction
of the range of hashes, so its size follows the text's. Two sketches of one
fraction can be compared, however unequal the texts are, and the sketch of
joined texts is the union of theirs: the share of common hashes estimates
likeness (of the union) or containment (of one of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle.
SHINGLE = 5
#: A hash is the first 15 hexadecimal digits of an MD5; those whose first digit is below this one are kept: a quarter.
BELOW = "4"
#: Ranges of keys that a shuffle partition gets, so that partitions are even.
RANGES = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sketch(text: str) -> Column:
    """struct(digest, sketch) of a text given as SQL: a digest of its word sequence, and the kept hashes in order.

    Words are runs without white space, A-Z lower-cased; fewer than SHINGLE
    words are one shingle, no words none. Null is as an empty text.
    """
    digit = "transform(filter({hashes}, h -> h < '" + BELOW + "'), h -> cast(conv(substr(h, 1, 15), 16, 10) as bigint))"
    hashes = f"""CASE WHEN size(w) = 0 THEN cast(array() as array<string>)
      WHEN size(w) < {SHINGLE} THEN array(md5(array_join(w, ' ')))
      ELSE transform(sequence(1, size(w) - {SHINGLE - 1}), i -> md5(array_join(slice(w, i, {SHINGLE}), ' '))) END"""
    words = f"filter(split(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), r'[\\x09-\\x0D\\x20]+'), x -> x <> '')"
    # the words are bound to a name, so that they are cut once
    return F.expr(f"transform(array({words}), w -> named_struct('digest', substr(md5(array_join(w, ' ')), 1, 16), 'sketch', array_sort(array_distinct({digit.format(hashes=hashes)}))))[0]")


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a.getField("sketch"), b.getField("sketch")))


def likeness(a: Column, b: Column) -> Column:
    """Of two texts, 0 to 1: the share of common shingles among all of both; 1 for equal word sequences, 0 for empty sketches."""
    both = common(a, b)
    every = F.size(a.getField("sketch")) + F.size(b.getField("sketch")) - both
    return F.when(a.getField("digest") == b.getField("digest"), 1.0).when(every == 0, 0.0).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    """How much of the first text is in the second, 0 to 1; 1 for equal word sequences, 0 for an empty sketch."""
    own = F.size(a.getField("sketch"))
    return F.when(a.getField("digest") == b.getField("digest"), 1.0).when(own == 0, 0.0).otherwise(common(a, b) / own)


def fingerprint(a: Column) -> Column:
    """A sketch as a string: the digest, a colon, and 15 hexadecimal digits a hash."""
    return F.concat(a.getField("digest"), F.lit(":"), F.array_join(F.transform(a.getField("sketch"), lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), ""))


def merged(sketches: DataFrame, by: str, sketch: str = "sketch") -> DataFrame:
    """(by, hash): the sketch of all texts of a group, a row for each hash, so that no group is gathered."""
    return sketches.select(by, F.explode(F.col(sketch).getField("sketch")).alias("hash")).distinct()


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint): the fingerprint of each row; null texts count as empty."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).withColumn("s", sketch("t"))
    return rows.select(F.col("k").alias(key), fingerprint(F.col("s")).alias("fingerprint"))


def _numbers(values: list[int]) -> str:
    return f"transform(filter(split('{','.join(map(str, values))}', ','), x -> x <> ''), x -> cast(x as bigint))"


def in_ranges(rows: DataFrame, key: str) -> DataFrame:
    """rows with (range, tail): each in its range of keys, descending, and the first row of each range also as the tail of the one before.

    The first of all comes behind the last. Keys differ; null is the last.
    The bounds are keys, RANGES for each shuffle partition.
    """
    n = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx(key, cuts, 20 * n).alias("cuts"), F.max(key).alias("top")).first()
    bounds = sorted({*(found["cuts"] or []), *([found["top"]] if found["top"] is not None else [])}, reverse=True)
    m = max(1, int(len(bounds) ** 0.5))
    # how many bounds are not below the key: first by every m-th bound, then among the m behind that
    rough = F.expr(f"size(filter({_numbers(bounds[::m])}, b -> b >= k))")
    fine = F.expr(f"size(filter(slice({_numbers(bounds)}, greatest(rough - 1, 0) * {m} + 1, {m}), b -> b >= k))")
    placed = rows.withColumn("k", F.col(key)).withColumn("rough", F.when(F.col("k").isNull(), F.lit(len(bounds[::m]))).otherwise(rough))
    placed = placed.withColumn("range", F.when(F.col("k").isNull(), F.lit(len(bounds))).otherwise(F.greatest(F.col("rough") - 1, F.lit(0)) * m + fine))
    first = F.when(F.col("range") > 0, F.col("k") == F.expr(f"get({_numbers(bounds)}, range - 1)"))
    before = F.when(F.col("range") == 1, F.lit(len(bounds))).otherwise(F.col("range") - 1) if bounds else F.col("range")
    tail = F.coalesce(first, F.lit(not bounds))
    places = F.when(tail, F.array(F.struct(F.col("range"), F.lit(False).alias("tail")), F.struct(before.alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("tail"))))
    return placed.withColumn("places", places).drop("k", "rough", "range").select("*", F.inline("places")).drop("places")


def edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited, contained_next).

    A document's edited text has its last floor(n_chars / 2) code points
    replaced by the first as many, or all, of the next document by descending
    key; the first follows the last. ``near_*`` are likenesses of its
    fingerprint to the edited text's and to the next document's, ``contained_*``
    how much of it is in them. Null texts count as empty. Rows that repeat a
    key, null included, are one document, with the smallest text; the null key
    is the last. Other columns are left out; no rows give none.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("t").alias("t"))
    # every text is cut up once here and goes through one shuffle, by ranges of keys
    dealt = in_ranges(rows.withColumn("s", sketch("t")), "id")
    order = Window.partitionBy("range").orderBy("tail", F.desc_nulls_last("id"))
    pairs = dealt.select("id", "tail", "t", "s", F.lead("t").over(order).alias("next"), F.lead("s").over(order).alias("next_s")).where("not tail")
    half = F.expr("cast(floor(length(t) / 2) as int)")
    pairs = pairs.withColumn("e", F.concat(F.expr("substr(t, 1, length(t) - cast(floor(length(t) / 2) as int))"), F.substring("next", F.lit(1), half)))
    own, new, other = F.col("s"), F.col("e_s"), F.col("next_s")
    pairs = pairs.select("id", F.length("t").cast("bigint").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "s", "next_s", sketch("e").alias("e_s"))
    return pairs.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, other).alias("near_next"), containment(own, new).alias("contained_edited"), containment(own, other).alias("contained_next"),
    )
