"""Markdown tables: found in texts, parsed, typed, and their replicate statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def markdown_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, cells): runs of at least three lines between bars whose second is a rule; row 0 is the header.

    Runs are islands of consecutive lines. Rows are cut or filled with blanks
    to the header's width, which is from 2 to 24.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "body")).where(F.trim("body").rlike(r"^\|.*\|$"))
    by = Window.partitionBy(key).orderBy("line")
    runs = lines.withColumn("run", F.col("line") - F.row_number().over(by))
    own = Window.partitionBy(key, "run").orderBy("line")
    inner = F.regexp_replace(F.trim("body"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit(r"\|"), F.lit("|")))
    rows = runs.withColumn("pos", F.row_number().over(own) - 1).withColumn("cells", cells)
    full = Window.partitionBy(key, "run")
    rows = rows.withColumn("n", F.count("*").over(full)).withColumn("rule", F.max(F.when((F.col("pos") == 1) & F.forall("cells", lambda c: c.rlike(r"^:?-+:?$")), 1).otherwise(0)).over(full)).withColumn("width", F.max(F.when(F.col("pos") == 0, F.size("cells"))).over(full))
    good = rows.where("n >= 3 and rule = 1 and width between 2 and 24 and pos <> 1")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0)))), F.lit(1), F.col("width"))
    numbered = good.withColumn("table_no", F.dense_rank().over(Window.partitionBy(key).orderBy("run")) - 1)
    return numbered.select(key, "table_no", F.when(F.col("pos") == 0, 0).otherwise(F.col("pos") - 1).alias("row_no"), padded.alias("cells"))


def originals(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, digest, first, first_table_no, repeated): each parsed table with the first of all tables of equal cells.

    The digest adds up those of a table's rows with their numbers, so rules,
    blanks around cells and line ends don't count, and no table is gathered.
    The first is that of the smallest key, then number.
    """
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct("row_no", "cells")).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    tables = cells.groupBy(key, "table_no").agg(F.concat_ws(":", F.count("*"), F.sum(row)).alias("digest"))
    first = tables.groupBy("digest").agg(F.min(F.struct(key, "table_no")).alias("f"))
    out = tables.join(first, "digest").select(key, "table_no", "digest", F.col(f"f.{key}").alias("first"), F.col("f.table_no").alias("first_table_no"))
    return out.withColumn("repeated", (F.col("first") != F.col(key)) | (F.col("first_table_no") != F.col("table_no")))


def number(x: Column) -> Column:
    """A number with thousands commas, an exponent or a per cent sign (divided by 100); null otherwise."""
    t = F.replace(F.trim(x), F.lit(","), F.lit(""))
    percent = t.endswith("%")
    plain = F.rtrim(F.regexp_replace(t, "%$", ""))
    value = F.when(plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), plain.try_cast("double"))
    return F.when(percent, value / 100).otherwise(value)


def column_types(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, column_no, name, kind): temporal by name or 80 % of values, else numeric by 80 %, else categorical."""
    long = cells.select(key, "table_no", "row_no", F.posexplode("cells").alias("column_no", "value"))
    head = long.where("row_no = 0").select(key, "table_no", "column_no", F.col("value").alias("name"))
    body = long.where("row_no > 0 and value <> ''")
    share = body.groupBy(key, "table_no", "column_no").agg(F.avg(number(F.col("value")).isNotNull().cast("int")).alias("numeric"), F.avg(F.col("value").rlike(r"^\d{4}-\d{2}(-\d{2})?([T ]|$)").cast("int")).alias("dates"))
    temporal = F.lower("name").rlike("time|date|day|month|year|时间|日期") | (F.coalesce("dates", F.lit(0.0)) >= 0.8)
    kind = F.when(temporal, "temporal").when(F.coalesce("numeric", F.lit(0.0)) >= 0.8, "numeric").otherwise("categorical")
    return head.join(share, [key, "table_no", "column_no"], "left").select(key, "table_no", "column_no", "name", kind.alias("kind"))


def chart_kind(types: DataFrame, key: str) -> DataFrame:
    """(key, table_no, chart): a line over time, a scatter of two numbers, bars of a category, a heat map of many numbers."""
    n = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("temporal", "numeric", "categorical")}
    chart = F.when((F.col("temporal") >= 1) & (F.col("numeric") >= 1), "line").when(F.col("numeric") >= 4, "heatmap").when((F.col("categorical") >= 1) & (F.col("numeric") >= 1), "bar").when(F.col("numeric") >= 2, "scatter").otherwise("table")
    return types.groupBy(key, "table_no").agg(*n.values()).select(key, "table_no", chart.alias("chart"))
