"""Replicate data for plots: wide tables to long ones, error bars, paired series, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLICATE = r"(?i)^(?:rep(?:licate)?|run|trial|n)[ _-]?[0-9]+$"


def is_replicate(name: str) -> bool:
    """Whether a column's name says that it holds one repetition."""
    import re

    return bool(re.match(REPLICATE, name))


def long_form(wide: DataFrame, group: str, columns: list[str] | None = None) -> DataFrame:
    """(group, replicate, value) of a table with a column for each repetition; missing values are left out."""
    columns = columns or [c for c in wide.columns if is_replicate(c)]
    return wide.unpivot([group], columns, "replicate", "value").where("value is not null")


def error_bars(groups: DataFrame, statistic: str) -> DataFrame:
    """Adds ``error`` to groups(mean, sd, sem, ci_high): the standard deviation, that of the mean, or half the interval; 0 where unknown."""
    if statistic not in ("mean_sd", "mean_sem", "mean_ci95"):
        raise ValueError(f"unknown statistic {statistic}")
    size = {"mean_sd": F.col("sd"), "mean_sem": F.col("sem"), "mean_ci95": F.col("ci_high") - F.col("mean")}[statistic]
    return groups.withColumn("error", F.coalesce(size, F.lit(0.0)))


def paired(rows: DataFrame, unit: str, condition: str, value: str) -> DataFrame:
    """(unit, n, series): the values of units observed under two conditions or more, by condition; a null unit is an error."""
    named = F.when(F.col(unit).isNull(), F.raise_error(F.lit("an observation names no unit"))).otherwise(F.col(unit))
    series = rows.withColumn(unit, named).groupBy(unit, condition).agg(F.avg(value).alias("v")).groupBy(unit).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(condition, "v"))).alias("series"))
    return series.where("n >= 2")


def warnings(groups: DataFrame, by: str, unit: str, most_rows: int = 80) -> DataFrame:
    """(by, warnings): what a reader of groups(by, n) should know: single or few repetitions, technical ones, many groups."""
    per = groups.groupBy(by).agg(F.min("n").alias("least"), F.count("*").alias("groups"))
    said = [F.when(F.col("least") < 2, "single_replicate"), F.when(F.lit(unit == "technical"), "technical_replicates"), F.when(F.col("least") < 3, "few_replicates"), F.when(F.col("groups") > most_rows, "many_rows")]
    return per.select(by, F.filter(F.array(*said), lambda x: x.isNotNull()).alias("warnings"))
