"""All queries of the relational and retrieval families, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import assembly, fulltext, graphs, hybrid, linkage, packing, policies, research, state
from tessera.plans.relational import SQL, TABLES
from tessera.sources.tables import table


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if t in text}
        for name, df in used.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: two lexical rankings and a dense one, fused."""
    return hybrid.QUERIES["weighted_rrf"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _sql_query(text if isinstance(text, str) else text[0]) for name, text in SQL.items()}
    for family in (hybrid, fulltext, linkage, graphs, packing, research, assembly, state, policies):
        found |= family.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items()}
    for family in (hybrid, fulltext, linkage, graphs, packing, research, assembly, state, policies):
        found |= family.ORACLES
    return found
