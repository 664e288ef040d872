"""Export and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import budgets, exports
from tessera.sources.tables import table


def ris_export(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.md5(exports.ris(F.col("p_name"), F.array("p_brand"), F.col("p_type"), F.col("p_size") + 1990, F.lit(None).cast("string"))).alias("h"))


def head_and_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(budgets.head_and_tail(F.col("text"), 507, "[...]")).alias("h"))


def payload_shares(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"]).withColumn("size", F.length("text"))
    return budgets.fitted_shares(turns, "conv_id", "turn", "size", 2000)


def action_choice(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    rows = turns.select("conv_id", F.col("turn").cast("string").alias("action"), F.length("text").cast("double").alias("score"), words.alias("terms"), (F.col("role") == "user").alias("is_external"))
    return budgets.diverse_actions(rows, "conv_id", 4, 2)


def token_budget_prefix(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", budgets.token_prefix(F.col("text"), F.lit(20)).alias("text"))


QUERIES = {f.__name__: f for f in (ris_export, head_and_tail, payload_shares, action_choice, token_budget_prefix)}
ORACLES = {
    "ris_export": "SELECT p_partkey, md5('TY  - JOUR' || chr(10) || 'TI  - ' || p_name || chr(10) || 'AU  - ' || p_brand || chr(10) || 'JO  - ' || p_type || chr(10) || 'PY  - ' || (p_size + 1990) || chr(10) || 'ER  - ') AS h FROM part",
    "head_and_tail": "SELECT doc_id, md5(CASE WHEN length(text) <= 507 THEN text ELSE substr(text, 1, 376) || '[...]' || right(text, 126) END) AS h FROM documents",
}
