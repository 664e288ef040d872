"""Queries of policies, support, variant terms and first plans over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import policy as P
from tessera.sources.tables import table

_KIND = "CASE event_id % 4 WHEN 0 THEN 'project_fact' WHEN 1 THEN 'research_step' WHEN 2 THEN 'verified_claim' ELSE 'failed_route' END"
_CATEGORY = "CASE WHEN event_type = 'view' THEN 'verified_research_claim' ELSE event_type END"
_ORIGIN = "CASE WHEN event_id % 3 = 0 THEN 'research_run' ELSE 'user' END"


def memory_contexts(spark, sf_dir):
    """Events as memories of users: what a synthesis may read, in which role and order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.expr(_KIND).alias("kind"), F.expr(_CATEGORY).alias("category"), F.expr(_ORIGIN).alias("origin"), F.col("value").alias("score"))
    return P.as_context(e, "synthesis", ["project_fact", "verified_claim", "failed_route"]).select("query_id", "id", "role", "evidence_eligible", F.col("place").cast("bigint").alias("place"))


def material_support(spark, sf_dir):
    """Whether a part's brand and type, written otherwise, are borne out by its label."""
    p = table(spark, sf_dir, "part")
    label = F.concat_ws(" / ", "p_name", F.upper("p_brand"), F.regexp_replace("p_type", " ", "-"))
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ver "), F.translate("p_brand", "#", " "))).otherwise(F.concat(F.col("p_type"), F.lit("!")))
    return p.select("p_partkey", P.supported(value, label).alias("supported"))


def variant_terms(spark, sf_dir):
    """Distinct terms of part names beside a few ideographs."""
    text = F.concat("p_name", F.lit(" 中文字 A1 单 x中"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(P.variant_terms(text)), "|").alias("terms"))


def base_plans(spark, sf_dir):
    """The sentences of users' turns as the searches that they require."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", "[.]"), lambda s: F.trim(s) != "")).alias("i", "query"))
    rows = turns.select(F.concat_ws(":", "conv_id", "turn").alias("question"), (F.col("i") + 1).cast("bigint").alias("place"), F.trim("query").alias("query"))
    return P.base_plan(rows, "question").groupBy("question").agg(F.count("*").alias("actions"), F.round(F.sum("gain"), 6).alias("gain"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "action_id", "query"))), lambda a: F.concat_ws("=", a["action_id"], a["query"])), "|")).alias("h"))


def map_overrides(spark, sf_dir):
    """Two maps of each order as one, the right one's values first."""
    o = table(spark, sf_dir, "orders")
    left = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("customer"), F.col("o_custkey").cast("string"))
    right = F.create_map(F.lit("status"), F.lower("o_orderstatus"), F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    merged = P.right_wins(left, right)
    return o.select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("settings"))


QUERIES = {f.__name__: f for f in (memory_contexts, material_support, variant_terms, base_plans, map_overrides)}

_ROLE = f"CASE {_KIND} WHEN 'project_fact' THEN CASE WHEN {_CATEGORY} = 'verified_research_claim' AND {_ORIGIN} = 'research_run' THEN '{P.CONFIRMED}' ELSE '{P.CONTEXT}' END WHEN 'verified_claim' THEN 'verified_claim_prior' ELSE 'route_failure_experience' END"
ORACLES = {
    "memory_contexts": f"""WITH r AS (SELECT user_id AS query_id, event_id AS id, value AS score, {_ROLE} AS role FROM events WHERE event_id % 4 <> 1)
SELECT query_id, id, role, FALSE AS evidence_eligible, row_number() OVER (PARTITION BY query_id ORDER BY list_position({P.PRIORITY}, role), score DESC, id) AS place FROM r""",
    "material_support": """SELECT p_partkey, contains(regexp_replace(lower(concat_ws(' / ', p_name, p_brand, p_type)), '[^a-z0-9]', '', 'g'), regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN regexp_matches(translate(p_brand, '#', ' '), '^ *[0-9]') THEN lower(p_brand) ELSE 'ver' || lower(p_brand) END ELSE lower(p_type) END, '[^a-z0-9]', '', 'g')) AS supported FROM part""",
    "variant_terms": """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(p_name), '[a-z0-9_./+-]{2,}'), ['中文', '文字', 'a1', '单', '中']))), '|') AS terms FROM part""",
    "base_plans": """WITH s AS (SELECT conv_id || ':' || turn AS question, list_filter(string_split(text, '.'), lambda x: trim(x) <> '') AS q FROM conversations WHERE role = 'user')
SELECT question, CAST(len(q) AS BIGINT) AS actions, round(0.9e0 + 0.7e0 * (len(q) - 1), 6) AS gain, md5(array_to_string(list_transform(range(1, len(q) + 1), lambda i: 'required-q' || i || '=' || trim(q[i])), '|')) AS h FROM s WHERE len(q) > 0""",
    "map_overrides": "SELECT o_orderkey, 'customer=' || o_custkey || ';day=' || strftime(o_orderdate, '%Y-%m-%d') || ';status=' || lower(o_orderstatus) AS settings FROM orders",
}
