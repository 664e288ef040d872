"""Who may read what and as what, whether a value is borne out by a text, and the plan that a question begins with."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The kinds of memory that each consumer may read, the roles of kinds, and the order in which a synthesis takes roles.
POLICIES = {
    "brainstorm": ["project_fact", "research_step", "failed_route"],
    "research_planner": ["project_fact", "research_step", "verified_claim", "failed_route"],
    "synthesis": ["project_fact", "verified_claim", "research_step", "failed_route"],
}
ROLES = {"research_step": "planning_experience", "verified_claim": "verified_claim_prior", "failed_route": "route_failure_experience"}
CONFIRMED, CONTEXT = "confirmed_project_fact", "project_context"
PRIORITY = [CONFIRMED, "verified_claim_prior", CONTEXT, "planning_experience", "route_failure_experience"]
#: What a required search is expected to gain, the first and the others, and its other marks.
FIRST_GAIN, OTHER_GAIN, NOVELTY, FALSIFIABILITY, COST = 0.9, 0.7, 0.1, 0.8, 0.2

#: What a term of a variant is made of, and an ideograph.
TERM, IDEOGRAPH = "[a-z0-9_./+-]{2,}", "[一-鿿]"


def allowed(memories: DataFrame, consumer: str, kinds: list[str] | None = None) -> DataFrame:
    """The rows of memories(kind, ...) that a consumer may read, of ``kinds`` alone if they are given; asking for others is an error."""
    if consumer not in POLICIES:
        raise ValueError(f"no consumer {consumer}")
    refused = sorted(set(kinds or []) - set(POLICIES[consumer]))
    if refused:
        raise ValueError(f"{consumer} may not read {', '.join(refused)}")
    return memories.where(F.col("kind").isin(kinds or POLICIES[consumer]))


def as_context(memories: DataFrame, consumer: str, kinds: list[str] | None = None) -> DataFrame:
    """What a consumer may read, with its role, its place in each query, and the mark that it is no evidence.

    Rows: query_id, id, kind, category, origin, score. A fact that is a verified
    claim of a run is confirmed, any other context. Places go by score, for a
    synthesis by role first; ties to the smaller id.
    """
    confirmed = (F.col("category") == "verified_research_claim") & (F.col("origin") == "research_run")
    role = F.when(F.col("kind") == "project_fact", F.when(confirmed, CONFIRMED).otherwise(CONTEXT))
    for kind, name in ROLES.items():
        role = role.when(F.col("kind") == kind, name)
    rows = allowed(memories, consumer, kinds).withColumn("role", role).withColumn("evidence_eligible", F.lit(False))
    first = [F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("role"))] if consumer == "synthesis" else []
    by = Window.partitionBy("query_id").orderBy(*first, F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(by))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """The text in its compatible form (NFKC), case folded."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def evidence_key(folded: Column) -> Column:
    """Letters, digits and ideographs of a folded text, without words for versions before a number."""
    bare = F.regexp_replace(folded, r"(\b(version|ver|v)|版本)\s*(?=[0-9])", "")
    return F.regexp_replace(bare, r"[^a-z0-9㐀-鿿]", "")


def supported(value: Column, evidence: Column) -> Column:
    """Whether a text bears a value out: it holds it as it is, or in the form of its key; an empty key isn't borne out."""
    v, e = compatible(value), compatible(evidence)
    key = evidence_key(v)
    return F.coalesce(F.contains(e, v) | ((key != "") & F.contains(evidence_key(e), key)), F.lit(False))


def variant_terms(text: Column) -> Column:
    """The distinct terms of a text: Latin ones of two characters or more, pairs of neighbouring ideographs, and ideographs that stand alone."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"{TERM}|{IDEOGRAPH}+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike(IDEOGRAPH) & (F.length(r) > 1), pairs(r)).otherwise(F.array(r)))))


def base_plan(subqueries: DataFrame, key: str) -> DataFrame:
    """(key, place, action_id, query, gain, novelty, falsifiability, cost): the searches that a question requires, one for each of subqueries(key, place, query); the first promises most."""
    gain = F.when(F.col("place") == 1, FIRST_GAIN).otherwise(OTHER_GAIN)
    return subqueries.select(key, "place", F.concat(F.lit("required-q"), "place").alias("action_id"), "query", gain.alias("gain"), F.lit(NOVELTY).alias("novelty"), F.lit(FALSIFIABILITY).alias("falsifiability"), F.lit(COST).alias("cost"))


def supplements(message: Column, searches: Column, followups: Column, internal: str) -> Column:
    """The message, unless it is an internal prompt, then searches and follow-ups, each once."""
    own = F.when(message.startswith(internal), F.array().cast("array<string>")).otherwise(F.array(message))
    return F.array_distinct(F.concat(own, searches, followups))


def right_wins(left: Column, right: Column) -> Column:
    """Two maps as one; keys of both have the right one's value, also where it is null."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
