"""Operators on records of research work: links, versions, status changes, fusion of sources, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.planning import retry_advice


def tree_parents(terms: DataFrame, key: str, numbers: str, separator: str = ".") -> DataFrame:
    """(child, parent): terms whose tree number is another's less its last part; of terms with one number the largest key has it."""
    each = terms.select(F.col(key).alias("k"), F.explode(numbers).alias("number"))
    owner = each.groupBy("number").agg(F.max("k").alias("parent"))
    up = each.where(F.col("number").contains(separator)).select(F.col("k").alias("child"), F.regexp_replace("number", rf"\Q{separator}\E[^{separator}]*$", "").alias("number"))
    return up.join(owner, "number").where("child <> parent").select("child", "parent").distinct()


def within_scope(edges: DataFrame, scope: DataFrame, key: str = "id") -> DataFrame:
    """Edges (src, dst, ...) of which both ends are in scope(key)."""
    ids = scope.select(key).distinct()
    return edges.join(ids.withColumnRenamed(key, "src"), "src", "left_semi").join(ids.withColumnRenamed(key, "dst"), "dst", "left_semi")


def supported_claims(claims: DataFrame, links: DataFrame, scope: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, weight) of validated links into the scope; no score, or 0, counts 1."""
    valid = links.where("validated").join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return claims.select("claim_id").join(valid, "claim_id").select("claim_id", "chunk_id", F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(1.0)).alias("weight"))


def reference_links(papers: DataFrame, references: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst): papers(id, doi) that refer to another's DOI by references(id, doi), beside links that exist."""
    to = papers.where("doi is not null").select(F.col("id").alias("dst"), F.lower("doi").alias("doi"))
    new = references.select(F.col("id").alias("src"), F.lower("doi").alias("doi")).join(to, "doi").where("src <> dst").select("src", "dst").distinct()
    return new.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def both_ways(relations: DataFrame) -> DataFrame:
    """(owner, other, kind, direction): each relation(source, target, kind) from both of its ends."""
    out = relations.select(F.col("source").alias("owner"), F.col("target").alias("other"), "kind", F.lit("out").alias("direction"))
    return out.union(relations.select("target", "source", "kind", F.lit("in")))


def version_changes(versions: DataFrame, key: str, parent: str, items: str) -> DataFrame:
    """(key, added, removed): each version's items against those of its parent; a first version adds all."""
    old = versions.select(F.col(key).alias("_p"), F.col(items).alias("_old"))
    both = versions.join(old, versions[parent] == old["_p"], "left").withColumn("_old", F.coalesce("_old", F.array().cast(dict(versions.dtypes)[items])))
    return both.select(key, F.array_except(items, "_old").alias("added"), F.array_except("_old", items).alias("removed"))


def edges_at(edges: DataFrame, nodes: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Up to ``limit`` (1 to 500) edges at each of nodes(id), from either end, in order; ties go by the other columns, and an edge that repeats counts once.

    Each task first cuts its own edges to the limit; repeats and other nodes are left out of what remains.
    """
    ends = edges.withColumn("id", F.explode(F.array_distinct(F.array("src", "dst"))))
    by = Window.partitionBy("id").orderBy(*order, *[c for c in edges.columns if c not in order])
    near = ends.withColumn("place", F.dense_rank().over(by)).where(F.col("place") <= max(1, min(limit, 500)))
    return near.distinct().join(nodes, "id", "left_semi")


def top_of_groups(rows: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """The n best of each group by falling score, then key, with their place."""
    by = Window.partitionBy(group).orderBy(F.desc(score), key)
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def rounds(rows: DataFrame, run: str, turn: str, status: str, external: str) -> DataFrame:
    """By run and round: approved, rejected and external rows, and the external ones so far."""
    per = rows.groupBy(run, turn).agg(F.count_if(F.col(status) == "approved").alias("approved"), F.count_if(F.col(status) == "rejected").alias("rejected"), F.count_if(external).alias("external"))
    so_far = Window.partitionBy(run).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("external_so_far", F.sum("external").over(so_far))


def verified(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """(claim_id, ok): a claim holds if it says something, names evidence, and all of it is a candidate of valid signature."""
    known = candidates.groupBy(F.col("evidence_id").alias("_e")).agg(F.bool_or("valid").alias("_valid"))
    named = claims.select("claim_id", F.explode("evidence_ids").alias("_e")).join(known, "_e", "left").groupBy("claim_id").agg(F.bool_and(F.coalesce("_valid", F.lit(False))).alias("_all"))
    said = F.coalesce(F.trim("statement") != "", F.lit(False))
    return claims.join(named, "claim_id", "left").select("claim_id", (said & F.coalesce("_all", F.lit(False))).alias("ok"))


def fused(rows: DataFrame, key: str, provider: str, precedence: list[str], first: list[str], largest: list[str], any_true: list[str], order: Column) -> DataFrame:
    """One row a key from several providers: values of ``first`` from the first provider in order of precedence that has one (then by ``order``), the largest of others, OR of flags."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, precedence)), F.col(provider)).cast("int"), F.lit(0))
    rank = F.when(rank == 0, len(precedence) + 1).otherwise(rank)
    out = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(rank, F.col(provider), order))).alias(c) for c in first]
    out += [F.max(c).alias(c) for c in largest] + [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_true]
    return rows.groupBy(key).agg(*out, F.array_sort(F.collect_set(provider)).alias("providers"))


def superseded(facts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Facts(fact_id, status) of which replacements(old_id, new_id) name a newer one, by its smallest key: their status is superseded."""
    by = replacements.groupBy(F.col("old_id").alias("fact_id")).agg(F.min("new_id").alias("superseded_by"))
    return facts.join(by, "fact_id", "left").withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def soft_deleted(rows: DataFrame, key: str, parent: str, doomed: DataFrame, at: Column) -> DataFrame:
    """Rows with deleted_at, set on those in doomed(key) and on their children, unless it is set."""
    ids = doomed.select(F.col(key).alias("_d")).distinct()
    hit = rows.join(ids, F.col(key) == F.col("_d"), "left").withColumn("_own", F.col("_d").isNotNull()).drop("_d").join(ids, F.col(parent) == F.col("_d"), "left")
    return hit.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_own") | F.col("_d").isNotNull(), at))).drop("_own", "_d")


def recovered(jobs: DataFrame, active: list[str], reason: str) -> DataFrame:
    """Jobs(status, error) that were active when the process ended are failed, for a reason."""
    was = F.col("status").isin(active)
    return jobs.withColumn("error", F.when(was, F.lit(reason)).otherwise(F.col("error"))).withColumn("status", F.when(was, "failed").otherwise(F.col("status")))


def unverified(hypotheses: DataFrame, done: DataFrame, by: str, text: str, order: str, limit: int) -> DataFrame:
    """The hypotheses of each ``by`` that aren't verified, compared in lower case, each once in its order, ``limit`` at most."""
    rest = hypotheses.withColumn("_t", F.lower(text)).join(done.select(by, F.lower(text).alias("_t")), [by, "_t"], "left_anti")
    once = rest.groupBy(by, "_t").agg(F.min(F.struct(order, text)).alias("h"))
    return once.select(by, F.col(f"h.{order}").alias(order), F.col(f"h.{text}").alias(text)).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, text))).where(F.col("place") <= limit)


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """Of hits(query_id, chunk_id, score, node) the best of each chunk, ties to the smaller node."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("node")).alias("n"))).alias("b"))
    return best.select("query_id", "chunk_id", F.col("b.score").alias("score"), (-F.col("b.n")).alias("node"))


def report_search(reports: DataFrame, key: str, terms: str, level: str, asked: list[str], limit: int) -> DataFrame:
    """Reports by their share of the asked terms, then by level, both falling, then by key; none without a shared term."""
    question = F.array(*map(F.lit, asked))
    scored = reports.select(key, level, (F.size(F.array_intersect(terms, question)) / len(asked)).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc(level), key).limit(limit)


def boundaries(pairs: DataFrame, by: str, place: str, likeness: str, floor: float, least_drop: float, scale: float) -> DataFrame:
    """Where a text breaks: neighbours whose likeness is under the floor, or under the text's median less the larger of a drop and scaled deviation."""
    centre = pairs.groupBy(by).agg(F.median(likeness).alias("_c"))
    off = pairs.join(centre, by)
    mad = off.groupBy(by).agg(F.median(F.abs(F.col(likeness) - F.col("_c"))).alias("_m"))
    return off.join(mad, by).where((F.col(likeness) <= floor) | (F.col(likeness) <= F.col("_c") - F.greatest(F.lit(least_drop), scale * F.col("_m")))).select(by, place)


def snapshot(results: DataFrame, by: str, order: str, *columns: str, most: int = 200) -> DataFrame:
    """(by, results): the first ``most`` results of a run as one JSON text, for keeping."""
    ranked = results.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most)
    return ranked.groupBy(by).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.struct(*columns).alias("r")))), lambda x: x["r"])).alias("results"))


def merged_items(left: DataFrame, right: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """By group the left side's items, then those of the right side whose key isn't there, ``most`` at most, with their place."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy(by, key).orderBy("_side"))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_side", key))).where(F.col("place") <= most).drop("_side")


def resolved(references: DataFrame, papers: DataFrame, key: str, identifiers: list[str], found: str) -> DataFrame:
    """(key, found, matched_on): the paper of each reference by the first identifier that finds one, the smallest of several."""
    hits = None
    for place, name in enumerate(identifiers):
        to = papers.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_i")).agg(F.min(found).alias(found))
        own = references.select(key, F.col(name).alias("_i")).join(to, "_i").select(key, F.struct(F.lit(place).alias("p"), F.lit(name).alias("name"), F.col(found).alias("id")).alias("h"))
        hits = own if hits is None else hits.union(own)
    return hits.groupBy(key).agg(F.min("h").alias("h")).select(key, F.col("h.id").alias(found), F.col("h.name").alias("matched_on"))


def padded(groups: DataFrame, key: str, have: str, least: int, most: int) -> DataFrame:
    """(key, position): the entries that each group lacks to have ``least`` of them, up to position ``most``."""
    short = groups.where(F.col(have) < min(least, most))
    return short.select(key, F.explode(F.sequence(F.col(have) + 1, F.lit(min(least, most)).cast("bigint"))).alias("position"))


def failed_routes(routes: DataFrame, error: str, hits: str) -> DataFrame:
    """The routes with an error, or without hits, with status and whether to try again."""
    status = F.when(F.col(error).isNotNull(), "failed").when(F.coalesce(F.col(hits), F.lit(0)) == 0, "empty")
    bad = routes.withColumn("status", status).where("status is not null")
    return bad.withColumn("_a", retry_advice(F.col(error), F.col("status"))).withColumn("retryable", F.col("_a.retryable")).withColumn("advice", F.col("_a.advice")).drop("_a")
