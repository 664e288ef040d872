"""Queries of the planning, workflow and plot operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.operators import plots, retrieval as R, workflow as W
from tessera.sources.tables import table

IGNORED = ["the", "and", "is", "of", "what", "how"]
PLANNED = ["order", "line", "the", "data", "what", "how", "is"]


def term_lists(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(P.ascii_terms(F.col("text"), IGNORED)), " ").alias("terms"))


def prefix_overlaps(spark, sf_dir):
    """Each turn's words against those of the turn after it."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct()
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("later"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", P.prefix_overlap(F.col("text"), F.col("later")).cast("bigint").alias("n"))


def route_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("reason"), F.when(F.col("value") > 50, "rejected").when(F.col("value") > 20, "empty").otherwise("failed").alias("status"))
    return e.select("event_id", P.retry_advice(F.col("reason"), F.col("status")).alias("a")).select("event_id", "a.*")


def repaired_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.lines_repaired(F.col("text"))).alias("h"))


def clean_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.clean_title(F.concat(F.lit("  3) **"), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("**: ")), F.lit("untitled")).alias("title"))


def budget_formulae(spark, sf_dir):
    tokens = F.col("p_size") * 1000
    return table(spark, sf_dir, "part").select("p_partkey", P.context_characters(tokens, 0.75, 30_000).alias("characters"), P.output_tokens(tokens, 8192).alias("out_tokens"), P.chunks_expected(tokens).alias("chunks"))


def canonical_digests(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", P.canonical_digest(name=F.col("n_name"), key=F.col("n_nationkey")).alias("digest"))


def vector_checks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.coalesce(P.vector_problem(F.col("embedding"), 64), F.lit("usable")).alias("state")).agg(F.count("*").alias("n"))


def _neighbour_likeness(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("label", "vec_id", P.cosine(F.col("embedding"), F.col("next")).alias("cosine"))


def neighbour_cosines(spark, sf_dir):
    return _neighbour_likeness(spark, sf_dir).select("vec_id", F.round("cosine", 5).alias("cosine"))


def topic_breaks(spark, sf_dir):
    rounded = _neighbour_likeness(spark, sf_dir).withColumn("cosine", F.round("cosine", 5))
    return W.boundaries(rounded, "label", "vec_id", "cosine", -0.2, 0.05, 1.5)


def evidence_eligibility(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "table_cell").when(F.col("l_returnflag") == "A", "table").otherwise("figure")
    box = F.when(F.col("l_tax") > 0.02, F.array(F.col("l_tax"))).otherwise(F.array().cast("array<double>"))
    text, cell = F.when(F.col("l_quantity") > 5, "x").otherwise(""), F.when(F.col("l_linestatus") == "O", "A1")
    return l.select("l_orderkey", "l_linenumber", P.may_be_evidence(kind, cell, F.lit("p"), F.lit("c"), F.when(F.col("l_discount") > 0.01, 1), box, text).alias("eligible"))


def plan_relevance(spark, sf_dir):
    asked = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(P.term_share(asked, F.array(*map(F.lit, PLANNED))), 6).alias("share"))


def depth_budgets(spark, sf_dir):
    depth = F.when(F.col("c_mktsegment") == "BUILDING", "quick").when(F.col("c_mktsegment") == "MACHINERY", "deep").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.budget_of(depth).alias("b")).select("c_custkey", "b.rounds", "b.sources", "b.branches", "b.counter_evidence")


def field_completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    return d.select("doc_id", P.completeness(text=F.col("text"), lang=F.col("lang"), source=F.col("source"), quality=F.col("quality")).alias("c")).select("doc_id", F.col("c.share").alias("share"), F.array_join("c.missing", ",").alias("missing"))


def tree_parents(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.array(F.col("r_regionkey").cast("string")).alias("numbers"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint"), F.array(F.concat_ws(".", "n_regionkey", "n_nationkey")))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey") + 1000, F.array(F.concat_ws(".", "n_regionkey", "n_nationkey", "s_suppkey")))
    return W.tree_parents(r.union(n).union(s), "k", "numbers")


def scope_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    scope = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 2).alias("id")).union(table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey") * 2 + 1))
    return W.within_scope(edges, scope)


def supported_claims(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("chunk_id"), (F.col("l_returnflag") != "N").alias("validated"), F.col("l_discount").alias("score"))
    return W.supported_claims(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("claim_id")), links, table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("chunk_id")))


def reference_links(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    papers = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("10.1/S"), "s_suppkey").alias("doi"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat(F.lit("10.1/s"), "l_partkey").alias("doi"))
    return W.reference_links(papers, refs, s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst")))


def relation_sides(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("region "), "n_regionkey").alias("target"), F.lit("part_of").alias("kind"))
    return W.both_ways(n)


def plan_changes(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    v = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("version"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), words.alias("items"))
    return W.version_changes(v, "version", "parent", "items").select("version", F.size("added").cast("bigint").alias("added"), F.size("removed").cast("bigint").alias("removed"))


def node_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    nodes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("id")).union(table(spark, sf_dir, "part").select(F.col("p_partkey") * 2 + 1))
    return W.edges_at(edges, nodes, 5, ["src", "dst"]).select("id", "src", "dst", F.col("place").cast("bigint").alias("place"))


def community_leaders(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return W.top_of_groups(s, "s_nationkey", "s_acctbal", "s_suppkey", 3).select("s_nationkey", "s_suppkey", F.col("place").cast("bigint").alias("place"))


def round_trace(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "rejected").otherwise("approved")
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").cast("bigint").alias("turn"), status.alias("status"), (F.col("value") > 20).alias("external"))
    return W.rounds(e, "user_id", "turn", "status", "external")


def verified_claims(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("evidence_ids"))
    claims = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") != "P", "said").otherwise(" ").alias("statement"), "evidence_ids")
    return W.verified(claims, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), (F.col("p_size") > 5).alias("valid")))


def metadata_fusion(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("provider"), F.when(F.col("l_tax") > 0.03, F.col("l_suppkey")).alias("status"), F.col("l_quantity").alias("citations"), (F.col("l_discount") > 0.09).alias("retracted"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return W.fused(l, "l_partkey", "provider", ["R", "A"], ["status"], ["citations"], ["retracted"], F.col("o")).withColumn("providers", F.array_join("providers", ","))


def superseded_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact_id"), F.lit("active").alias("status"))
    return W.superseded(facts, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("old_id"), F.col("o_orderkey").alias("new_id")))


def cascade_delete(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("parent"), F.when(F.col("s_acctbal") > 9000, F.lit("before")).alias("deleted_at"), "s_acctbal")
    return W.soft_deleted(s, "id", "parent", s.where("s_acctbal < 0").select("id"), F.lit("now")).select("id", "deleted_at")


def recovered_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"))
    return W.recovered(jobs, ["click", "view"], "interrupted")


def open_hypotheses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    out = W.unverified(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderpriority", "o_orderkey", 3)
    return out.withColumn("place", F.col("place").cast("bigint"))


def chunk_hits(spark, sf_dir):
    return W.best_per_chunk(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_discount").alias("score"), F.col("l_orderkey").alias("node")))


def global_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("terms"), "p_size")
    return W.report_search(p, "p_partkey", "terms", "p_size", ["red", "ring", "blue"], 40).select("p_partkey", "p_size", F.round("score", 6).alias("score"))


def run_snapshots(spark, sf_dir):
    return W.snapshot(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey", "o_orderstatus")


def wide_to_long(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"Rep{i}") for i in (1, 2, 3)])
    return plots.long_form(wide, "l_orderkey")


def _replicates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")).withColumn("sem", F.col("sd") / F.sqrt("n")).withColumn("ci_high", F.col("mean") + 2 * F.col("sem"))


def error_bars(spark, sf_dir):
    out = plots.error_bars(_replicates(spark, sf_dir), "mean_sem")
    return out.select("l_partkey", "l_returnflag", F.round("mean", 5).alias("mean"), F.round("error", 5).alias("error"))


def replicate_warnings(spark, sf_dir):
    return plots.warnings(_replicates(spark, sf_dir), "l_partkey", "biological").select("l_partkey", F.array_join("warnings", ",").alias("warnings"))


def paired_series(spark, sf_dir):
    out = plots.paired(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_quantity")
    return out.select("l_partkey", "n", F.array_join(F.transform("series", lambda x: x["l_returnflag"]), ",").alias("conditions"), F.round(F.aggregate("series", F.lit(0.0), lambda s, x: s + x["v"]), 4).alias("total"))


ASKED = ["small", "red", "ring", "economy", "promo"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"))


def metadata_route(spark, sf_dir):
    """Parts by BM25 over name, brand and type, and the lines of each."""
    asked = spark.createDataFrame([(1, ASKED)], "query_id int, terms array<string>")
    docs = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    scores = R.bm25(docs, asked, "p_partkey", "text").withColumn("score", F.round("score", 6))
    return R.fanned_out(scores, _lines(spark, sf_dir), "p_partkey", "chunk_id", 3000)


def label_route(spark, sf_dir):
    """Types of parts by BM25 over their labels, with a bonus for large parts, and the lines of each."""
    asked = spark.createDataFrame([(1, ASKED)], "query_id int, terms array<string>")
    part = table(spark, sf_dir, "part")
    labels = part.select("p_type").distinct().withColumn("label", F.lower("p_type"))
    scores = R.bm25(labels, asked, "p_type", "label").join(part.select("p_partkey", "p_type", "p_size"), "p_type")
    scores = scores.select("query_id", "p_partkey", F.round(F.col("score") + F.when(F.col("p_size") > 25, 0.1).otherwise(0.0), 6).alias("score"))
    return R.fanned_out(scores, _lines(spark, sf_dir), "p_partkey", "chunk_id", 3000)


def route_plans(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    routes = P.planned_routes(F.regexp_extract("text", r"10\.[0-9]{4,}/[^ ]+", 0), F.size(words) > 0, F.col("text").rlike("[0-9]"), F.when(F.col("role") == "user", F.array(F.lit("original"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(routes, ",").alias("routes"))


def memory_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.joined_text(F.col("source"), F.col("lang"), F.col("text"), most=12_000)).alias("h"))


def step_importance(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return per.select("l_orderkey", F.round(P.importance(F.col("n")), 6).alias("importance"))


def merged_plans(spark, sf_dir):
    """Each customer's open orders before all of the customer's orders, 12 at most."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return W.merged_items(o.where("o_orderstatus = 'O'"), o.withColumn("o_orderstatus", F.lower("o_orderstatus")), "o_custkey", "o_orderkey", 12).withColumn("place", F.col("place").cast("bigint"))


def year_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return o.groupBy("o_custkey").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"))


def label_vocabulary(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return part.join(line, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_name").alias("label")).distinct().orderBy("label").limit(500)


def import_results(spark, sf_dir):
    """By part the earliest line's flag and the sum of all lines."""
    l = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return l.groupBy("l_partkey").agg(F.min_by("l_returnflag", "o").alias("first_flag"), F.round(F.sum("l_quantity"), 2).alias("total"))


def resolved_references(spark, sf_dir):
    """Customers named by orders through one key, or through another where that one finds none."""
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("pmid"), F.col("o_custkey").alias("doi"))
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pmid"), F.col("c_custkey").alias("doi"))
    return W.resolved(refs, papers, "o_orderkey", ["pmid", "doi"], "id")


def counter_evidence(spark, sf_dir):
    """The entries that each order lacks to have three lines."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return W.padded(per, "l_orderkey", "n", 3, 20)


def compaction_tiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.compaction_tier(F.col("p_size") / 50.0).alias("tier"))


def rolling_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.last_characters(F.concat("text", F.lit(" end")), 40_000)).alias("h"))


def retryable_routes(spark, sf_dir):
    """Events as routes: those that failed or were empty, and whether to try again."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") > 30, "timeout").alias("error"), F.floor("value").alias("hits"))
    return W.failed_routes(e, "error", "hits").select("event_id", "status", "retryable")


_FUNCTIONS = (memory_texts, step_importance, merged_plans, year_ranges, label_vocabulary, import_results, resolved_references, counter_evidence, compaction_tiers, rolling_summaries, retryable_routes, metadata_route, label_route, route_plans, term_lists, prefix_overlaps, route_failures, repaired_lines, clean_titles, budget_formulae, canonical_digests, vector_checks, neighbour_cosines, topic_breaks, evidence_eligibility, plan_relevance, depth_budgets, field_completeness, tree_parents, scope_edges, supported_claims, reference_links,
              relation_sides, plan_changes, node_edges, community_leaders, round_trace, verified_claims, metadata_fusion, superseded_facts, cascade_delete, recovered_jobs, open_hypotheses, chunk_hits, global_search, run_snapshots, wide_to_long, error_bars, replicate_warnings, paired_series)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _any(markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(reason), '{m}')" for m in markers) + ")"


_LIKE = "(SELECT a.label, a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"
_GROUPS = "(SELECT l_partkey, l_returnflag, count(*) AS n, avg(l_quantity) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(l_quantity) END AS sd FROM lineitem GROUP BY 1, 2)"


def _bm25_sql(docs: str) -> str:
    """CTEs up to s(k, score) over docs(k, text)."""
    return f"""tok AS (SELECT k, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM ({docs}) d), st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok),
tf AS (SELECT term, k, dl, count(*) AS tf FROM (SELECT k, len(tokens) AS dl, unnest(tokens) AS term FROM tok) e WHERE term IN ({_quoted(ASKED)}) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT k, sum(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))) AS score FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY 1)"""


_FAN = "c AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, p_partkey, chunk_id) AS pos FROM p JOIN (SELECT l_partkey AS p_partkey, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem) l USING (p_partkey)), o AS (SELECT chunk_id, arg_min(score, pos) AS score, min(pos) AS pos FROM c WHERE pos <= 3000 GROUP BY 1) SELECT 1 AS query_id, chunk_id, score, row_number() OVER (ORDER BY pos) AS rank FROM o"
ORACLES = {
    "memory_texts": "SELECT doc_id, md5(left(array_to_string(list_filter([source, lang, text], lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), chr(10)), 12000)) AS h FROM documents",
    "step_importance": "SELECT l_orderkey, round(least(1, 0.45e0 + 0.08e0 * count(*)), 6) AS importance FROM lineitem GROUP BY 1",
    "merged_plans": "SELECT o_custkey, o_orderkey, o_orderstatus, place FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE lower(o_orderstatus) END AS o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderkey) AS place FROM orders) t WHERE place <= 12",
    "year_ranges": "SELECT o_custkey, CAST(min(year(o_orderdate)) AS INT) AS first_year, CAST(max(year(o_orderdate)) AS INT) AS last_year FROM orders GROUP BY 1",
    "label_vocabulary": "SELECT DISTINCT p_name AS label FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 1 LIMIT 500",
    "import_results": "SELECT l_partkey, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS first_flag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1",
    "resolved_references": "SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS id, CASE WHEN a.c_custkey IS NOT NULL THEN 'pmid' ELSE 'doi' END AS matched_on FROM orders LEFT JOIN customer a ON o_orderstatus <> 'P' AND a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey WHERE coalesce(a.c_custkey, b.c_custkey) IS NOT NULL",
    "counter_evidence": "SELECT l_orderkey, CAST(unnest(range(n + 1, 4)) AS BIGINT) AS position FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) t WHERE n < 3",
    "compaction_tiers": "SELECT p_partkey, CASE WHEN p_size / 50.0e0 < 0.5e0 THEN 0 WHEN p_size / 50.0e0 < 0.7e0 THEN 1 WHEN p_size / 50.0e0 < 0.85e0 THEN 2 ELSE 3 END AS tier FROM part",
    "rolling_summaries": "SELECT doc_id, md5(right(text || ' end', 40000)) AS h FROM documents",
    "retryable_routes": "SELECT event_id, CASE WHEN value > 30 THEN 'failed' ELSE 'empty' END AS status, value > 30 AS retryable FROM events WHERE value > 30 OR floor(value) = 0",
    "metadata_route": f"WITH {_bm25_sql("SELECT p_partkey AS k, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part")}, p AS (SELECT k AS p_partkey, round(score, 6) AS score FROM s), {_FAN}",
    "label_route": f"WITH {_bm25_sql("SELECT DISTINCT p_type AS k, lower(p_type) AS text FROM part")}, p AS (SELECT p_partkey, round(score + CASE WHEN p_size > 25 THEN 0.1e0 ELSE 0 END, 6) AS score FROM s JOIN part ON p_type = k), {_FAN}",
    "route_plans": "SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '10\\.[0-9]{4,}/[^ ]+') THEN 'exact' ELSE array_to_string(list_concat(list_concat(CASE WHEN regexp_matches(lower(text), '[a-z]{3,}') THEN ['fts_english', 'metadata', 'mesh'] ELSE [] END, CASE WHEN regexp_matches(text, '[0-9]') THEN ['simple'] ELSE [] END), CASE WHEN role = 'user' THEN ['dense_original'] ELSE [] END), ',') END AS routes FROM conversations",
    "term_lists": f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_./+-]+'), lambda x: length(x) > 1 AND NOT list_contains([{_quoted(IGNORED)}], lower(x))))), ' ') AS terms FROM conversations",
    "prefix_overlaps": r"""WITH t AS (SELECT DISTINCT conv_id, turn, text FROM conversations), p AS (SELECT *, list_transform(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) >= 4)), lambda w: w[1:4]) AS f FROM t)
SELECT a.conv_id, a.turn, CAST(coalesce(list_sum(list_transform(a.f, lambda x: len(list_filter(b.f, lambda y: y = x)))), 0) AS BIGINT) AS n FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "route_failures": f"""SELECT event_id, NOT (status = 'rejected' OR {_any(P.NOT_RETRYABLE)}) AND {_any(P.RETRYABLE)} AS retryable, CASE WHEN status = 'rejected' OR {_any(P.NOT_RETRYABLE)} THEN 'change_permissions_configuration_or_action' WHEN {_any(P.RETRYABLE)} THEN 'transient_failure_retry_with_backoff' WHEN status = 'empty' THEN 'reformulate_query_or_change_scope' ELSE 'inspect_failure_before_retry' END AS advice
FROM (SELECT event_id, concat_ws(' ', event_type, props) AS reason, CASE WHEN value > 50 THEN 'rejected' WHEN value > 20 THEN 'empty' ELSE 'failed' END AS status FROM events) e""",
    "repaired_lines": r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(replace(text, chr(173), ''), '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\r\n|\n|\r'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS h FROM documents",
    "clean_titles": "SELECT p_partkey, p_name AS title FROM part",
    "budget_formulae": "SELECT p_partkey, greatest(12000, least(30000, CAST(floor(p_size * 1000 * 0.75e0) AS INT))) AS characters, least(8192, greatest(4096, (p_size * 1000) // 4)) AS out_tokens, CAST(greatest(1, ceil(p_size * 1000 / 384.0e0)) AS BIGINT) AS chunks FROM part",
    "canonical_digests": """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS digest FROM nation""",
    "vector_checks": "SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimensions' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' ELSE 'usable' END AS state, count(*) AS n FROM embeddings GROUP BY 1",
    "neighbour_cosines": f"SELECT vec_id, cosine FROM {_LIKE} t",
    "topic_breaks": f"WITH t AS {_LIKE}, c AS (SELECT label, median(cosine) AS c FROM t GROUP BY 1), m AS (SELECT t.label, median(abs(cosine - c)) AS m FROM t JOIN c USING (label) GROUP BY 1) SELECT t.label, vec_id FROM t JOIN c USING (label) JOIN m USING (label) WHERE cosine <= -0.2e0 OR cosine <= c - greatest(0.05e0, 1.5e0 * m)",
    "evidence_eligibility": "SELECT l_orderkey, l_linenumber, l_returnflag IN ('R', 'A') AND l_discount > 0.01e0 AND l_tax > 0.02e0 AND l_quantity > 5 AND (l_returnflag = 'A' OR l_linestatus = 'O') AS eligible FROM lineitem",
    "plan_relevance": f"SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains([{_quoted(PLANNED)}], x))) / CAST(len(w) AS DOUBLE) ELSE 0 END, 6) AS share FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations) t",
    "depth_budgets": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 ELSE 1 END AS rounds, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 10 ELSE 6 END AS sources, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 4 ELSE 2 END AS branches, c_mktsegment = 'MACHINERY' AS counter_evidence FROM customer",
    "field_completeness": """SELECT doc_id, (4 - len(m)) / 4.0e0 AS share, array_to_string(m, ',') AS missing FROM (SELECT d.doc_id, list_filter([CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'text' END, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'lang' END, CASE WHEN source IS NULL OR trim(source) = '' THEN 'source' END, CASE WHEN q IS NULL THEN 'quality' END], lambda x: x IS NOT NULL) AS m
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id) t""",
    "tree_parents": "SELECT CAST(n_nationkey + 100 AS BIGINT) AS child, CAST(n_regionkey AS BIGINT) AS parent FROM nation UNION ALL SELECT s_suppkey + 1000, CAST(s_nationkey + 100 AS BIGINT) FROM supplier",
    "scope_edges": "SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 JOIN part ON p_partkey = l_partkey AND p_size > 10",
    "supported_claims": "SELECT l_orderkey AS claim_id, l_partkey AS chunk_id, CASE WHEN l_discount = 0 THEN 1.0e0 ELSE l_discount END AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'N' AND p_size <= 25",
    "reference_links": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_partkey WHERE l_suppkey <> l_partkey AND l_partkey <> l_suppkey + 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier) UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_partkey WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) AND l_suppkey <> l_partkey",
    "relation_sides": "SELECT n_name AS owner, 'region ' || n_regionkey AS other, 'part_of' AS kind, 'out' AS direction FROM nation UNION ALL SELECT 'region ' || n_regionkey, n_name, 'part_of', 'in' FROM nation",
    "plan_changes": f"WITH v AS (SELECT conv_id * 1000 + turn AS version, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, {_WORDS} AS w FROM (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY 1, 2) t) SELECT a.version, CAST(len(list_filter(a.w, lambda x: NOT list_contains(coalesce(b.w, []), x))) AS BIGINT) AS added, CAST(len(list_filter(coalesce(b.w, []), lambda x: NOT list_contains(a.w, x))) AS BIGINT) AS removed FROM v a LEFT JOIN v b ON a.parent = b.version",
    "node_edges": "SELECT id, src, dst, place FROM (SELECT id, src, dst, row_number() OVER (PARTITION BY id ORDER BY src, dst) AS place FROM (SELECT src AS id, src, dst FROM (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem) e UNION ALL SELECT dst, src, dst FROM (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem) e) u WHERE id IN (SELECT s_suppkey * 2 FROM supplier UNION ALL SELECT p_partkey * 2 + 1 FROM part)) t WHERE place <= 5",
    "community_leaders": "SELECT s_nationkey, s_suppkey, place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) t WHERE place <= 3",
    "round_trace": "SELECT user_id, turn, approved, rejected, external, CAST(sum(external) OVER (PARTITION BY user_id ORDER BY turn) AS BIGINT) AS external_so_far FROM (SELECT user_id, CAST(day(ts) AS BIGINT) AS turn, count(*) FILTER (event_type <> 'click') AS approved, count(*) FILTER (event_type = 'click') AS rejected, count(*) FILTER (value > 20) AS external FROM events GROUP BY 1, 2) t",
    "verified_claims": "SELECT o_orderkey AS claim_id, o_orderstatus <> 'P' AND coalesce(ok, false) AS ok FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(coalesce(p_size > 5, false)) AS ok FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1) t ON o_orderkey = l_orderkey",
    "metadata_fusion": "SELECT l_partkey, arg_min(CASE WHEN l_tax > 0.03e0 THEN l_suppkey END, CASE WHEN l_tax > 0.03e0 THEN CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END * 1000000000000 + l_orderkey * 10 + l_linenumber END) AS status, max(l_quantity) AS citations, bool_or(l_discount > 0.09e0) AS retracted, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS providers FROM lineitem GROUP BY 1",
    "superseded_facts": "SELECT c_custkey AS fact_id, CASE WHEN n IS NULL THEN 'active' ELSE 'superseded' END AS status, n AS superseded_by FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey",
    "cascade_delete": "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 9000 THEN 'before' WHEN s_acctbal < 0 OR s_nationkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'now' END AS deleted_at FROM supplier",
    "recovered_jobs": "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type IN ('click', 'view') THEN 'interrupted' END AS error FROM events",
    "open_hypotheses": "SELECT o_custkey, o_orderkey, o_orderpriority, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority) AS place FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority) GROUP BY 1, 2) t) u WHERE place <= 3",
    "chunk_hits": "SELECT l_suppkey AS query_id, l_partkey AS chunk_id, max(l_discount) AS score, arg_min(l_orderkey, -l_discount * 1000000000 + l_orderkey) AS node FROM lineitem GROUP BY 1, 2",
    "global_search": "SELECT p_partkey, p_size, round(n / 3.0e0, 6) AS score FROM (SELECT p_partkey, p_size, len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring', 'blue'])) AS n FROM part) t WHERE n > 0 ORDER BY score DESC, p_size DESC, p_partkey LIMIT 40",
    "run_snapshots": """SELECT o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS results FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) t WHERE n <= 200 GROUP BY 1""",
    "wide_to_long": "SELECT l_orderkey, 'Rep' || l_linenumber AS replicate, max(l_quantity) AS value FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2",
    "error_bars": f"SELECT l_partkey, l_returnflag, round(mean, 5) AS mean, round(coalesce(sd / sqrt(n), 0), 5) AS error FROM {_GROUPS} t",
    "replicate_warnings": f"SELECT l_partkey, array_to_string(list_filter([CASE WHEN m < 2 THEN 'single_replicate' END, CASE WHEN m < 3 THEN 'few_replicates' END, CASE WHEN g > 80 THEN 'many_rows' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT l_partkey, min(n) AS m, count(*) AS g FROM {_GROUPS} t GROUP BY 1) u",
    "paired_series": f"SELECT l_partkey, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS conditions, round(sum(mean), 4) AS total FROM {_GROUPS} t GROUP BY 1 HAVING count(*) >= 2",
}
