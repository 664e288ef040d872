"""Queries of the extraction and assembly operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import extraction as X
from tessera.operators import assembly as A
from tessera.sources.tables import table


def english_forms(spark, sf_dir):
    mixed = F.concat_ws(" ", "p_name", F.lit("基因突变与 of"), "p_type", F.when(F.col("p_size") % 3 == 0, "免疫治疗").when(F.col("p_size") % 3 == 1, "乳腺癌患者").otherwise("治疗"))
    return table(spark, sf_dir, "part").select("p_partkey", X.english_form(mixed).alias("english"))


def label_expansion(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    labels = p.select(F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" "), F.lower("p_type")).alias("label"))
    return A.expanded(p, labels, "p_partkey", "p_name", "label").select("p_partkey", "expanded", F.size("added").cast("bigint").alias("n"))


def extractive_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.extractive_summary(F.col("text"))).alias("h"))


def keyword_lists(spark, sf_dir):
    text = F.concat(F.lit("Intro\nKeywords: 1. "), F.col("p_name"), F.lit("; Study, "), F.col("p_brand"), F.lit(".; "), F.upper("p_name"), F.lit("\n\nOn machine learning and phages"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.extracted_keywords(text), "|").alias("keywords"))


def message_tasks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    kind = F.col("turn") % 3
    payload = F.when(kind == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("**Do** "), F.col("role")).alias("title")), F.struct(F.lit(None).cast("string").alias("title"))).alias("work_packages")).alias("experiment_agent"))))
    content = F.when(kind == 1, F.concat(F.lit("# Top\nwords\n## Step **"), F.col("turn").cast("string"), F.lit("**\n### 1. Part "), F.col("role"), F.lit(" ##\n## Last\n"))).otherwise(F.concat(F.lit("1) plain "), F.col("role"), F.lit("\nrest")))
    drafts = c.select("conv_id", "turn", "role", F.explode(X.task_drafts(payload, content)).alias("d"))
    return drafts.select("conv_id", "turn", "role", "d.*")


def parser_fallbacks(spark, sf_dir):
    picked = X.first_parsed(json=F.get_json_object("props", "$.k"), kind=F.when(F.col("event_type") == "click", F.lit(" ")).otherwise(F.col("event_type")))
    blank = X.first_parsed(none=F.lit(None).cast("string"), small=F.when(F.col("value") < 50, F.col("event_type")))
    e = table(spark, sf_dir, "events").select("event_id", picked.alias("a"), blank.alias("b"))
    return e.select("event_id", F.col("a.winner").alias("first"), F.col("b.winner").alias("second"), F.array_join("b.failed", ",").alias("failed"))


def recovered_objects(spark, sf_dir):
    text = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```\nbye {"))
    return table(spark, sf_dir, "events").select("event_id", X.recovered(text).alias("r")).select("event_id", "r.format", F.get_json_object("r.value", "$.k").cast("bigint").alias("k"))


def _facts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("x"))
    payload = F.to_json(F.struct(
        F.struct(F.concat(F.lit(" order  "), F.col("l_orderkey").cast("string")).alias("scientific_question"), F.transform("x", lambda r: r["l_returnflag"]).alias("predictions")).alias("question_agent"),
        F.struct(F.transform("x", lambda r: F.struct(F.concat(F.lit("part "), r["l_partkey"].cast("string")).alias("title"), r["l_linestatus"].alias("purpose"), F.array(r["l_returnflag"]).alias("evidence_ids"))).alias("work_packages")).alias("experiment_agent"),
        F.create_map(F.lit("size"), F.size("x")).alias("preference_profile"),
    ))
    return A.payload_facts(rows.select("l_orderkey", payload.alias("payload")), "l_orderkey", "payload")


def payload_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("l_orderkey", F.col("place").cast("bigint").alias("place"), "category", "statement", "field_path", F.array_join("evidence_ids", ",").alias("evidence"), "confidence", "importance")


def session_summaries(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("title"), F.lit(3).alias("turn_number"))
    return A.session_summaries(_facts(spark, sf_dir), s, "l_orderkey").select("l_orderkey", F.md5("summary").alias("h"), F.col("fact_count").cast("bigint").alias("n"))


def context_packs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("# "), F.col("c_name")).alias("summary"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("statement"), F.substring("o_orderpriority", 1, 1).cast("int").alias("importance"), F.lit(1.0).alias("confidence"), F.col("o_orderdate").alias("updated_at"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("item"), F.col("value").alias("score"))
    return A.context_packs(c, o, e, "k", 3, 2).select("k", "pack")


def auto_tags(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    papers = p.select(F.col("p_partkey").alias("paper_id"), F.array("p_type", "p_brand", F.lower("p_type")).alias("publication_types"), (F.col("p_size") % 7 == 0).alias("curated"))
    terms = li.groupBy(F.col("l_partkey").alias("paper_id"), F.concat(F.lit("term "), F.col("l_suppkey").cast("string")).alias("label")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("major"))
    assets = p.select(F.col("p_partkey").alias("paper_id"), F.when(F.col("p_size") > 25, "user_pdf").alias("source"), F.when(F.col("p_size") % 2 == 0, "fulltext_xml").otherwise("abstract").alias("depth"))
    old = p.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "pdf_keyword").otherwise("mesh").alias("kind"), F.lit("auto").alias("origin"))
    return A.auto_tags(papers, terms, assets, old)


def audit_trails(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), "o_orderdate")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), "event_type")
    kinds = {"plan": (o.drop("o_orderdate").withColumn("w", F.lit(1)), ["id"]), "action": (e, ["event_type", "id"])}
    return A.audit_trail(kinds, "run").select("run", "kind", F.col("place").cast("bigint").alias("place"), F.get_json_object("record", "$.id").cast("bigint").alias("id"))


def outline_changes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    part = lambda t: F.floor(t / 4).cast("string")
    outline = turns.select("conv_id", F.col("turn").alias("ordinal"), F.concat(F.lit("* "), F.col("role"), F.lit(" "), part(F.col("turn")), F.lit("!")).alias("section_key"), F.when(F.col("turn") > 0, F.concat(F.lit("* user "), part(F.col("turn")), F.lit("!"))).alias("parent_key"), F.col("role").alias("title"))
    old = turns.select("conv_id", F.explode(F.array(F.lit("user-0"), F.lit("old"))).alias("section_key")).distinct()
    return A.outline_changes(outline, old, "conv_id").select("conv_id", "section_key", F.col("ordinal").cast("bigint").alias("ordinal"), "parent_key", "action")


def manuscripts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("draft"), F.array(F.col("o_orderpriority")).alias("evidence_ids"), F.array("o_orderstatus").alias("source_ids"))
    titles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))
    sources = spark.createDataFrame([("F", "f.pdf"), ("O", "o.md")], "source_id string, filename string")
    return A.manuscripts(o, titles, sources, "k").select("k", F.md5("markdown").alias("h"), F.array_join("evidence_ids", ",").alias("evidence"))


def snapshot_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return A.snapshot_sources(d, "source", "text", "doc_id").select("source", "digest", F.col("copies").alias("n"))


def drift_search(spark, sf_dir):
    """From the suppliers of the lowest balances, over the groups by nation that hold most of them."""
    s = table(spark, sf_dir, "supplier")
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct().withColumn("weight", F.lit(0.5))
    node = (F.col("s_suppkey") * 2).alias("id")
    return A.drift(edges, s.select(node, F.col("s_nationkey").alias("community")), s.where("s_acctbal < 1000").select(node), 1, 1000, 3).select("id", "score", "distance")


def direction_records(spark, sf_dir):
    items = F.array(
        F.struct(F.col("p_name").alias("name"), F.lit(" why ").alias("reason"), F.col("p_brand").alias("risks"), F.array(F.lit("https://a"), F.lit("http://b")).alias("urls"), F.lit(None).cast("string").alias("id")),
        F.struct(F.lit(" ").alias("name"), F.lit("x").alias("reason"), F.lit(None).cast("string").alias("risks"), F.array(F.lit("y")).alias("urls"), F.lit("n").alias("id")),
        F.struct(F.lit("T").alias("name"), F.col("p_type").alias("reason"), F.lit("[").alias("risks"), F.array().cast("array<string>").alias("urls"), F.lit(" k ").alias("id")),
    )
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(X.directions(F.to_json(F.struct(items.alias("directions"))))).alias("d"))
    return p.select("p_partkey", "d.title", "d.rationale", "d.direction_id", F.array_join("d.key_risks", ",").alias("risks"), F.array_join("d.web_sources", ",").alias("links"))


def tei_divisions(spark, sf_dir):
    tei = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>1 <b>'), F.col("p_brand"), F.lit("</b></head><p>a  "), F.col("p_name"), F.lit("</p><note>no</note><p/><figure>f</figure></div><div><p>"), F.col("p_type"), F.lit("</p></div><div><head>none</head></div></body></text></TEI>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(X.tei_sections(tei)).alias("s")).select("p_partkey", "s.*")


#: Order lines whose ranks and groups one task sorts: about 4 KB each.
LINES_A_TASK = 100_000


def ablation_groups(spark, sf_dir):
    """Suppliers of each part by quantity, discount and tax as three routes."""
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.count() // LINES_A_TASK + 1
    li = lines.repartition(parts, "l_partkey").groupBy(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("item")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "item"))
    ranks = li.select("query_id", "item", by("q").alias("dense_original"), by("d").alias("fts_english"), by("t").alias("mesh"))
    routes = ranks.select("query_id", "item", F.explode(F.array(*[F.struct(F.lit(r).alias("route"), F.col(r).alias("rank")) for r in ("dense_original", "fts_english", "mesh")])).alias("r")).select("query_id", "item", "r.*")
    reranks = li.where("q > 20").select("query_id", "item", (F.col("d") * 10).alias("relevance"))
    return A.ablations(routes, "item", reranks=reranks, keep=5, parts=parts).select("config", "query_id", "item", F.round("score", 8).alias("score"))


def cache_replay(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("workflow"), F.sha2(F.col("o_orderpriority"), 256).alias("digest"), (F.col("o_orderkey") % 3).alias("revision"))
    stored = table(spark, sf_dir, "nation").select(F.sha2(F.when(F.col("n_nationkey") < 5, "1-URGENT").otherwise("5-LOW"), 256).alias("digest"), F.lit(1).cast("bigint").alias("revision"), F.col("n_nationkey").alias("position"), F.col("n_nationkey").alias("item")).where("item < 8")
    return A.replayed(requests, stored, b"key").select("request_id", "hit", F.col("position").cast("bigint").alias("position"), F.length("token").cast("bigint").alias("size"))


def graph_snapshots(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("id"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("level"))
    return A.graph_snapshot(edges, nodes, groups, 200).select("part", F.col("place").cast("bigint").alias("place"), "id", "other")


QUERIES = {f.__name__: f for f in (english_forms, label_expansion, extractive_summaries, keyword_lists, message_tasks, parser_fallbacks, recovered_objects, payload_facts, session_summaries, context_packs, auto_tags, audit_trails, outline_changes, manuscripts, snapshot_sources, drift_search, direction_records, tei_divisions, ablation_groups, cache_replay, graph_snapshots)}


def _rounds(n: int) -> str:
    """Each round gives every query its next label that adds a word."""
    text = ""
    for i in range(n):
        text += f""", b{i} AS (SELECT k, label, words FROM (SELECT s.k, c.label, c.words, row_number() OVER (PARTITION BY s.k ORDER BY o DESC, lower(c.label), c.label) AS r FROM s{i} s JOIN c ON c.k = s.k WHERE len(list_filter(c.words, lambda w: NOT list_contains(s.known, w))) > 0) t WHERE r = 1),
s{i + 1} AS (SELECT s.k, s.t, CASE WHEN b.k IS NULL THEN s.known ELSE list_concat(s.known, b.words) END AS known, CASE WHEN b.k IS NULL THEN s.added ELSE list_append(s.added, b.label) END AS added FROM s{i} s LEFT JOIN b{i} b ON b.k = s.k)"""
    return text


_LONG = "list_distinct(list_filter(string_split(lower({}), ' '), lambda w: length(w) >= 4))"
_CUES = " OR ".join(f"contains(lower(v), '{c}')" for c in X.CUES)
_FACTS = """x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
f AS (SELECT DISTINCT l_orderkey, -1 AS pos, 'scientific_question' AS category, 'order ' || l_orderkey AS statement, 'question_agent.scientific_question' AS field_path, '' AS evidence, 0.9e0 AS confidence, 1.0e0 AS importance FROM x
 UNION ALL SELECT l_orderkey, min(i), 'prediction', l_returnflag, 'question_agent.predictions[' || min(i) || ']', '', 0.72e0, 0.75e0 FROM x GROUP BY 1, 4
 UNION ALL SELECT l_orderkey, 1000 + min(i), 'work_package', 'part ' || l_partkey || ' — ' || l_linestatus, 'experiment_agent.work_packages[' || min(i) || ']', arg_min(l_returnflag, i), 0.78e0, 0.82e0 FROM x GROUP BY 1, 4
 UNION ALL SELECT l_orderkey, 9000, 'user_preference', 'size: ' || count(*), 'preference_profile.size', '', 1.0e0, 0.95e0 FROM x GROUP BY 1),
facts AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS place FROM f)"""
_DRAFTS = """c AS (SELECT DISTINCT conv_id, turn, role FROM conversations), d AS (
SELECT conv_id, turn, role, 'work_package' AS o, unnest([1, 2]) AS n, unnest(['Do ' || role, '实验工作包 2']) AS title, NULL AS above FROM c WHERE turn % 3 = 0
UNION ALL SELECT conv_id, turn, role, 'markdown_heading', unnest([1, 2, 3]), unnest(['Step ' || turn, 'Part ' || role, 'Last']), unnest([NULL, 'Step ' || turn, NULL]) FROM c WHERE turn % 3 = 1
UNION ALL SELECT conv_id, turn, role, 'whole_message', 1, 'plain ' || role, NULL FROM c WHERE turn % 3 = 2)"""

ORACLES = {
    "english_forms": "SELECT p_partkey, p_name || ' ' || p_type || ' gene mutation ' || CASE p_size % 3 WHEN 0 THEN 'immunotherapy' WHEN 1 THEN 'breast cancer patients' ELSE 'treatment' END AS english FROM part",
    "label_expansion": f"""WITH q AS (SELECT p_partkey AS k, p_name AS t, {_LONG.format('p_name')} AS known FROM part),
n AS (SELECT label, string_split(label, ' ') AS words, {_LONG.format('label')} AS f FROM (SELECT DISTINCT string_split(p_name, ' ')[2] || ' ' || lower(p_type) AS label FROM part) t),
c AS (SELECT * FROM (SELECT k, label, words, list_sum(list_transform(known, lambda w: len(list_filter(f, lambda v: v[1:4] = w[1:4])))) AS o FROM q, n) t WHERE o > 0),
s0 AS (SELECT k, t, known, CAST([] AS VARCHAR[]) AS added FROM q){_rounds(4)}
SELECT k AS p_partkey, concat_ws(' ', t, nullif(array_to_string(added, ' '), '')) AS expanded, CAST(len(added) AS BIGINT) AS n FROM s4""",
    "extractive_summaries": rf"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(flat, '([.!?。！？])["''’”）)\]]*\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM t),
u AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM p),
g AS (SELECT doc_id, trim(s, ' ' || chr(9) || chr(10) || '-•') AS v, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM u),
k AS (SELECT doc_id, v, pos, CASE WHEN {_CUES} THEN 4 ELSE 0 END + CASE WHEN length(v) BETWEEN 100 AND 380 THEN 2 ELSE 0 END + greatest(0, 3 - pos // 6000) AS score FROM g
 WHERE length(v) BETWEEN 70 AND 650 AND NOT regexp_matches(lower(v), '{"|".join(m.replace(".", "[.]") for m in X.FRONT_MATTER)}|({"|".join(X.DATED)})[ ]+[0-9]|doi[ ]*:') AND len(regexp_extract_all(v, '[A-Za-z㐀-鿿]+')) >= 12),
b AS (SELECT doc_id, string_agg(v, ' ' ORDER BY pos) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) AS r FROM k) x WHERE r <= 4 GROUP BY 1),
a AS (SELECT t.doc_id, text, trim(regexp_replace(coalesce(v, left(text, 1400)), '\s+', ' ', 'g')) AS v FROM t LEFT JOIN b ON b.doc_id = t.doc_id),
m AS (SELECT doc_id, text, v, left(v, 1400) AS s, strpos(reverse(left(v, 1400)), ' .') AS d, strpos(reverse(left(v, 1400)), '。') AS e, strpos(reverse(left(v, 1400)), ' ;') AS f FROM a)
SELECT doc_id, md5(CASE WHEN length(v) <= 1400 THEN v WHEN d BETWEEN 1 AND 699 THEN left(s, 1400 - d) WHEN e BETWEEN 1 AND 700 THEN left(s, 1401 - e) WHEN f BETWEEN 1 AND 699 THEN left(s, 1400 - f) ELSE rtrim(s) || '…' END) AS h FROM m""",
    "keyword_lists": "SELECT p_partkey, p_name || '|' || p_brand || '|Bacteriophages|Machine learning' AS keywords FROM part",
    "message_tasks": f"WITH {_DRAFTS} SELECT conv_id, turn, role, title, CASE o WHEN 'work_package' THEN '实验设计 > ' || title WHEN 'whole_message' THEN '完整协调输出' ELSE concat_ws(' > ', above, title) END AS source_section, sha256('v1:' || o || ':' || n || ':' || lower(title)) AS source_key FROM d",
    "parser_fallbacks": "SELECT event_id, CASE WHEN props->>'$.k' IS NOT NULL THEN 'json' WHEN event_type <> 'click' THEN 'kind' END AS first, CASE WHEN value < 50 THEN 'small' END AS second, CASE WHEN value < 50 THEN 'none' ELSE 'none,small' END AS failed FROM events",
    "recovered_objects": "SELECT event_id, 'json' AS format, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "payload_facts": f"WITH {_FACTS} SELECT l_orderkey, place, category, statement, field_path, evidence, confidence, importance FROM facts",
    "session_summaries": f"""WITH {_FACTS}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, category ORDER BY place) AS nth FROM facts),
b AS (SELECT l_orderkey, string_agg(CASE WHEN nth > 1 THEN '' ELSE chr(10) || '## ' || CASE category WHEN 'scientific_question' THEN '科学问题' WHEN 'work_package' THEN '实验工作包' ELSE '用户实验偏好' END || chr(10) END || '- ' || statement, chr(10) ORDER BY place) AS body FROM n WHERE nth <= 8 AND category <> 'prediction' GROUP BY 1)
SELECT o_orderkey AS l_orderkey, md5(concat_ws(chr(10), '# ' || o_orderpriority || chr(10) || chr(10) || '截至第 3 轮的确定性摘要。', body)) AS h, coalesce((SELECT count(*) FROM facts f WHERE f.l_orderkey = o_orderkey), 0) AS n FROM orders LEFT JOIN b ON b.l_orderkey = o_orderkey""",
    "context_packs": """WITH o AS (SELECT o_custkey, '## Facts' || chr(10) || string_agg('- ' || s, chr(10) ORDER BY n) AS t FROM (SELECT o_custkey, 'order ' || o_orderkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority[1] DESC, o_orderdate DESC, 'order ' || o_orderkey) AS n FROM orders) x WHERE n <= 3 GROUP BY 1),
e AS (SELECT user_id, '## Recalled' || chr(10) || string_agg('- ' || s, chr(10) ORDER BY n) AS t FROM (SELECT user_id, 'event ' || event_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, 'event ' || event_id) AS n FROM events) x WHERE n <= 2 GROUP BY 1)
SELECT c_custkey AS k, concat_ws(chr(10) || chr(10), '# ' || c_name, o.t, e.t) AS pack FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""",
    "auto_tags": """WITH t AS (SELECT paper_id, label, row_number() OVER (PARTITION BY paper_id ORDER BY major DESC, label) AS n FROM (SELECT l_partkey AS paper_id, 'term ' || l_suppkey AS label, bool_or(l_returnflag = 'R') AS major FROM lineitem GROUP BY 1, 2) x),
w AS (SELECT paper_id, label AS name, 'mesh' AS kind FROM t WHERE n <= 8 UNION ALL SELECT p_partkey, unnest([p_type, p_brand]), 'publication_type' FROM part UNION ALL SELECT p_partkey, 'User PDF', 'source' FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Open Full Text' ELSE 'Abstract' END, 'evidence_depth' FROM part)
SELECT paper_id, name, kind, 'auto' AS origin FROM w JOIN part ON p_partkey = paper_id WHERE p_size % 7 <> 0
UNION ALL SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN 'pdf_keyword' ELSE 'mesh' END, 'auto' FROM part WHERE p_size % 7 = 0 OR p_size % 3 = 0""",
    "audit_trails": "SELECT o_custkey AS run, 'plan' AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey AS id FROM orders UNION ALL SELECT user_id, 'action', row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id), event_id FROM events",
    "outline_changes": """WITH t AS (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY 1, 2), s AS (SELECT *, role || '-' || (turn // 4) AS slug FROM t),
k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id, slug ORDER BY turn) > 1 THEN slug || '-' || (turn + 1) ELSE slug END AS key FROM s),
u AS (SELECT conv_id, slug, arg_max(key, turn) AS key FROM k GROUP BY 1, 2),
n AS (SELECT k.conv_id, k.key AS section_key, CAST(k.turn AS BIGINT) AS ordinal, CASE WHEN k.turn > 0 THEN u.key END AS parent_key FROM k LEFT JOIN u ON u.conv_id = k.conv_id AND u.slug = 'user-' || (k.turn // 4)),
o AS (SELECT DISTINCT conv_id, unnest(['user-0', 'old']) AS section_key FROM t)
SELECT coalesce(n.conv_id, o.conv_id) AS conv_id, coalesce(n.section_key, o.section_key) AS section_key, ordinal, parent_key, CASE WHEN n.section_key IS NULL THEN 'delete' WHEN o.section_key IS NULL THEN 'insert' ELSE 'update' END AS action FROM n FULL JOIN o ON n.conv_id = o.conv_id AND n.section_key = o.section_key""",
    "manuscripts": """WITH b AS (SELECT o_custkey, string_agg(o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) FILTER (o_orderstatus <> 'P') AS body,
 CASE WHEN bool_or(o_orderstatus IN ('F', 'O')) THEN '## 本地资料来源' || chr(10) || chr(10) || concat_ws(chr(10), CASE WHEN bool_or(o_orderstatus = 'F') THEN '- [SRC:F] f.pdf' END, CASE WHEN bool_or(o_orderstatus = 'O') THEN '- [SRC:O] o.md' END) END AS src FROM orders GROUP BY 1),
e AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY n) AS evidence FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS n FROM orders GROUP BY 1, 2) t GROUP BY 1)
SELECT c_custkey AS k, md5(concat_ws(chr(10) || chr(10), '# ' || c_name, body, src) || chr(10)) AS h, coalesce(evidence, '') AS evidence FROM customer LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN e ON e.o_custkey = c_custkey""",
    "snapshot_sources": "SELECT source, sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "drift_search": """WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 1000 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3), m AS (SELECT s_suppkey * 2 AS id FROM supplier JOIN c USING (s_nationkey)),
f AS (SELECT id, 1.0e0 AS score, 0 AS distance FROM m UNION ALL SELECT DISTINCT l_partkey * 2 + 1, 0.25e0, 1 FROM lineitem JOIN m ON l_suppkey * 2 = id) SELECT id, score, distance FROM f ORDER BY score DESC, id LIMIT 1000""",
    "direction_records": "SELECT p_partkey, p_name AS title, 'why' AS rationale, 'direction-1-' || left(sha256(p_name || chr(10) || ' why '), 12) AS direction_id, p_brand AS risks, 'https://a' AS links FROM part UNION ALL SELECT p_partkey, 'T', p_type, 'k', '[', '' FROM part",
    "tei_divisions": "SELECT p_partkey, unnest([0, 1]) AS ordinal, unnest(['1 ' || p_brand, 'Section 2']) AS title, unnest(['a ' || p_name || chr(10) || chr(10) || 'f', p_type]) AS text FROM part",
    "ablation_groups": f"""WITH l AS (SELECT l_partkey AS query_id, l_suppkey AS item, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1, 2),
r AS ({' UNION ALL '.join(f"SELECT query_id, item, '{r}' AS route, row_number() OVER (PARTITION BY query_id ORDER BY {c} DESC, item) AS rank FROM l" for r, c in (("dense_original", "q"), ("fts_english", "d"), ("mesh", "t")))}),
w(config, route, weight) AS (VALUES {', '.join(f"('{g}', '{r}', {w}e0)" for g, some in A.ABLATIONS.items() for r, w in some.items())}),
f AS (SELECT config, query_id, item, sum(weight / (60 + rank)) AS s FROM r JOIN w USING (route) GROUP BY 1, 2, 3),
b AS (SELECT f.config, f.query_id, f.item, CASE WHEN config = '{A.RERANKED[0]}' THEN 0.65e0 * coalesce(CASE WHEN q > 20 THEN d * 10 END, 0) + (1 - 0.65e0) * s / max(s) OVER (PARTITION BY config, f.query_id) ELSE s END AS s FROM f JOIN l ON l.query_id = f.query_id AND l.item = f.item)
SELECT config, query_id, item, round(s, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY round(s, 12) DESC, item) AS n FROM b) x WHERE n <= 5""",
    "cache_replay": "WITH s AS (SELECT CASE WHEN n_nationkey < 5 THEN '1-URGENT' ELSE '5-LOW' END AS p, n_nationkey AS i FROM nation WHERE n_nationkey < 8) SELECT o_orderkey AS request_id, i IS NOT NULL AS hit, CAST(i AS BIGINT) AS position, length('ev1.' || o_custkey || '.' || i || '.') + 22 AS size FROM orders LEFT JOIN s ON p = o_orderpriority AND o_orderkey % 3 = 1",
    "graph_snapshots": """WITH e AS (SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem ORDER BY 1, 2 LIMIT 200), n AS (SELECT p_partkey * 2 + 1 AS id FROM part WHERE p_partkey * 2 + 1 IN (SELECT dst FROM e) ORDER BY 1 LIMIT 200)
SELECT 'edge' AS part, row_number() OVER (ORDER BY src, dst) AS place, CAST(src AS VARCHAR) AS id, CAST(dst AS VARCHAR) AS other FROM e UNION ALL SELECT 'node', row_number() OVER (ORDER BY id), CAST(id AS VARCHAR), NULL FROM n UNION ALL SELECT 'community', row_number() OVER (ORDER BY n_regionkey DESC, n_name), n_name, CAST(n_regionkey AS VARCHAR) FROM nation""",
}
