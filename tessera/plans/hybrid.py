"""Retrieval, text and vector queries over the supplied tables, with SQL counterparts where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import index, memory, retrieval as R, routing, vectors
from tessera.operators.chunking import chunk, markdown_sections, select_context
from tessera.sources.tables import table

#: Three questions, as terms; the bounded batch that the registered queries answer.
QUESTIONS = {1: ["the", "ation", "erth"], 2: ["der", "enkeit", "ver"], 3: ["que", "mentou", "license"]}
_VALUES = ", ".join(f"({i}, [{', '.join(repr(t) for t in ts)}])" for i, ts in QUESTIONS.items())


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS.items()), "query_id int, terms array<string>")


def _index(spark, sf_dir, analyser="latin"):
    return index.stored(table(spark, sf_dir, "documents"), "doc_id", "text", analyser)


def _asked(spark):
    return questions(spark).select("query_id", F.array_join("terms", " ").alias("text"))


def bm25_topk(spark, sf_dir):
    return index.search(_index(spark, sf_dir), _asked(spark), 50)


_BM25 = f"""
WITH q AS (SELECT query_id, unnest(terms) AS term FROM (VALUES {_VALUES}) v(query_id, terms)),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))) AS score
      FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY 1, 2)"""
_BM25_TOP = _BM25 + ", t AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s), b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM t)"


_COVER = ", c0 AS (SELECT query_id, doc_id, round(count(DISTINCT term) / CAST(3 AS DOUBLE), 6) AS score FROM tf JOIN q USING (term) GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c0)"


def routes(spark, sf_dir):
    lexical = bm25_topk(spark, sf_dir).select("query_id", F.lit("bm25").alias("route"), "doc_id", "rank")
    covered = R.ranked(index.coverage(_index(spark, sf_dir), _asked(spark)), "doc_id", 50).select("query_id", F.lit("coverage").alias("route"), "doc_id", "rank")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.where(F.col("doc_id").isin(*QUESTIONS)).select(F.col("doc_id").cast("int").alias("query_id"), "embedding")
    near = R.dense(rows, asked, "doc_id", "embedding", 50).select("query_id", F.lit("dense").alias("route"), "doc_id", "rank")
    return lexical.unionByName(covered).unionByName(near)


WEIGHTS = {"bm25": 1.0, "coverage": 0.8, "dense": 0.9}
_DENSE = """, d0 AS (SELECT CAST(a.vec_id AS INT) AS query_id, v.vec_id AS doc_id, list_sum(list_transform(list_zip(a.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings a, embeddings v WHERE a.vec_id IN (1, 2, 3)),
d AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d0)"""
_ROUTES = _BM25_TOP + _COVER + _DENSE + """, r AS (SELECT query_id, 'bm25' AS route, doc_id, rank FROM b WHERE rank <= 50 UNION ALL SELECT query_id, 'coverage', doc_id, rank FROM c WHERE rank <= 50 UNION ALL SELECT query_id, 'dense', doc_id, rank FROM d WHERE rank <= 50)"""


def weighted_rrf(spark, sf_dir):
    fused = R.rrf(routes(spark, sf_dir), "doc_id", WEIGHTS)
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), "n_routes")


def plain_rrf(spark, sf_dir):
    return R.rrf(routes(spark, sf_dir), "doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"))


def _fused(spark, sf_dir):
    fused = R.rrf(routes(spark, sf_dir), "doc_id", WEIGHTS).withColumn("score", F.round("score", 9))
    return fused.join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")


_FUSED = _ROUTES + ", f0 AS (SELECT query_id, doc_id, round(sum(CASE route WHEN 'bm25' THEN 1.0e0 WHEN 'coverage' THEN 0.8e0 ELSE 0.9e0 END / (60 + rank)), 9) AS score, count(*) AS n_routes FROM r GROUP BY 1, 2), f AS (SELECT query_id, doc_id, score, source, n_chars FROM f0 JOIN documents USING (doc_id))"


def rerank_blend(spark, sf_dir):
    scored = _fused(spark, sf_dir).withColumn("rerank", (F.col("n_chars") % 97).cast("double"))
    return R.rerank(scored, "doc_id", 0.5, 20).select("query_id", "doc_id", F.round("blended", 6).alias("blended"), F.col("rank").cast("bigint").alias("rank"))


def journal_prior(spark, sf_dir):
    scored = _fused(spark, sf_dir).withColumn("importance", F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 11) / 10.0))
    return R.prior(scored, 0.1).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def diverse_anchors(spark, sf_dir):
    fused = R.rrf(routes(spark, sf_dir), "doc_id", WEIGHTS).withColumn("score", F.round("score", 9))
    pool = R.ranked(fused, "doc_id", 40).join(table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content")), "doc_id")
    return R.anchors(pool, "doc_id", "source", "content", limit=8, per_group=2, pool_size=40)


def _turn_anchors(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").dropDuplicates(["conv_id", "turn"])
    return turns, turns.where("role = 'user'").select(F.lit(1).alias("query_id"), "conv_id", "turn")


def context_neighbors(spark, sf_dir):
    turns, anchors = _turn_anchors(spark, sf_dir)
    return R.neighbours(anchors, turns.drop("role"), "conv_id", "turn", 1).select("conv_id", "anchor", "turn", "role", F.col("distance").cast("bigint").alias("distance"))


def context_budget(spark, sf_dir):
    turns, anchors = _turn_anchors(spark, sf_dir)
    found = R.neighbours(anchors, turns.drop("role"), "conv_id", "turn", 1).withColumn("size", F.length("text"))
    return R.within_budget(found, ["conv_id"], ["anchor", "distance", "turn"], "size", 2000, "turn")


def query_aware_neighbors(spark, sf_dir):
    turns, anchors = _turn_anchors(spark, sf_dir)
    found = R.neighbours(anchors, turns.drop("role"), "conv_id", "turn", 2).withColumn("asked", F.array(*map(F.lit, QUESTIONS[1])))
    return R.query_aware(found, "text", "asked", 0.02, 2, "conv_id", "turn").select("conv_id", "anchor", "turn", "role", F.round("score", 6).alias("score"))


def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(v, asked, "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_scope_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(v.where("label = 1"), asked, "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_DENSE_TOP = """SELECT query_id, vec_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(a.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM embeddings a, embeddings v WHERE a.vec_id % 100 = 0 {scope}) s) t WHERE rank <= 10"""


def _ann(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    lists = vectors.inverted_file(v, "vec_id", "embedding")
    probes = vectors.probes_for(lists, v, "vec_id", "embedding", 10, 0.95)
    return v, asked, vectors.probed(lists, asked, "embedding", 10, probes)


def ann_topk(spark, sf_dir):
    """The ten best of each query among the lists that it probes."""
    return _ann(spark, sf_dir)[2]


def ann_recall(spark, sf_dir):
    """Whether the inverted file finds nine of ten true neighbours, over all queries."""
    v, asked, found = _ann(spark, sf_dir)
    per = vectors.recall(found, vectors.exact(v, asked, "vec_id", "embedding", 10), "vec_id")
    return per.agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_neighbours"), (F.avg("recall") >= 0.9).alias("reached"))


def ir_metrics(spark, sf_dir):
    """Rankings of the lexical route against the documents labelled good."""
    ranking = bm25_topk(spark, sf_dir).select("query_id", F.col("doc_id").alias("item"), "rank")
    gold = ranking.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item")), "item", "left_semi").select("query_id", "item")
    out = R.ir_metrics(ranking, gold, 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("query_id", "hit")], "hit")


def fact_conflicts(spark, sf_dir):
    """Pairs of documents with Jaccard similarity 0.55 or more of their words, of documents of four different words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("t"))
    return memory.similar_pairs(docs, "doc_id", "t", 0.55, 4)


def memory_hybrid_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("vec_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = e.join(v, "vec_id").crossJoin(F.broadcast(q))  # one row
    parts = rows.select("event_id", F.greatest(T.dot(F.col("embedding"), F.col("q")), F.lit(0.0)).alias("dense"), ((F.col("event_id") % 5) / 5.0).alias("lexical"), F.least(F.lit(1.0), F.col("value") / 100).alias("importance"), T.recency(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts")).alias("recency"))
    return memory.hybrid_score(parts).select("event_id", F.round("score", 5).alias("score"), F.size("routes").alias("n_routes"))


def memory_mmr(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pool = R.dense(v, asked, "vec_id", "embedding", 80).join(v.select("vec_id", "embedding"), "vec_id")
    return memory.mmr(pool, "vec_id", "embedding", 8)


def chunk_documents(spark, sf_dir):
    return chunk(table(spark, sf_dir, "documents"), "doc_id", "text")


def markdown_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Top\n"), "text", F.lit("\n## Part\nx\n### Deep\ny\n## Next\nz")).alias("text"))
    return markdown_sections(docs, "doc_id", "text").groupBy("path").agg(F.countDistinct("doc_id").alias("n"))


def markdown_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Summary\n"), "text", F.lit("\n## Methods\nthe ation\n## Results\nerth")).alias("text"))
    return select_context(docs, "doc_id", "text", QUESTIONS[1], 800)


def term_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.terms(F.col("text"))).cast("bigint").alias("n_terms"))


def language_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_tag(F.col("text")).alias("tag"))


def text_normalised(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalised(F.col("text"))).alias("h"))


def inverted_index_to_text(spark, sf_dir):
    """Words with their positions, and back: the round trip of an inverted index."""
    # dealt out as texts, so that words and places are gathered where they stand
    words = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at"))
    flat = index.select("doc_id", "word", F.explode("at").alias("pos")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return flat.select("doc_id", F.md5(F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("h"))


def evidence_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence_token(b"example", F.lit("w1"), F.col("doc_id").cast("string")).alias("token"))


def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col("doc_id").cast("string")).alias("uuid"))


#: What is put behind users' turns, by number, so that each kind of question comes up.
ENDINGS = ["", "latest systematic review", "the past 5 years", "in patients versus others", "compared with B; and the outcome of it", "mechanism and pathway", "sample size", "方法学 流程", "why and how does it differ"]


def _users_questions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.pmod(F.length("text") + F.col("turn"), F.lit(len(ENDINGS))) + 1).cast("int"))
    return turns.withColumn("text", F.concat_ws(" ", "text", ending))


def question_router(spark, sf_dir):
    """Users' turns as questions: type, confidence, reasons and strategy."""
    out = routing.routed(_users_questions(spark, sf_dir), "text")
    return out.select("conv_id", "turn", "question_type", F.round("confidence", 2).alias("confidence"), F.array_join("reasons", ",").alias("reasons"), "strategy")


def question_parts(spark, sf_dir):
    """Their sub-queries: how many of each focus."""
    out = routing.subqueries(routing.routed(_users_questions(spark, sf_dir), "text"), "text")
    return out.where("focus <> 'clause'").groupBy("question_type", "focus").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("characters"))


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, weighted_rrf, plain_rrf, rerank_blend, journal_prior, diverse_anchors, context_neighbors, context_budget, query_aware_neighbors, dense_topk, dense_scope_filtered, ann_topk, ann_recall, ir_metrics, fact_conflicts, memory_hybrid_score, memory_mmr, chunk_documents, markdown_paths, markdown_context,
              term_sets, language_tags, text_normalised, inverted_index_to_text, evidence_tokens, uuid5_ids, question_router, question_parts)
}

_IPAD, _OPAD = (bytes(b ^ p for b in b"example".ljust(64, b"\0")).hex() for p in (0x36, 0x5C))


def greedy_sql(pool: str, limit: int, per_group: int, pool_size: int) -> str:
    """SQL of the greedy choice over a pool (query_id, doc_id, source, c, rank): the fold, a rank a step."""
    room = f"len(items) < {limit} AND NOT list_contains(contents, p.c) AND len(list_filter(sources, lambda x: x = p.source)) < {per_group}"
    return f"""steps AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS items, CAST([] AS VARCHAR[]) AS sources, CAST([] AS VARCHAR[]) AS contents FROM {pool}
  UNION ALL
  SELECT s.query_id, s.step + 1, CASE WHEN {room} THEN list_append(items, p.doc_id) ELSE items END, CASE WHEN {room} THEN list_append(sources, p.source) ELSE sources END, CASE WHEN {room} THEN list_append(contents, p.c) ELSE contents END
  FROM steps s JOIN {pool} p ON p.query_id = s.query_id AND p.rank = s.step + 1 WHERE s.step < {pool_size}),
ended AS (SELECT query_id, max_by(items, step) AS items, max_by(sources, step) AS sources FROM steps GROUP BY query_id),
chosen AS (SELECT query_id, CAST(i AS INTEGER) AS position, items[i] AS doc_id, sources[i] AS source FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM ended) e)"""


ORACLES: dict[str, str] = {
    "bm25_topk": _BM25_TOP + " SELECT query_id, doc_id, score, rank FROM b WHERE rank <= 50",
    "weighted_rrf": _FUSED + " SELECT query_id, doc_id, score, n_routes FROM f0",
    "plain_rrf": _ROUTES + " SELECT query_id, doc_id, round(sum(1.0e0 / (60 + rank)), 9) AS score FROM r GROUP BY 1, 2",
    "diverse_anchors": _FUSED.replace("WITH q AS", "WITH RECURSIVE q AS", 1) + """, p AS (SELECT f.query_id, f.doc_id, f.source, sha256(d.text) AS c, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.doc_id) AS rank FROM f JOIN documents d USING (doc_id))
, """ + greedy_sql("p", 8, 2, 40) + " SELECT query_id, position, doc_id, source FROM chosen",
    "rerank_blend": _FUSED + """, o AS (SELECT *, CAST(n_chars % 97 AS DOUBLE) AS rr, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS old FROM f),
h AS (SELECT *, min(score) OVER w AS s0, max(score) OVER w AS s1, min(rr) OVER w AS r0, max(rr) OVER w AS r1 FROM o WINDOW w AS (PARTITION BY query_id, old <= 20)),
g AS (SELECT query_id, doc_id, old, CASE WHEN old <= 20 THEN 0.5e0 * (CASE WHEN s1 = s0 THEN 1 ELSE (score - s0) / (s1 - s0) END) + 0.5e0 * (CASE WHEN r1 = r0 THEN 1 ELSE (rr - r0) / (r1 - r0) END) ELSE score END AS blended FROM h)
SELECT query_id, doc_id, round(blended, 6) AS blended, row_number() OVER (PARTITION BY query_id ORDER BY old <= 20 DESC, CASE WHEN old <= 20 THEN blended END DESC NULLS LAST, old) AS rank FROM g""",
    "journal_prior": _FUSED + " SELECT query_id, doc_id, round(0.9e0 * score + 0.1e0 * max(score) OVER (PARTITION BY query_id) * coalesce(CASE WHEN n_chars % 3 > 0 THEN (n_chars % 11) / 10.0e0 END, 0), 9) AS score FROM f",
    "context_neighbors": """WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations), a AS (SELECT conv_id, turn FROM t WHERE role = 'user')
SELECT a.conv_id, a.turn AS anchor, t.turn, CASE WHEN t.turn = a.turn THEN 'anchor' ELSE 'neighbor' END AS role, abs(t.turn - a.turn) AS distance FROM a JOIN t ON t.conv_id = a.conv_id AND abs(t.turn - a.turn) <= 1""",
    "context_budget": """WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations), a AS (SELECT conv_id, turn FROM t WHERE role = 'user'),
f AS (SELECT a.conv_id, t.turn, t.size, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn, abs(t.turn - a.turn), t.turn) AS k FROM a JOIN t ON t.conv_id = a.conv_id AND abs(t.turn - a.turn) <= 1),
s AS (SELECT conv_id, k, turn, size, TRUE AS took, size AS used FROM f WHERE k = 1
  UNION ALL SELECT f.conv_id, f.k, f.turn, f.size, s.used + f.size <= 2000, CASE WHEN s.used + f.size <= 2000 THEN s.used + f.size ELSE s.used END FROM s JOIN f ON f.conv_id = s.conv_id AND f.k = s.k + 1)
SELECT conv_id, turn, size FROM s WHERE took""",
    "query_aware_neighbors": f"""WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./+-]{{2,}}')) AS w FROM conversations), a AS (SELECT conv_id, turn AS anchor FROM t WHERE role = 'user'),
f AS (SELECT a.conv_id, anchor, t.turn, abs(t.turn - anchor) AS d, len(list_intersect(w, {QUESTIONS[1]})) / 3.0e0 AS o FROM a JOIN t ON t.conv_id = a.conv_id AND abs(t.turn - anchor) <= 2),
g AS (SELECT conv_id, anchor, turn, CASE WHEN d = 0 THEN 'anchor' ELSE 'neighbor' END AS role, CASE WHEN d = 0 THEN 1e9 ELSE o + 0.03e0 / d END AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, anchor, role ORDER BY score DESC, turn) AS n FROM g WHERE score >= 0.02e0)
SELECT conv_id, anchor, turn, role, round(score, 6) AS score FROM r WHERE role = 'anchor' OR n <= 2""",
    "markdown_paths": "SELECT unnest(['Top', 'Top > Part', 'Top > Part > Deep', 'Top > Next']) AS path, count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL",
    "dense_topk": _DENSE_TOP.format(scope=""),
    "dense_scope_filtered": _DENSE_TOP.format(scope="AND v.label = 1"),
    "ann_recall": f"SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, TRUE AS reached FROM ({_DENSE_TOP.format(scope='')}) z",
    "language_tags": r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3400}-\x{9fff}]') AND regexp_matches(text, '[A-Za-z]{2,}') THEN 'mixed' WHEN regexp_matches(text, '[\x{3400}-\x{9fff}]') THEN 'zh' ELSE 'en' END AS tag FROM documents",
    "term_sets": r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_./+-]{2,}'))) AS BIGINT) AS n_terms FROM documents",
    "text_normalised": r"SELECT conv_id, turn, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM conversations",
    "inverted_index_to_text": "SELECT doc_id, md5(text) AS h FROM documents",
    "memory_hybrid_score": """SELECT event_id, round(0.45e0 * d + 0.2e0 * l + 0.2e0 * i + 0.15e0 * r, 5) AS score, CAST((d > 0.05) AS INT) + CAST((l > 0.05) AS INT) + CAST((i > 0.05) AS INT) + CAST((r > 0.05) AS INT) AS n_routes FROM (
  SELECT event_id, greatest(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 0.0e0) AS d, (event_id % 5) / 5.0e0 AS l, least(1.0e0, value / 100) AS i, 1 / (1 + floor(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts))) / 86400.0e0 / 30) AS r
  FROM events JOIN embeddings v ON user_id = v.vec_id JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ON TRUE) t""",
}


def _router_sql() -> str:
    """The kinds from whole words and parts; what is put behind the turns is the same."""
    hit = {}
    for kind, (reason, words, parts) in routing.MARKERS.items():
        tests = ["regexp_matches(q, '\\b(" + "|".join(words) + ")\\b')", *[f"contains(q, '{p}')" for p in parts]]
        hit[kind] = "(" + " OR ".join(tests + [f"regexp_matches(q, '{y}')" for y in (routing.YEARS if kind == "latest_progress" else [])]) + ")"
    n = " + ".join(f"CAST({k}_hit AS INT)" for k in hit)
    reasons = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k}_hit THEN '{routing.MARKERS[k][0]}' END" for k in hit) + "], lambda x: x IS NOT NULL), ',')"
    deep, parts = (", ".join(f"'{k}'" for k in kinds) for kinds in (routing.DEEP, routing.IN_PARTS))
    return f"""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text || CASE WHEN e = '' THEN ' ' ELSE ' ' || e END, '\\s+', ' ', 'g')) AS question FROM (SELECT *, {ENDINGS}[(length(text) + turn) % {len(ENDINGS)} + 1] AS e FROM conversations WHERE role = 'user') c),
h AS (SELECT *, {", ".join(f"{x} AS {k}_hit" for k, x in hit.items())} FROM (SELECT *, lower(question) AS q FROM u) l),
k AS (SELECT *, {n} AS n, CASE {" ".join(f"WHEN {k}_hit THEN '{k}'" for k in hit)} ELSE 'general' END AS question_type FROM h),
r AS (SELECT conv_id, turn, question, question_type, round(CASE WHEN n = 0 THEN 0.55e0 ELSE least(0.97e0, 0.72e0 + 0.08e0 * n) END, 2) AS confidence, CASE WHEN n = 0 THEN 'no_specialized_marker' ELSE {reasons} END AS reasons,
  CASE WHEN question_type IN ({deep}) THEN 'deep_research' WHEN question_type IN ({parts}) OR (question_type = 'mechanism' AND (comparison_hit OR length(question) > 180)) THEN 'decomposition' ELSE 'direct' END AS strategy FROM k)"""


def _parts_sql() -> str:
    rows = ", ".join(f"('{k}', {i + 2}, '{f}', ' {w}')" for k, parts in routing.ASPECTS.items() for i, (f, w) in enumerate(parts.items()))
    return _router_sql() + f""", a(kind, place, focus, words) AS (VALUES {rows})
SELECT question_type, focus, count(*) AS n, CAST(sum(length(query)) AS BIGINT) AS characters FROM (
  SELECT question_type, 'original' AS focus, question AS query FROM r WHERE strategy = 'direct' UNION ALL SELECT question_type, 'core', question FROM r WHERE strategy <> 'direct'
  UNION ALL SELECT question_type, focus, question || words FROM r JOIN a ON kind = question_type WHERE strategy <> 'direct' AND place <= 4) z GROUP BY 1, 2"""


ORACLES |= {
    "question_router": _router_sql() + " SELECT conv_id, turn, question_type, confidence, reasons, strategy FROM r",
    "question_parts": _parts_sql(),
    "uuid5_ids": """SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab89ab89ab89ab'[strpos('0123456789abcdef', h[17:17])] || h[18:20] || '-' || h[21:32] AS uuid FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents) t""",
    "evidence_tokens": f"""SELECT doc_id, 'ev1.w1.' || doc_id || '.' || rtrim(translate(to_base64(from_hex(substr(h, 1, 32))), '+/', '-_'), '=') AS token FROM (
  SELECT doc_id, sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode('w1:' || doc_id)))) AS h FROM documents) t""",
    "fact_conflicts": """WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS s FROM documents), u AS (SELECT s, min(doc_id) AS id, list(doc_id) AS m FROM t WHERE len(s) >= 4 GROUP BY s)
SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) / CAST(len(list_distinct(list_concat(x.s, y.s))) AS DOUBLE) AS similarity FROM u x JOIN u y ON x.id < y.id AND len(x.s) >= 0.55 * len(y.s) AND len(y.s) >= 0.55 * len(x.s)) p WHERE similarity >= 0.55
UNION ALL SELECT id, b, 1.0e0 FROM (SELECT id, unnest(m) AS b FROM u WHERE len(m) > 1) z WHERE id <> b""",
    "ir_metrics": _BM25_TOP + """, r AS (SELECT query_id, doc_id AS item, rank FROM b WHERE rank <= 50), g AS (SELECT query_id, item FROM r WHERE item IN (SELECT doc_id FROM labels WHERE quality = 1)),
m AS (SELECT r.*, CASE WHEN g.item IS NULL THEN 0 ELSE 1 END AS rel FROM r LEFT JOIN g USING (query_id, item)), x AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM m),
a AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS hits, count(*) AS len, sum(CASE WHEN rel = 1 AND rank <= 10 THEN seen / CAST(rank AS DOUBLE) ELSE 0 END) AS ap, min(CASE WHEN rel = 1 THEN rank END) AS fst, sum(CASE WHEN rel = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(rel) AS ng FROM x GROUP BY 1)
SELECT query_id, round(hits / CAST(ng AS DOUBLE), 6) AS recall, round(hits / CAST(least(10, len) AS DOUBLE), 6) AS precision, CAST(hits > 0 AS INT) AS hit, round(ap / least(ng, 10), 6) AS average_precision, round(1.0e0 / fst, 6) AS reciprocal_rank, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= ng), 6) AS ndcg FROM a WHERE ng > 0""",
}
