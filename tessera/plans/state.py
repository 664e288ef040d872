"""Queries with state over the event stream, sections of articles, and semantic chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, sections
from tessera.session import shared_folder
from tessera.sources.tables import table
from tessera.streaming import state as S

#: The cache of the registered query: items of each event type, seconds they live.
SIZE, SECONDS, PARTS = 40, 6 * 3600, 4


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def cache_expiry(spark, sf_dir):
    """Each event looks its user up in its type's cache: hits, expiries and misses, over four restarts."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("number"))
    return S.fed(S.slices(e, "ts", PARTS), _folder(spark), lambda s: S.with_state(s, "cache", S.Cache(SIZE, SECONDS), S.Cache.SCHEMA))


def workflow_states(spark, sf_dir):
    """Each user's events as outcomes of steps: the workflow's stage after each, at most two refinements, and steps that aren't allowed."""
    kind = F.expr("CASE WHEN event_id % 23 = 0 THEN 'fatal_error' WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'success' WHEN event_id % 2 = 0 THEN 'needs_refinement' ELSE 'no_results' END")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("workflow"), kind.alias("outcome"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("number"))
    return S.fed(S.slices(e, "ts", PARTS), _folder(spark), lambda s: S.with_state(s, "workflow", S.Workflow(), S.Workflow.SCHEMA))


def memory_index(spark, sf_dir):
    """Documents as a maintained table: all, a third again of which half have changed, some withdrawn, and the last batch delivered twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    first = docs.withColumn("gone", F.lit(False)).withColumn("order", F.lit(1))
    second = docs.where("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))).withColumn("gone", F.lit(False)).withColumn("order", F.lit(1))
    third = docs.where("doc_id % 10 = 0").withColumn("gone", F.lit(True)).withColumn("order", F.lit(1)).union(docs.where("doc_id % 20 = 0").withColumn("gone", F.lit(False)).withColumn("order", F.lit(2)))
    folder = _folder(spark)
    kept = S.Maintained(spark, f"{folder}/index", "doc_id", "doc_id bigint, text string, lang string")
    for i, part in enumerate((first, second, third)):
        part.write.parquet(f"{folder}/in/part={i}")
        kept.run(spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in").drop("part"), f"{folder}/checkpoint")
    kept.apply(third, 2)
    written = kept.changes().where("batch >= 0").groupBy("doc_id").agg(F.count("*").alias("times_written"))
    return kept.table().join(written, "doc_id").select("doc_id", F.md5("text").alias("h"), "batch", "times_written")


def article_paths(spark, sf_dir):
    """Documents as articles with an abstract and nested sections, walked by the table function; every ninth isn't well-formed."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tail = F.when(F.col("doc_id") % 9 == 0, F.lit("</article")).otherwise(F.lit("</article>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.regexp_replace("text", r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}]", "").alias("text"))
    xml = F.concat(F.lit("<article><front><abstract><p>"), F.lit("about "), "lang", F.lit("</p></abstract></front><body><sec><title>"), "source", F.lit("</title><p>"), esc(F.col("text")), F.lit("</p><sec><p>inner</p></sec><sec><title>Notes</title><sec><title>Deep</title><list><item>x</item></list></sec></sec></sec></body>"), tail)
    return sections.sections_of(docs.withColumn("x", xml), "doc_id", "x").groupBy("path", "error").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


def semantic_chunks(spark, sf_dir):
    """Documents in chunks that also end where neighbouring sentences have little in common."""
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", semantic=True)


def chunk_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.chunk_tokens(F.col("text")), F.lit(0)).cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (cache_expiry, workflow_states, memory_index, article_paths, semantic_chunks, chunk_token_counts)}

_STEPS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(S.STAGES, S.STAGES[1:]))
_REFINABLE = "s.stage IN (" + ", ".join(f"'{x}'" for x in S.REFINABLE) + ")"
ORACLES = {
    # an item is there while fewer than SIZE others were looked up since it was, and it was put there within SECONDS
    "cache_expiry": f"""WITH RECURSIVE e AS (SELECT event_type AS c, user_id AS i, ts, event_id AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
l AS (SELECT *, lag(k) OVER (PARTITION BY c, i ORDER BY k) AS before, row_number() OVER (PARTITION BY c, i ORDER BY k) AS j FROM e),
d AS (SELECT l.c, l.i, l.j, l.n, l.ts, l.before IS NOT NULL AND (SELECT count(DISTINCT x.i) FROM e x WHERE x.c = l.c AND x.k > l.before AND x.k < l.k) < {SIZE} AS there FROM l),
r AS (SELECT c, i, j, n, ts AS since, 'miss' AS result FROM d WHERE j = 1
  UNION ALL SELECT d.c, d.i, d.j, d.n, CASE WHEN d.there AND d.ts < r.since + INTERVAL {SECONDS} SECOND THEN r.since ELSE d.ts END, CASE WHEN NOT d.there THEN 'miss' WHEN d.ts < r.since + INTERVAL {SECONDS} SECOND THEN 'hit' ELSE 'expired' END
  FROM r JOIN d ON d.c = r.c AND d.i = r.i AND d.j = r.j + 1)
SELECT c AS cache, n AS number, i AS item, result FROM r""",
    "workflow_states": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 23 = 0 THEN 'fatal_error' WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'success' WHEN event_id % 2 = 0 THEN 'needs_refinement' ELSE 'no_results' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS number, '' AS outcome, 'initial' AS stage, 0 AS refinements, TRUE AS allowed FROM e
  UNION ALL SELECT s.user_id, e.k, e.event_id, e.outcome,
    CASE WHEN s.stage IN ('completed', 'failed') THEN s.stage WHEN e.outcome = 'fatal_error' THEN 'failed' WHEN e.outcome = 'success' THEN CASE s.stage {_STEPS} END WHEN {_REFINABLE} THEN CASE WHEN s.refinements < {S.MOST_REFINEMENTS} THEN 'planning' ELSE 'failed' END ELSE s.stage END,
    s.refinements + CASE WHEN s.stage IN ('completed', 'failed') OR e.outcome IN ('fatal_error', 'success') OR NOT ({_REFINABLE}) OR s.refinements >= {S.MOST_REFINEMENTS} THEN 0 ELSE 1 END,
    s.stage NOT IN ('completed', 'failed') AND (e.outcome IN ('fatal_error', 'success') OR {_REFINABLE})
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT CAST(user_id AS VARCHAR) AS workflow, number, outcome, stage, CAST(refinements AS INTEGER) AS refinements, allowed FROM s WHERE k > 0""",
    "memory_index": """SELECT doc_id, md5(CASE WHEN doc_id % 6 = 0 AND doc_id % 20 <> 0 THEN text || ' changed' ELSE text END) AS h, CAST(CASE WHEN doc_id % 60 = 0 THEN 2 WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch,
  CAST(1 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 60 = 0 THEN 1 ELSE 0 END AS BIGINT) AS times_written FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 20 = 0""",
    "article_paths": r"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(regexp_replace(text, '[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}]', '', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM documents),
g AS (SELECT * FROM d WHERE doc_id % 9 <> 0)
SELECT path, NULL AS error, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS characters FROM (
  SELECT 'Abstract' AS path, 'about ' || lang AS t FROM g UNION ALL SELECT source, t FROM g WHERE t <> '' UNION ALL SELECT source || ' > Section ' || CASE WHEN t <> '' THEN 3 ELSE 2 END, 'inner' FROM g UNION ALL SELECT source || ' > Notes > Deep', 'x' FROM g) z GROUP BY path
UNION ALL SELECT NULL, 'not well-formed', count(*), NULL FROM d WHERE doc_id % 9 = 0 HAVING count(*) > 0""",
    "chunk_token_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{T.CHUNK_TOKEN}')) AS BIGINT) AS n FROM documents",
}
