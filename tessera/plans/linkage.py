"""Linkage, table, page and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import linkage as L, ordering, tables as M
from tessera.session import shared_folder
from tessera.sources.tables import table
from tessera.streaming import events as S, state as ST


def record_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("k"), "text", "lang", (F.col("n_chars") > 2000).alias("is_long"), F.array("source").alias("sources"))
    out = L.merge_records(rows, "k", "doc_id", ["text"], ["lang"], ["is_long"], ["sources"])
    return out.select("k", "first_seen", "n_records", F.length("text").cast("bigint").alias("longest"), "lang", "is_long", F.array_join(F.array_sort("sources"), ",").alias("sources"))


def round_robin_interleave(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ordering.interleaved(docs, "source", ["doc_id"])


def stale_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    index = docs.where("doc_id % 3 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("h")))
    return L.stale_or_missing(docs, index, "doc_id", "h")


def priority_links(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k1"), F.col("p_size").cast("bigint").alias("k2"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("k1"), F.col("s_nationkey").cast("bigint").alias("k2"))
    return L.priority_link(p, s, ["k1", "k2"], "p_partkey", "s_suppkey")


def upsert_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return L.insert_ignore(c.where("c_custkey % 2 = 0"), c.withColumn("c_name", F.lower("c_name")), ["c_custkey"])


def upsert_overwrite(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    return L.overwrite(c, c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), F.lit(2).alias("version")), ["c_custkey"], "version")


def _markdown(spark, sf_dir):
    """A Markdown table of each supplier's lines, from the tables' rows."""
    l = table(spark, sf_dir, "lineitem")
    row = F.concat_ws(" | ", F.lit("|").substr(1, 0), F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag", F.col("l_quantity").cast("string"), F.concat((F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")))
    body = l.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("| "), F.ltrim(F.regexp_replace(row, r"^ \| ", "")), F.lit(" |")))), "\n").alias("rows"))
    return body.select("l_suppkey", F.concat(F.lit("text\n| date | flag | quantity | discount |\n|---|:-:|--:|---|\n"), "rows", F.lit("\nmore")).alias("text"))


def table_rows(spark, sf_dir):
    return M.markdown_tables(_markdown(spark, sf_dir), "l_suppkey", "text").where("row_no > 0").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum(M.number(F.element_at("cells", 3))), 4).alias("quantity"), F.round(F.sum(M.number(F.element_at("cells", 4))), 4).alias("discount"))


def table_type_inference(spark, sf_dir):
    types = M.column_types(M.markdown_tables(_markdown(spark, sf_dir), "l_suppkey", "text"), "l_suppkey")
    return types.groupBy("name", "kind").agg(F.count("*").alias("n"))


def chart_choice(spark, sf_dir):
    types = M.column_types(M.markdown_tables(_markdown(spark, sf_dir), "l_suppkey", "text"), "l_suppkey")
    return M.chart_kind(types, "l_suppkey").groupBy("chart").agg(F.count("*").alias("n"))


#: What no heading is looked for in.
HIDDEN = ["<!--.*?-->", *[f"<{t}[ >].*?</{t}[^>]*>" for t in ("script", "style", "template", "noscript", "textarea", "title")]]
HEADING = "(?is)" + "|".join(f"<h{i}[^>]*>.*?</h{i}[^>]*>" for i in range(1, 7))


def html_sections(spark, sf_dir):
    """Headings of the pages, in order, outside comments, scripts and the like."""
    shown = F.regexp_replace("html", "(?is)" + "|".join(HIDDEN), " ")
    found = F.regexp_extract_all(shown, F.lit(HEADING), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("position", "title")).select("page_id", F.col("position").cast("bigint").alias("position"), F.trim(F.regexp_replace("title", "<[^>]+>", "")).alias("title"))


def table_originals(spark, sf_dir):
    """Tables of notes that repeat an earlier one, whatever their blanks and rules: each with the first of its kind."""
    notes = _markdown(spark, sf_dir)
    again = notes.where("l_suppkey % 5 = 0").select((F.col("l_suppkey") + 1_000_000).alias("l_suppkey"), F.regexp_replace(F.regexp_replace("text", r"\|---\|:-:\|--:\|---\|", "| --- | --- | :-- | --- |"), r" \| ", "  |  ").alias("text"))
    return M.originals(M.markdown_tables(notes.union(again), "l_suppkey", "text"), "l_suppkey").select("l_suppkey", F.col("first").alias("first_suppkey"), "repeated")


def _stream(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    return S.read(spark, f"{folder}/in", events.schema), folder


def stream_tumbling(spark, sf_dir):
    stream, folder = _stream(spark, sf_dir)
    counts = S.windowed(stream, "ts", ["event_type"], "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    return S.replay(counts, folder, "complete")


def stream_sessions(spark, sf_dir):
    stream, folder = _stream(spark, sf_dir)
    return S.replay(S.sessions(stream, "ts", "user_id", "30 minutes").select("user_id", "n"), folder, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def stream_sliding(spark, sf_dir):
    stream, folder = _stream(spark, sf_dir)
    return S.replay(S.windowed(stream, "ts", [], "7 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n"), folder, "complete")


def stream_dedup(spark, sf_dir):
    """Events whose first half is delivered again with the second, the stream started anew in between."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = ST.slices(events, "ts", 2)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return ST.fed([first, first.union(second)], folder, lambda s: S.deduplicated(s, "ts", ["event_id"], "60 days").select("event_id", "event_type"))


QUERIES = {f.__name__: f for f in (record_merge, round_robin_interleave, stale_index, priority_links, upsert_ignore, upsert_overwrite, table_rows, table_type_inference, chart_choice, table_originals, html_sections, stream_tumbling, stream_sliding, stream_sessions, stream_dedup)}

ORACLES = {
    "record_merge": """SELECT k, min(doc_id) AS first_seen, count(*) AS n_records, max(length(text)) AS longest, arg_min(lang, doc_id) AS lang, bool_or(n_chars > 2000) AS is_long, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM (SELECT *, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k FROM documents) t GROUP BY k""",
    "round_robin_interleave": """SELECT doc_id, source, CAST(row_number() OVER (ORDER BY pos, source) AS BIGINT) AS place FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) t""",
    "stale_index": "SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0",
    "priority_links": "SELECT p_partkey, s_suppkey, matched_on FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p, s_suppkey) AS rn FROM (SELECT p_partkey, s_suppkey, 'k1' AS matched_on, 0 AS p FROM part JOIN supplier ON p_partkey = s_suppkey UNION ALL SELECT p_partkey, s_suppkey, 'k2', 1 FROM part JOIN supplier ON p_size = s_nationkey) u) t WHERE rn = 1",
    "upsert_ignore": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS c_name FROM customer",
    "upsert_overwrite": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer",
    "table_rows": "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(sum(CAST(trunc(l_discount * 100) AS INT) / 100.0e0), 4) AS discount FROM lineitem GROUP BY 1",
    "table_type_inference": "SELECT name, kind, n FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) c CROSS JOIN (VALUES ('date', 'temporal'), ('flag', 'categorical'), ('quantity', 'numeric'), ('discount', 'numeric')) v(name, kind)",
    "chart_choice": "SELECT 'line' AS chart, count(DISTINCT l_suppkey) AS n FROM lineitem",
    "html_sections": f"""SELECT page_id, i - 1 AS position, trim(regexp_replace(h[i], '<[^>]+>', '', 'g')) AS title FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is){"|".join(HIDDEN)}', ' ', 'g'), '{HEADING}') AS h FROM pages) p) q""",
    "table_originals": "SELECT DISTINCT l_suppkey, l_suppkey AS first_suppkey, FALSE AS repeated FROM lineitem UNION ALL SELECT DISTINCT l_suppkey + 1000000, l_suppkey, TRUE FROM lineitem WHERE l_suppkey % 5 = 0",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(date_trunc('day', ts) - k * INTERVAL 1 DAY, '%Y-%m-%d') AS day, count(*) AS n FROM events, range(7) r(k) GROUP BY 1",
    "stream_sessions": "SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS n FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) a GROUP BY user_id",
    "stream_dedup": "SELECT event_id, event_type FROM events",
}
