"""Relational, aggregate, window and set queries in SQL; one text serves Spark and the SQL counterpart where both read it alike."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> SQL, or (Spark SQL, other engine's SQL)
SQL: dict[str, str | tuple[str, str]] = {}

_SUMMARY = """
  CAST(count(CASE WHEN event_type <> 'view' THEN 1 END) AS BIGINT) AS request_count,
  round(coalesce(sum(CASE WHEN event_type <> 'view' THEN value END), 0.0), 4) AS total_value,
  round(coalesce(avg(CASE WHEN event_type <> 'view' AND value > 0 THEN value END), 0.0), 4) AS avg_latency,
  CAST(count(CASE WHEN event_type = 'view' THEN 1 END) AS BIGINT) AS retrieval_count,
  CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS hit_count,
  round(coalesce(count(CASE WHEN event_type = 'error' THEN 1 END) / nullif(CAST(count(*) AS DOUBLE), 0), 0.0), 6) AS hit_rate"""
_PCT = """round(percentile_disc({p}) WITHIN GROUP (ORDER BY value), 4)"""

SQL["usage_summary"] = (
    f"SELECT {_SUMMARY}, coalesce(round(percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN event_type <> 'view' AND value > 0 THEN value END), 1), 0.0) AS p50, coalesce(round(percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN event_type <> 'view' AND value > 0 THEN value END), 1), 0.0) AS p95 FROM events",
    f"SELECT {_SUMMARY}, coalesce(round(quantile_disc(CASE WHEN event_type <> 'view' AND value > 0 THEN value END, 0.5), 1), 0.0) AS p50, coalesce(round(quantile_disc(CASE WHEN event_type <> 'view' AND value > 0 THEN value END, 0.95), 1), 0.0) AS p95 FROM events",
)
for _name, _spark, _duck in (
    ("day", "date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"),
    ("week", "concat(extract(YEAROFWEEK FROM ts), '-W', lpad(CAST(weekofyear(ts) AS STRING), 2, '0'))", "strftime(ts, '%G-W%V')"),
    ("month", "date_format(ts, 'yyyy-MM')", "strftime(ts, '%Y-%m')"),
):
    SQL[f"usage_by_{_name}"] = tuple(f"SELECT {x} AS bucket, {_SUMMARY} FROM events GROUP BY 1" for x in (_spark, _duck))
SQL["usage_by_type_ranked"] = """
SELECT kind, total_value, n, CAST(row_number() OVER (ORDER BY total_value DESC, kind) AS BIGINT) AS place FROM (
  SELECT coalesce(nullif(event_type, ''), 'unknown') AS kind, round(sum(value), 4) AS total_value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) t"""
SQL["usage_per_turn"] = """
SELECT user_id, CAST(count(*) AS BIGINT) AS requests, round(sum(value), 4) AS total_value, min(event_id) AS first_event FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
for _days in (7, 30, 90):
    SQL[f"period_filter_{_days}d"] = f"""
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT max(ts) AS now FROM events) m WHERE ts >= now - INTERVAL {_days} DAY GROUP BY event_type"""
SQL["nearest_rank_percentiles"] = (
    "SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95 FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag",
)
SQL["running_total_by_round"] = """
SELECT d, n, CAST(sum(n) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative, p FROM (
  SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2) t"""
SQL["first_seen_delta"] = """
SELECT first_month, CAST(count(*) AS BIGINT) AS new_customers FROM (
  SELECT o_custkey, min(year(o_orderdate) * 100 + month(o_orderdate)) AS first_month FROM orders GROUP BY o_custkey) t GROUP BY first_month"""
SQL["scope_chain_join"] = """
SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name"""
SQL["collection_scope_semi"] = """
SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') AND o_totalprice > 400000"""
SQL["membership_semi"] = "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)"
SQL["left_join_prior"] = """
SELECT s_suppkey, round(0.9 * s_acctbal + 0.1 * coalesce(q.top, 0.0), 4) AS score
FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_extendedprice) AS top FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1) q ON s_suppkey = l_suppkey"""
SQL["nulls_last_order_limit"] = """
SELECT c_custkey, last_order, place FROM (
  SELECT c_custkey, last_order, CAST(row_number() OVER (ORDER BY last_order DESC NULLS LAST, c_custkey) AS BIGINT) AS place
  FROM (SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) o ON c_custkey = o_custkey
        ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 200) c) t"""
SQL["group_counts_with_zero"] = "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"
SQL["facet_counts"] = """
SELECT p_brand, n, CAST(row_number() OVER (ORDER BY n DESC, p_brand) AS BIGINT) AS place FROM (
  SELECT p_brand, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand HAVING count(l_orderkey) > 0) t"""
SQL["tag_and_filter"] = """
SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY l_orderkey HAVING count(DISTINCT p_brand) = 2"""
SQL["multi_column_search"] = """
SELECT p_partkey, p_name, p_brand FROM part WHERE lower(coalesce(p_name, '')) LIKE '%ring%' OR lower(coalesce(p_brand, '')) LIKE '%#1_%' OR lower(coalesce(p_type, '')) LIKE '%ring%'"""
SQL["archive_filter"] = "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_size < 5"
SQL["identifier_lookup"] = "SELECT p_partkey, p_name, 1.0e0 AS score FROM part WHERE CASE 'pmid' WHEN 'pmid' THEN p_partkey = 42 WHEN 'doi' THEN p_name = '42' ELSE FALSE END"
SQL["orphan_reference_counts"] = """
SELECT p_partkey, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_references FROM part LEFT JOIN (
  SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1
  UNION ALL SELECT l_partkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
  UNION ALL SELECT l_partkey, count(*) FROM lineitem WHERE l_quantity > 45 GROUP BY 1) u ON p_partkey = k GROUP BY p_partkey"""
SQL["orphans_anti"] = "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)"
SQL["stale_or_missing_embeddings"] = """
SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'stale' END AS state FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL OR label <> n_chars % 10"""
SQL["watermark_greatest"] = """
WITH l AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_custkey, max(o_orderdate) AS ordered, max(shipped) AS shipped FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey, greatest(ordered, shipped) AS newest FROM customer LEFT JOIN o ON c_custkey = o_custkey"""
SQL["insert_ignore_upsert"] = """
SELECT c_custkey, c_name, 'old' AS origin FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, concat(c_name, '*'), 'new' FROM customer n WHERE c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey % 3 <> 0 AND o.c_custkey = n.c_custkey)"""
SQL["overwrite_upsert"] = """
SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS rn FROM (
  SELECT c_custkey AS k, c_acctbal AS v, 1 AS version FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 2 FROM customer WHERE c_custkey % 4 = 0) u) t WHERE rn = 1"""
SQL["append_numbering"] = """
SELECT conv_id, turn, CAST(base + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS seq FROM (
  SELECT c.conv_id, c.turn, coalesce(m.base, 0) AS base FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) + 1 AS base FROM conversations WHERE role = 'user' GROUP BY 1) m ON c.conv_id = m.conv_id WHERE c.role <> 'user') t"""
SQL["latest_version"] = "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rn FROM conversations) t WHERE rn = 1"
SQL["restore_as_copy"] = """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS parent FROM conversations
UNION ALL SELECT conv_id, CAST(max(turn) + 1 AS BIGINT), CAST(min(turn) AS BIGINT) FROM conversations GROUP BY conv_id"""
SQL["union_distinct_keep_best"] = """
SELECT k, max(score) AS score FROM (SELECT l_partkey AS k, l_discount AS score FROM lineitem UNION ALL SELECT l_partkey, l_tax FROM lineitem) u GROUP BY k"""
SQL["set_difference"] = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"
SQL["set_intersection"] = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"
SQL["soft_delete_retention"] = """
SELECT kind, id, deleted_at, purge_after FROM (
  SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS deleted_at, o_orderdate + INTERVAL 30 DAY AS purge_after FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_shipdate, l_shipdate + INTERVAL 7 DAY FROM lineitem WHERE l_returnflag = 'R') t
WHERE purge_after <= TIMESTAMP '1996-03-01 00:00:00'"""
SQL["calendar_days"] = """
SELECT coalesce(n.d, t.d) AS d, CAST(coalesce(notes, 0) AS BIGINT) AS notes, CAST(coalesce(tasks, 0) AS BIGINT) AS tasks, CAST(coalesce(done, 0) AS BIGINT) AS done
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS notes FROM events WHERE event_type = 'signup' GROUP BY 1) n
FULL OUTER JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS tasks, count(CASE WHEN value > 20 THEN 1 END) AS done FROM events WHERE event_type = 'click' GROUP BY 1) t ON n.d = t.d"""
SQL["month_range"] = "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-12-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'"
SQL["task_order"] = """
SELECT o_orderkey, place FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate NULLS LAST, o_orderpriority, o_orderkey DESC) AS BIGINT) AS place FROM (
  SELECT * FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate NULLS LAST, o_orderpriority, o_orderkey DESC LIMIT 300) o) t"""
SQL["top_per_key"] = "SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS place FROM lineitem) t WHERE place <= 8"
SQL["zscore_columns"] = """
SELECT p_partkey, round((p_retailprice - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM part CROSS JOIN (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part) t"""
SQL["ols_trend"] = """
SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 3 AND max(l_quantity) > min(l_quantity)"""
SQL["box_groups"] = (
    "SELECT l_shipmode, n, first_seen, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM (SELECT l_returnflag AS l_shipmode, CAST(count(*) AS BIGINT) AS n, min(l_orderkey) AS first_seen, percentile(l_quantity, 0.25) AS q1, percentile(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1) t",
    "SELECT l_shipmode, n, first_seen, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM (SELECT l_returnflag AS l_shipmode, CAST(count(*) AS BIGINT) AS n, min(l_orderkey) AS first_seen, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1) t",
)
#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
_T = ", ".join(f"({i + 1}, CAST({t} AS DOUBLE))" for i, t in enumerate(T95))
SQL["replicate_stats"] = f"""
SELECT g, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, round(mean - coalesce(t.v, 1.96) * sd / sqrt(n), 6) AS low, round(mean + coalesce(t.v, 1.96) * sd / sqrt(n), 6) AS high
FROM (SELECT l_orderkey AS g, CAST(count(*) AS BIGINT) AS n, avg(l_quantity) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(l_quantity) END AS sd FROM lineitem GROUP BY 1) s
LEFT JOIN (VALUES {_T}) AS t(df, v) ON t.df = s.n - 1"""
SQL["quartile_importance"] = (
    """SELECT s_suppkey, round(pct, 6) AS percentile, CAST(least(4, greatest(1, CAST(floor((1 - pct) * 4) AS INT) + 1)) AS INT) AS quartile,
  round(0.6 * pct + 0.4 * least(1.0, ln(1 + greatest(s_acctbal, 0) / 500) / ln(21)), 5) AS importance FROM (
  SELECT s_suppkey, s_acctbal, 1 - (rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) - 1) / CAST(count(*) OVER (PARTITION BY s_nationkey) AS DOUBLE) AS pct FROM supplier) t"""
)
SQL["threshold_calibration"] = """
SELECT threshold, tp, fp, fn, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY round(f1, 9) DESC, threshold DESC) AS BIGINT) AS place FROM (
  SELECT threshold, tp, fp, fn, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS r, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1 FROM (
    SELECT threshold, CAST(count(CASE WHEN conf >= threshold AND quality = 1 THEN 1 END) AS BIGINT) AS tp, CAST(count(CASE WHEN conf >= threshold AND quality = 0 THEN 1 END) AS BIGINT) AS fp, CAST(count(CASE WHEN conf < threshold AND quality = 1 THEN 1 END) AS BIGINT) AS fn
    FROM (SELECT quality, n_chars / (n_chars + CAST(1000.0 AS DOUBLE)) AS conf FROM labels JOIN documents USING (doc_id)) c
    CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE)), (CAST(0.3 AS DOUBLE)), (CAST(0.4 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.6 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS v(threshold) GROUP BY threshold) a) b"""
SQL["sufficiency_ratios"] = """
SELECT o_custkey, round(least(1.0, n / 10.0), 6) AS coverage, CASE WHEN n >= 15 THEN 'sufficient' WHEN n >= 5 THEN 'partial' ELSE 'insufficient' END AS verdict FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) t"""
SQL["batch_outcomes"] = """
SELECT CAST(count(CASE WHEN rn = 1 AND bad = 0 THEN 1 END) AS BIGINT) AS imported, CAST(count(CASE WHEN bad = 1 THEN 1 END) AS BIGINT) AS failed, CAST(count(CASE WHEN rn > 1 AND bad = 0 THEN 1 END) AS BIGINT) AS duplicates FROM (
  SELECT CASE WHEN length(text) < 20 THEN 1 ELSE 0 END AS bad, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) t"""
SQL["retraction_filter"] = "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)"
SQL["acceptance_gate"] = "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 AND n_chars >= 500 THEN 'accepted' ELSE 'downgraded' END AS gate FROM labels JOIN documents USING (doc_id)"
SQL["action_policy"] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 2 THEN 'too small' WHEN l_discount > 0.09 THEN 'discounted' WHEN seen > 1 THEN 'duplicate' WHEN l_tax > 0.07 THEN 'taxed' ELSE 'ok' END AS reason, round(0.5 * l_discount + 0.3 * l_tax + 0.2 * l_quantity / 50, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS seen FROM lineitem) t WHERE 0.5 * l_discount + 0.3 * l_tax + 0.2 * l_quantity / 50 >= 0.2"""
SQL["typed_projection_union"] = """
SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS score FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 8000"""
SQL["or_equi_linkage"] = """
SELECT p_partkey, match, how FROM (SELECT p_partkey, match, how, row_number() OVER (PARTITION BY p_partkey ORDER BY pr, match) AS rn FROM (
  SELECT p_partkey, s_suppkey AS match, 'key' AS how, 1 AS pr FROM part JOIN supplier ON p_partkey = s_suppkey
  UNION ALL SELECT p_partkey, n_nationkey, 'size', 2 FROM part JOIN nation ON p_size = n_nationkey) u) t WHERE rn = 1"""
SQL["rollup_sets"] = """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
SQL["cube_sets"] = "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"
SQL["grouping_sets"] = "SELECT l_returnflag, l_linestatus, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"
SQL["tumbling_window"] = (
    "SELECT window.start AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts, event_type FROM events) GROUP BY window(ts, '1 day'), event_type",
    "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2",
)
SQL["sliding_window"] = (
    "SELECT window.start AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts FROM events) GROUP BY window(ts, '7 days', '1 day')",
    "SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, CAST(count(*) AS BIGINT) AS n FROM events, range(7) r(k) GROUP BY 1",
)
SQL["session_window"] = (
    "SELECT user_id, session_window.start AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(ts AS TIMESTAMP_NTZ) AS ts, user_id FROM events) GROUP BY session_window(ts, '30 minutes'), user_id",
    "SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s",
)
SQL["token_estimates"] = (
    r"SELECT doc_id, CAST(regexp_count(text, '[A-Za-z0-9]+') AS BIGINT) AS words, CAST(ceil(length(text) / 4) AS BIGINT) AS provider FROM documents",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS provider FROM documents",
)
SQL["content_dedup"] = (
    "SELECT sha2(text, 256) AS h, min(doc_id) AS first_doc, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1",
    "SELECT sha256(text) AS h, min(doc_id) AS first_doc, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1",
)
SQL["url_guard"] = (
    "SELECT page_id, parse_url(url, 'HOST') AS host FROM pages WHERE parse_url(url, 'PROTOCOL') = 'https'",
    r"SELECT page_id, regexp_extract(url, '^https://([^/:?#]+)', 1) AS host FROM pages WHERE starts_with(url, 'https://')",
)
SQL["prev_next_links"] = """
SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations"""
SQL["json_project"] = (
    "SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
    "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
)
SQL["statement_categories"] = "SELECT role, n, turns FROM (SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT turn) AS BIGINT) AS turns FROM conversations GROUP BY role) t"
SQL["unique_names"] = """
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE concat(p_name, ' (', CAST(n AS VARCHAR(10)), ')') END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) t"""
SQL["fan_out_cap"] = """
SELECT l_orderkey, l_linenumber, worker FROM (SELECT l_orderkey, l_linenumber, l_suppkey AS worker, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) t WHERE n <= 5"""
SQL["query_attribution"] = "SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey"
SQL["null_group_rollup"] = """
SELECT l_suppkey, round(sum(l_tax), 4) AS elapsed, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS any_returned, CAST(count(CASE WHEN l_discount > 0.05 THEN 1 END) AS BIGINT) AS excluded FROM lineitem GROUP BY l_suppkey"""
