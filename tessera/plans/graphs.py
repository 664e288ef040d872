"""Graph queries: the tables' foreign keys as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import communities as C, graph as G
from tessera.session import written
from tessera.sources.tables import table


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that share an order line; the weight is the number of lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).agg(F.count("*").cast("double").alias("weight"))


_EDGES = "e AS (SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2)"
_BOTH = _EDGES + ", b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def sparse_edges(spark, sf_dir):
    """A sparser graph: customers and the days of their orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") * 2).alias("src"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 2 + 1).alias("dst")).agg(F.lit(1.0).alias("weight"))


def graph_nodes(spark, sf_dir):
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    keyed = lambda kind, name: F.concat(F.lit(f"{kind}:"), F.left(F.sha2(F.lower(name), 256), F.lit(24)))
    nodes = part.select(keyed("part", F.col("p_name")).alias("node_key"), F.lit("part").alias("node_type"), F.col("p_name").alias("label"), F.col("p_partkey").alias("pos"))
    nodes = nodes.union(supplier.select(keyed("supplier", F.col("s_name")), F.lit("supplier"), "s_name", "s_suppkey")).union(nation.select(keyed("nation", F.col("n_name")), F.lit("nation"), "n_name", F.col("n_nationkey").cast("bigint")))
    return nodes.groupBy("node_key").agg(F.min_by("node_type", "pos").alias("node_type"), F.min_by("label", "pos").alias("label"))


def graph_edges(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.lit("LOCATED_IN").alias("relation"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst"), F.lit(1.0).alias("confidence"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey"), F.lit("PART_OF"), F.concat(F.lit("region:"), "n_regionkey"), F.lit(0.9))
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier:"), "l_suppkey"), F.lit("SUPPLIES"), F.concat(F.lit("part:"), "l_partkey"), F.lit(0.8)).distinct()
    return s.union(n).union(l)


def relation_histogram(spark, sf_dir):
    return graph_edges(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def citation_neighbors_k(spark, sf_dir):
    seeds = spark.range(1).select(F.lit(0).cast("bigint").alias("id"))
    return G.hops(edges_of(spark, sf_dir), seeds, 2).select("id", F.col("distance").cast("bigint").alias("distance"))


def connected_components(spark, sf_dir):
    return G.connected_components(sparse_edges(spark, sf_dir))


def weighted_degree_hubs(spark, sf_dir):
    return G.weighted_degree(edges_of(spark, sf_dir)).select("id", F.round("degree", 6).alias("degree"), F.round(F.col("centrality") + 1e-9, 6).alias("centrality"), "hub")


def community_labels(spark, sf_dir):
    return C.louvain(edges_of(spark, sf_dir)).labels


def community_levels(spark, sf_dir):
    """Fine and coarse communities of brands, types and sizes of parts: that they nest, that modularity is nowhere below that of single vertices, and that it rises from level to level.

    Modularity needn't be above 0: at the resolution of 1.2 the best partition of a graph without structure is below.
    """
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).union(part.select("p_type", F.concat(F.lit("size "), "p_size")))
    edges = written(pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    rows, reached = C.levels(edges)
    nested = rows.groupBy("fine").agg(F.countDistinct("coarse").alias("n"))
    totals = rows.agg(F.count("*").alias("vertices"), F.countDistinct("coarse").alias("coarse"))
    if reached:
        single, fine = (G.modularity(edges, rows.select("id", F.col(c).alias("community")), 1.2) for c in ("id", "fine"))
        reached = [*reached[:-1], fine]
    rising = all(a < b for a, b in zip(reached, reached[1:])) and (not reached or reached[0] >= single - 1e-9)
    return totals.crossJoin(nested.agg(F.coalesce(F.max("n") == 1, F.lit(True)).alias("nested"))).withColumn("rising", F.lit(rising))  # one row each


def _nation_members(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("community"), (F.col("s_suppkey") * 4).alias("id"), F.col("s_suppkey").alias("rank"), F.lit(False).alias("chunk"))
    return s


def representative_chunks(spark, sf_dir):
    """The first twelve orders that a search from each nation's suppliers finds, over the parts they supply."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select((F.col("l_suppkey") * 4).alias("src"), (F.col("l_partkey") * 4 + 1).alias("dst"), F.col("l_partkey").alias("ord"), F.lit(False).alias("src_chunk"), F.lit(False).alias("dst_chunk"))
    b = lines.select((F.col("l_partkey") * 4 + 1).alias("src"), (F.col("l_orderkey") * 4 + 2).alias("dst"), F.col("l_orderkey").alias("ord"), F.lit(False).alias("src_chunk"), F.lit(True).alias("dst_chunk"))
    found = C.representatives(_nation_members(spark, sf_dir), a.union(b))
    return found.select("community", "id", F.col("place").cast("bigint").alias("place"), F.col("distance").cast("bigint").alias("distance"))


def community_names(spark, sf_dir):
    """Nations' suppliers as communities: keys, version-5 identifiers and titles."""
    nodes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 4).alias("id"), F.col("s_name").alias("label"))
    return C.named(_nation_members(spark, sf_dir).select("id", "community"), nodes, "fine", "tables")


def community_reports(spark, sf_dir):
    """Suppliers and parts as communities by the suppliers' nations: members, leaders, relations and years."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_returnflag").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    edges = lines.groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_returnflag").alias("relation")).agg(F.count("*").cast("double").alias("weight"))
    suppliers = s.join(lines.groupBy("l_suppkey").agg(F.min("year").alias("year")), F.col("s_suppkey") == F.col("l_suppkey"), "left").select((F.col("s_suppkey") * 2).alias("id"), F.col("s_name").alias("label"), "year", F.col("s_nationkey").alias("community"))
    # a part belongs to the nation of its smallest supplier
    own = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"), F.min("year").alias("year")).join(s, F.col("s") == F.col("s_suppkey"))
    parts = own.select((F.col("l_partkey") * 2 + 1).alias("id"), F.concat(F.lit("part "), "l_partkey").alias("label"), "year", F.col("s_nationkey").alias("community"))
    nodes = suppliers.union(parts)
    out = C.reports(nodes.select("id", "community"), nodes.select("id", "label", "year"), edges)
    return out.select("community", "members", "edges", F.col("first_year").cast("bigint").alias("first_year"), F.col("last_year").cast("bigint").alias("last_year"), F.array_join("leaders", "|").alias("leaders"), F.array_join("relations", "|").alias("relations"))


def community_report(spark, sf_dir):
    """Of each component: members, edges, the key of its member list."""
    labels = G.connected_components(sparse_edges(spark, sf_dir))
    # an order-free sum of the members' digests stands for their list, so that no component is gathered in a row
    digest = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    per = labels.groupBy("component").agg(F.count("*").alias("members"), F.left(F.sha2(F.concat_ws(":", F.count("*"), F.sum(digest)), 256), F.lit(20)).alias("community_key"))
    ends = sparse_edges(spark, sf_dir).join(labels, F.col("src") == F.col("id")).groupBy("component").agg(F.count("*").alias("edges"))
    return per.join(ends, "component", "left")


def path_search(spark, sf_dir):
    """Cheapest paths between six suppliers, of those the ones of four edges at most, by their mean weight."""
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey < 6").select((F.col("s_suppkey") * 2).alias("id"))
    found = G.shortest_paths(edges_of(spark, sf_dir), seeds, seeds)
    return found.where("source < id AND size(path) <= 5").select("source", "id", F.round("cost", 6).alias("cost"), (F.size("path") - 1).cast("bigint").alias("hops"), F.array_join("path", ",").alias("path"), F.round("score", 6).alias("score"))


def local_search(spark, sf_dir):
    return G.local_search(edges_of(spark, sf_dir), spark.range(1).select(F.lit(0).cast("bigint").alias("id")), 2, 50)


def node_match(spark, sf_dir):
    """Parts by the share of the question's terms in their names."""
    asked = F.array(F.lit("red"), F.lit("ring"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(F.split(F.lower("p_name"), " "), asked)).alias("n")).where("n > 0")
    return p.select("p_partkey", F.round(F.col("n") / 2, 6).alias("score")).orderBy(F.desc("score"), F.desc("p_partkey")).limit(20)


def label_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = spark.createDataFrame([("License",), ("rights reserved",), ("the",), ("xx",)], "label string")
    return G.mentions(docs, names, "doc_id", "text", "label").select("doc_id", "label", F.col("start").cast("bigint").alias("start"))


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, relation_histogram, citation_neighbors_k, connected_components, weighted_degree_hubs, community_labels, community_levels, representative_chunks, community_names, community_reports, community_report, path_search, local_search, node_match, label_mentions)}

_SPARSE = "e AS (SELECT DISTINCT o_custkey * 2 AS src, CAST(epoch(o_orderdate) AS BIGINT) * 2 + 1 AS dst FROM orders), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
# labels of the smallest vertex in so many hops; the tests hold the result against another method
_LAST = 16
_ROUNDS = "l0 AS (SELECT DISTINCT src AS id, src AS c FROM b), " + ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT l.id, least(l.c, min(m.c)) AS c FROM l{i} l JOIN b ON b.src = l.id JOIN l{i} m ON m.id = b.dst GROUP BY l.id, l.c)" for i in range(_LAST))
_NODES = " UNION ALL ".join(f"SELECT '{k}:' || substr(sha256(lower({n})), 1, 24) AS node_key, '{k}' AS node_type, {n} AS label, CAST({i} AS BIGINT) AS pos FROM {t}" for k, n, i, t in (("part", "p_name", "p_partkey", "part"), ("supplier", "s_name", "s_suppkey", "supplier"), ("nation", "n_name", "n_nationkey", "nation")))
_GRAPH = """g AS (SELECT 'supplier:' || s_suppkey AS src, 'LOCATED_IN' AS relation, 'nation:' || s_nationkey AS dst, 1.0e0 AS confidence FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey, 0.9e0 FROM nation
 UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey, 0.8e0 FROM lineitem)"""
#: Rounds of the paths' SQL; a path of more edges than this would fail it, not the operator.
_EDGES_OF_PATH = 8
_RELAXED = "p0 AS (SELECT DISTINCT src AS source, src AS id, CAST(0 AS DOUBLE) AS cost, [src] AS path, CAST(0 AS DOUBLE) AS total FROM b WHERE src IN (SELECT s_suppkey * 2 FROM supplier WHERE s_suppkey < 6)), " + ", ".join(
    f"p{i + 1} AS MATERIALIZED (SELECT source, id, cost, path, total FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY cost, path) AS n FROM (SELECT * FROM p{i} UNION ALL SELECT source, b.dst, round(cost + round(1 / greatest(weight, 0.01e0), 9), 9), list_append(path, b.dst), total + weight FROM p{i} p JOIN b ON b.src = p.id WHERE NOT list_contains(path, b.dst)) z) y WHERE n = 1)"
    for i in range(_EDGES_OF_PATH)
)
ORACLES = {
    "local_search": f"""WITH {_BOTH}, w AS (SELECT src, dst, least(sum(weight), 1.0e0) AS w FROM b GROUP BY 1, 2), l1 AS (SELECT dst AS id, max(w) AS p FROM w WHERE src = 0 GROUP BY 1), l2 AS (SELECT dst AS id, max(p * w) AS p FROM l1 JOIN w ON src = l1.id GROUP BY 1),
a AS (SELECT CAST(0 AS BIGINT) AS id, 1.0e0 AS score, 0 AS distance UNION ALL SELECT id, round(p / 2, 9), 1 FROM l1 UNION ALL SELECT id, round(p / 3, 9), 2 FROM l2),
o AS (SELECT id, score, distance, row_number() OVER (PARTITION BY id ORDER BY score DESC, distance) AS n FROM a)
SELECT id, score, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM o WHERE n = 1) z WHERE rank <= 50""",
    "label_mentions": """WITH l(label, word) AS (VALUES ('license', 'license'), ('rights reserved', 'rights'), ('the', 'the')),
p AS (SELECT doc_id, label, string_split(lower(text), label) AS parts FROM documents, l WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), word))
SELECT doc_id, label, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(label) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, least(len(parts) - 1, 3) + 1)) AS i FROM p WHERE len(parts) > 1) z""",
    "path_search": f"WITH {_BOTH}, {_RELAXED} SELECT source, id, round(cost, 6) AS cost, CAST(len(path) - 1 AS BIGINT) AS hops, array_to_string(path, ',') AS path, round(total / (len(path) - 1), 6) AS score FROM p{_EDGES_OF_PATH} WHERE source < id AND len(path) <= 5 AND id IN (SELECT source FROM p0)",
    "community_levels": f"WITH e AS (SELECT p_brand AS src, p_type AS dst FROM part UNION SELECT p_type, 'size ' || p_size FROM part), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), {_ROUNDS} SELECT count(*) AS vertices, count(DISTINCT c) AS coarse, TRUE AS nested, TRUE AS rising FROM l{_LAST}",
    "representative_chunks": """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), b AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem),
h1 AS (SELECT s_nationkey AS community, p, s_suppkey AS r, row_number() OVER (PARTITION BY s_nationkey, p ORDER BY s_suppkey) AS n FROM supplier JOIN a ON s = s_suppkey),
h2 AS (SELECT community, o, r, p, row_number() OVER (PARTITION BY community, o ORDER BY r, p) AS n FROM (SELECT * FROM h1 WHERE n = 1) z JOIN b USING (p)),
o AS (SELECT community, o, row_number() OVER (PARTITION BY community ORDER BY r, p, o) AS place FROM h2 WHERE n = 1)
SELECT CAST(community AS BIGINT) AS community, o * 4 + 2 AS id, place, CAST(2 AS BIGINT) AS distance FROM o WHERE place <= 12""",
    "community_names": """WITH d AS (SELECT s_nationkey AS community, count(*) AS members, substr(sha256(count(*) || ':' || CAST(sum(CAST(CAST('0x' || substr(sha256(CAST(s_suppkey * 4 AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)), 1, 20) AS g,
  array_to_string(list_slice(list(s_name ORDER BY s_suppkey), 1, 3), ' / ') AS title FROM supplier GROUP BY 1),
h AS (SELECT *, 'fine-' || g AS community_key, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('tables:fine:fine-' || g)) AS h FROM d)
SELECT community, community_key, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab89ab89ab89ab'[strpos('0123456789abcdef', h[17:17])] || h[18:20] || '-' || h[21:32] AS uuid, title, members FROM h""",
    "community_reports": """WITH l AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS m, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT s, p, m, count(*) AS w FROM l GROUP BY ALL),
n AS (SELECT s_suppkey * 2 AS id, s_name AS label, (SELECT min(y) FROM l WHERE s = s_suppkey) AS y, s_nationkey AS community FROM supplier
  UNION ALL SELECT p * 2 + 1, 'part ' || p, y, s_nationkey FROM (SELECT p, min(s) AS s, min(y) AS y FROM l GROUP BY p) z JOIN supplier ON s = s_suppkey),
d AS (SELECT id, sum(w) AS degree FROM (SELECT s * 2 AS id, w FROM e UNION ALL SELECT p * 2 + 1, w FROM e) z GROUP BY id),
r AS (SELECT community, label, y, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS k FROM n LEFT JOIN d USING (id)),
t AS (SELECT community, string_agg(label, '|' ORDER BY k) AS leaders, min(y) AS first_year, max(y) AS last_year FROM r WHERE k <= 10 GROUP BY community),
i AS (SELECT a.community, m, count(*) AS c FROM e JOIN n a ON a.id = s * 2 JOIN n b ON b.id = p * 2 + 1 WHERE a.community = b.community GROUP BY ALL),
j AS (SELECT community, CAST(sum(c) AS BIGINT) AS edges, array_to_string(list_slice(list(m || ':' || c ORDER BY m), 1, 8), '|') AS relations FROM i GROUP BY community)
SELECT community, members, coalesce(edges, 0) AS edges, first_year, last_year, leaders, coalesce(relations, '') AS relations FROM (SELECT community, count(*) AS members FROM n GROUP BY community) c JOIN t USING (community) LEFT JOIN j USING (community)""",
    "graph_nodes": f"SELECT node_key, min_by(node_type, pos) AS node_type, min_by(label, pos) AS label FROM ({_NODES}) t GROUP BY 1",
    "graph_edges": f"WITH {_GRAPH} SELECT * FROM g",
    "relation_histogram": f"WITH {_GRAPH} SELECT relation, count(*) AS n, round(avg(confidence), 6) AS mean FROM g GROUP BY 1",
    "citation_neighbors_k": f"WITH {_BOTH}, h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 0), h2 AS (SELECT DISTINCT dst AS id FROM b JOIN h1 ON src = h1.id WHERE dst <> 0 AND dst NOT IN (SELECT id FROM h1)) SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS distance UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2",
    "connected_components": f"WITH {_SPARSE}, {_ROUNDS} SELECT id, c AS component FROM l{_LAST}",
    "weighted_degree_hubs": f"WITH {_BOTH}, d AS (SELECT src AS id, sum(weight) AS degree FROM b GROUP BY 1) SELECT id, round(degree, 6) AS degree, round(degree / m + 1e-9, 6) AS centrality, degree / m >= 0.75 AS hub FROM d CROSS JOIN (SELECT greatest(max(degree), 1.0e0) AS m FROM d) t",
    "node_match": "SELECT p_partkey, round(n / 2.0e0, 6) AS score FROM (SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring'])) AS n FROM part) t WHERE n > 0 ORDER BY score DESC, p_partkey DESC LIMIT 20",
}
