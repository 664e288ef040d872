"""Operators on small hand-made rows, with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, communities, graph, linkage, memory, ordering, retrieval as R, tables
from tessera.operators.routing import followups, merged, routed, subqueries
from tessera.streaming import events as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rrf_prefers_items_of_two_routes(spark):
    r = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "b", "y", 1), (1, "c", "z", 1)], "query_id int, route string, item string, rank int")
    out = {x["item"]: x["score"] for x in R.rrf(r, "item", {"a": 1.0, "b": 0.9, "c": 0.0}).collect()}
    assert out["y"] == pytest.approx(1 / 62 + 0.9 / 61) and out["y"] > out["x"] and "z" not in out
    with pytest.raises(ValueError):
        R.rrf(r, "item", k=0)


def test_prior(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None), (1, "b", 0.95, 1.0)], "query_id int, item string, score double, importance double")
    out = {x["item"]: x["score"] for x in R.prior(df, 0.1).collect()}
    assert out == {"b": pytest.approx(0.955), "a": pytest.approx(0.9)}


def test_rerank_flips_and_keeps_the_tail(spark):
    df = spark.createDataFrame([(1, "a", 0.9, -2.0), (1, "b", 0.8, 5.0), (1, "c", 0.1, 9.0)], "query_id int, item string, score double, rerank double")
    assert [r["item"] for r in R.rerank(df, "item", 1.0, 2).orderBy("rank").collect()] == ["b", "a", "c"]
    none = df.withColumn("rerank", F.lit(None).cast("double"))
    assert [r["item"] for r in R.rerank(none, "item", 1.0, 2).orderBy("rank").collect()] == ["a", "b", "c"]


def test_ir_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "q", 1)], "query_id int, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, item string")
    one, two = R.ir_metrics(ranking, gold, 5).orderBy("query_id").collect()
    assert one["average_precision"] == pytest.approx((1 + 2 / 3) / 2) and one["recall"] == 1 and one["precision"] == pytest.approx(2 / 3)
    assert one["ndcg"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3))) and one["reciprocal_rank"] == 1
    assert tuple(two)[1:] == (0, 0, 0, 0, 0, 0)


def test_anchors_record_a_content_only_when_chosen(spark):
    pool = spark.createDataFrame([(1, 1, "a", "p", "h1"), (1, 2, "b", "p", "h2"), (1, 3, "c", "q", "h2"), (1, 4, "d", "q", "h2"), (1, 5, "e", "r", "h3")], "query_id int, rank int, item string, g string, c string")
    out = R.anchors(pool, "item", "g", "c", limit=3, per_group=1, pool_size=5)
    assert [r["item"] for r in out.orderBy("position").collect()] == ["a", "c", "e"]


def test_budget_skips_but_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 1, 900), (1, 2, 50), (1, 3, 10), (2, 1, 40), (2, 2, 90), (2, 3, 50)], "g int, o int, size int")
    out = R.within_budget(df.withColumn("keep", F.col("o")), ["g"], ["o"], "size", 100, "keep")
    assert rows(out.select("g", "keep")) == [(1, 1), (2, 1), (2, 3)]


def test_dense_works_in_blocks(spark):
    odd = spark.createDataFrame([(1, [0.8, 0.2]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, [1.0])], "id int, v array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, v array<float>")
    assert [r["id"] for r in R.dense(odd, asked, "id", "v", 5).orderBy("rank").collect()] == [2, 1]
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(40)], "vec_id int, v array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "v")
    got = sorted(map(tuple, R.dense(v, q, "vec_id", "v", 3).collect()))
    assert len(got) == 120 and got[:3] == [(0, 0, 0.0, 1), (0, 1, 0.0, 2), (0, 2, 0.0, 3)]


def test_numbering_and_turns(spark):
    rows = spark.createDataFrame([(s, i) for s, n in (("a", 1), ("b", 40), (None, 3)) for i in range(n)], "s string, i int").repartition(5)
    assert sorted((r["place"], r["i"]) for r in ordering.numbered(rows.where("s = 'b'"), ["i"]).collect()) == [(i + 1, i) for i in range(40)]
    got = [(r["s"], r["i"]) for r in ordering.interleaved(rows, "s", ["i"]).orderBy("place").collect()]
    assert got[:5] == [(None, 0), ("a", 0), ("b", 0), (None, 1), ("b", 1)] and len(got) == 44


def test_components_of_a_hot_vertex_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9000)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).select("id", "component").collect())
    assert got == {i: 0 if i < 3000 else 9000 if i == 9000 else 5000 for i in [*range(3000), *range(5000, 5041), 9000]}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish"), (4, "x y z"), (5, None)], "id int, text string")
    q = spark.createDataFrame([(7, ["bird", "bird"])], "query_id int, terms array<string>")
    out = R.bm25(docs, q, "id", "text").collect()
    mean = (2 + 3 + 1 + 3) / 4
    idf = math.log((5 - 1 + 0.5) / 1.5)
    assert len(out) == 1 and out[0]["id"] == 2
    assert out[0]["score"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)), rel=0.2)


def test_text_functions(spark):
    df = spark.createDataFrame([("  A\t b ", "https://doi.org/10.1/X", "BRAF V600E 与甲状腺癌", "3,2")], "a string, d string, m string, n string")
    r = df.select(T.normalised(F.col("a")), T.normalised_doi(F.col("d")), T.language_tag(F.col("m")), T.chunk_tokens(F.col("m")), T.terms(F.col("m")), T.memory_terms(F.col("m"))).first()
    assert tuple(r)[:4] == ("a b", "10.1/x", "mixed", 7)
    assert r[4] == ["braf", "v600e", "与甲", "甲状", "状腺", "腺癌"] and r[5] == ["braf", "v600e", "与甲状腺癌"]
    x = spark.sql("select '12345678' a, 'PMC12' b, 'see 10.1000/x' c, 'none' d, 'in 1999 x' y, '2031' z, '' e")
    got = x.select(*[T.identifier_kind(F.col(c)) for c in "abcd"], T.year_of(F.col("y")), T.year_of(F.col("z")), T.budget_tokens(F.col("e"))).first()
    assert tuple(got) == ("pmid", "pmcid", "doi", None, 1999, 2031, 0)
    d = spark.sql("select 2021 y, 2 m, 30 d").select(T.safe_date(F.col("y"), F.col("m"), F.col("d"))).first()[0]
    assert str(d) == "2021-01-01"
    b = spark.sql("select 'One two. Three four five' x").select(T.bounded_text(F.col("x"), 12), T.bounded_text(F.col("x"), 100)).first()
    assert b[1] == "One two. Three four five" and b[0].startswith("One two.")


def test_hmac_and_uuid(spark):
    import base64
    import hashlib
    import hmac
    import uuid

    r = spark.range(1).select(T.evidence_token(b"k", F.lit("w"), F.lit("c")), T.uuid5(str(uuid.NAMESPACE_URL), F.lit("näme"))).first()
    mac = hmac.new(b"k", b"w:c", hashlib.sha256).digest()[:16]
    assert r[0] == "ev1.w.c." + base64.urlsafe_b64encode(mac).decode().rstrip("=")
    assert r[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, "näme"))


def test_chunks_are_slices_and_fit(spark):
    text = " ".join(f"Sentence number {i} says a little." for i in range(100)) + "\n" + "word " * 300
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    out = chunking.chunk(df, "id", "text", target=80, most=100, overlap=10, least=20).orderBy("ordinal").collect()
    assert len(out) > 5 and {r["id"] for r in out} == {1}
    for r in out:
        assert text[r["char_start"] : r["char_end"]] == r["chunk"] and r["n_tokens"] <= 100
    covered = set().union(*(range(r["char_start"], r["char_end"]) for r in out))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "a\n# T\nb\n### D\nc\n## P\nd\n# U\ne")], "id int, text string")
    assert [(r["path"], r["body"]) for r in chunking.markdown_sections(df, "id", "text").orderBy("line").collect()] == [("", "a"), ("T", "b"), ("T > D", "c"), ("T > P", "d"), ("U", "e")]


def chain(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")


def test_hops_and_components(spark):
    e = chain(spark, (1, 2), (2, 3), (3, 4), (10, 11))
    seed = spark.createDataFrame([(1,)], "id bigint")
    assert rows(graph.hops(e, seed, 1)) == [(1, 0), (2, 1)] and rows(graph.hops(e, seed, 2)) == [(1, 0), (2, 1), (3, 2)]
    lone = spark.createDataFrame([(99,)], "id bigint")
    assert dict(rows(graph.connected_components(e, lone))) == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 99: 99}
    long = chain(spark, *[(i, i + 1) for i in range(40)])
    assert {c for _, c in rows(graph.connected_components(long))} == {0}


def test_communities_and_paths(spark):
    e = chain(spark, *[(a, b) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)], (4, 10))
    labels = communities.louvain(e).labels
    assert dict(rows(labels)) == {i: 0 if i < 5 else 10 for i in [*range(5), *range(10, 15)]}
    assert graph.modularity(e, labels) > 0.4
    p = {r["id"]: (r["cost"], r["path"]) for r in graph.shortest_paths(e, spark.createDataFrame([(0,)], "id bigint")).collect()}
    assert p[10] == (2.0, [0, 4, 10]) and 14 in p and p[0] == (0.0, [0])


def test_mentions(spark):
    df = spark.createDataFrame([(1, "Gene X and gene x, GENE X; gene x (a.b)"), (2, "regenex")], "id int, text string")
    names = spark.createDataFrame([("gene x",), ("a.b",), ("ge",)], "label string")
    assert rows(graph.mentions(df, names, "id", "text", "label")) == [(1, "a.b", 35), (1, "gene x", 0), (1, "gene x", 11), (1, "gene x", 19)]


def test_mmr_and_hybrid(spark):
    pool = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.89, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0])], "query_id int, item string, score double, v array<double>")
    assert [r["item"] for r in memory.mmr(pool, "item", "v", 3).orderBy("position").collect()] == ["a", "b", "c"]
    assert [r["item"] for r in memory.mmr(pool, "item", "v", 2, relevance=0.5, diversity=0.5).orderBy("position").collect()] == ["a", "c"]
    h = memory.hybrid_score(spark.sql("select 1d dense, 0.5d lexical, 0.04d importance, 1d recency")).first()
    assert h["score"] == pytest.approx(0.45 + 0.1 + 0.008 + 0.15) and h["routes"] == ["dense", "lexical", "recency"]


def test_similar_pairs_against_all_pairs(spark):
    import random

    r = random.Random(5)
    sets = {i: sorted(set(r.choices("abcdefghij", k=r.choice([4, 5, 7])))) for i in range(60)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "id int, t array<string>")
    first = {}
    for i, s in sets.items():
        first.setdefault(tuple(s), i)
    want = {(a, b) for sa, a in first.items() for sb, b in first.items() if a < b and len({*sa} & {*sb}) / len({*sa} | {*sb}) >= 0.55}
    want |= {(first[tuple(s)], i) for i, s in sets.items() if first[tuple(s)] != i}
    assert {(x["a"], x["b"]) for x in memory.similar_pairs(df, "id", "t", 0.55).collect()} == want


def test_merge_and_links(spark):
    df = spark.createDataFrame([("k", 1, "short", None, False, ["p"]), ("k", 2, "the longer", "j", True, ["q", "p"]), ("k", 3, "as long!!!", "z", False, ["r"])], "k string, o int, abstract string, journal string, flag boolean, src array<string>")
    r = linkage.merge_records(df, "k", "o", ["abstract"], ["journal"], ["flag"], ["src"]).first()
    assert (r["abstract"], r["journal"], r["flag"], r["src"], r["n_records"]) == ("the longer", "j", True, ["p", "q", "r"], 3)
    left = spark.createDataFrame([(1, "a", None), (2, None, "y"), (3, "n", "n")], "id int, pmid string, doi string")
    right = spark.createDataFrame([(7, "a", "y"), (8, None, "y")], "paper int, pmid string, doi string")
    assert rows(linkage.priority_link(left, right, ["pmid", "doi"], "id", "paper")) == [(1, 7, "pmid"), (2, 7, "doi")]


def test_upserts_and_retention(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, version int")
    assert rows(linkage.insert_ignore(old, new, ["k"]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(linkage.overwrite(old, new, ["k"], "version").select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    t = spark.sql("select 1 id, timestamp'2024-01-01' d union all select 2, timestamp'2024-01-08' union all select 3, null")
    assert [r["id"] for r in linkage.expired(t, "d", F.lit(7), F.lit("2024-01-09").cast("timestamp")).collect()] == [1]


def test_tables(spark):
    text = "x\n| time | a | b |\n|---|---|:-:|\n| 2024-01-01 | 1,000 | 5% |\n| 2024-01-02 | 2e3 | p\\|q |\n| 2024-01-03 | |\nend\n| no | table |\n| at | all |"
    cells = tables.markdown_tables(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert [r["cells"] for r in cells.orderBy("row_no").collect()] == [["time", "a", "b"], ["2024-01-01", "1,000", "5%"], ["2024-01-02", "2e3", "p|q"], ["2024-01-03", "", ""]]
    kinds = tables.column_types(cells, "id")
    assert [r["kind"] for r in kinds.orderBy("column_no").collect()] == ["temporal", "numeric", "categorical"]
    assert tables.chart_kind(kinds, "id").first()["chart"] == "line"
    n = spark.sql("select '1,234.5' a, '12%' b, 'x1' c").select(*[tables.number(F.col(c)) for c in "abc"]).first()
    assert tuple(n) == (1234.5, 0.12, None)


def test_router_and_merge(spark):
    asked = ["Why does A conflict with B?", "Compare A versus B in patients", "hello", "Latest systematic review of X", "How does X work versus Y; and the pathway of Z in cells", "方法学 流程", "progress of the past 7 years", None, "10.1/x"]
    df = spark.createDataFrame([(i, q, i == 8) for i, q in enumerate(asked)], "id int, q string, known boolean")
    got = {r["id"]: r for r in routed(df, "q", "known").collect()}
    assert [got[i]["question_type"] for i in range(9)] == ["mechanism", "pico", "general", "systematic_review", "comparison", "methodology", "latest_progress", "general", "identifier"]
    assert [got[i]["strategy"] for i in range(9)] == ["direct", "decomposition", "direct", "deep_research", "decomposition", "direct", "deep_research", "direct", "direct"]
    assert [round(got[i]["confidence"], 2) for i in (0, 1, 2, 3, 8)] == [0.8, 0.88, 0.55, 0.88, 1.0] and got[1]["reasons"] == ["clinical_pico_marker", "comparison_marker"]
    parts = {}
    for r in subqueries(routed(df, "q", "known"), "q", most=6).orderBy("id", "place").collect():
        parts.setdefault(r["id"], []).append((r["focus"], r["query"]))
    assert parts[0] == [("original", asked[0])] and parts[7] == [("original", "")]
    assert [f for f, _ in parts[1]] == ["core", "population_intervention", "comparator_outcomes", "study_design", "clause", "clause"] and parts[1][-2:] == [("clause", "Compare A"), ("clause", "B in patients")]
    assert parts[4][1:] == [("comparative_effectiveness", asked[4] + " comparative effectiveness"), ("comparative_safety", asked[4] + " safety adverse events"), ("clause", "How does X work"), ("clause", "and the pathway of Z in cells")]
    assert max(len(p) for p in parts.values()) <= 6 and subqueries(routed(df, "q", "known"), "q", most=1).count() == 9
    f = spark.sql("SELECT 'q' q, array(' a  gap ', 'xx', 'A GAP', 'other gap', 'third gap') g, array('q  evidence gap other gap') e").select(followups(F.col("q"), F.col("g"), F.col("e"))).first()[0]
    assert f == ["q evidence gap a gap", "q evidence gap third gap"]
    hits = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "a", 0.7), (1, 1, "b", 0.9)], "query_id int, sub int, item string, score double")
    assert [(r["item"], r["hits"], r["score"]) for r in merged(hits, "item", 1).orderBy("rank").collect()] == [("a", 2, 0.7), ("b", 1, 0.9)]


def test_late_events_are_dropped_and_doubles_too(spark, tmp_path):
    schema = "id int, ts timestamp, value double"
    for i, batch in enumerate(([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00")], [(3, "2024-01-01 00:20:00"), (2, "2024-01-01 05:00:00"), (4, "2024-01-01 09:00:00")], [(5, "2024-01-01 20:00:00")])):
        spark.createDataFrame([(k, t, 1.0) for k, t in batch], "id int, t string, value double").select("id", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read(spark, str(tmp_path / "in"), schema)
    once = S.replay(S.deduplicated(stream, "ts", ["id"], "60 days"), str(tmp_path / "c2"))
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 3, 4, 5]
    counts = S.replay(S.windowed(stream, "ts", [], "1 hour", late="1 hour"), str(tmp_path / "c1"))
    assert sum(r["n"] for r in counts.collect()) <= 6
    seen = []
    S.incremental(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "c3"))
    assert sum(seen) == 6


def test_similar_pairs_over_blocks_of_all_sizes(spark, monkeypatch):
    import random

    for name, value in (("BLOCK_TOKENS", 600), ("STEP", 300), ("RANKED", 40)):
        monkeypatch.setattr(memory, name, value)
    r, sets = random.Random(8), {}
    for i in range(0, 160, 2):
        s = set(r.choices(range(400), k=r.choice([1, 2, 4, 9, 30, 120, 300])))
        # another with some tokens changed, taken away or added
        t = set(r.sample(sorted(s), max(1, round(len(s) * r.uniform(0.5, 1))))) | set(r.choices(range(400), k=r.randrange(0, 1 + len(s) // 2)))
        sets |= {i: s, i + 1: t}
    sets |= {500: {1, 2, 3}, 501: {3, 2, 1}, 502: set(range(55)), 503: set(range(100)), 504: set()}  # 55 of 100 is just enough
    df = spark.createDataFrame([(i, [f"w{x}" for x in sorted(s)]) for i, s in sets.items()], "id long, t array<string>").repartition(3)
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(frozenset(s), i)
    want = {(min(a, b), max(a, b)) for sa, a in first.items() for sb, b in first.items() if a != b and len(sa & sb) / len(sa | sb) >= 0.55}
    want |= {(first[frozenset(s)], i) for i, s in sets.items() if first[frozenset(s)] != i}
    got = [(x["a"], x["b"]) for x in memory.similar_pairs(df, "id", "t", 0.55).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (502, 503) in want and len(want) > 20


def test_similar_pairs_reads_tokens_once(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(9)
    sets = {i: sorted({"common", *r.sample(["w%d" % x for x in range(30)], r.choice([0, 2, 3, 12, 14]))}) for i in range(80)}
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(t):
        read.add(1)
        return t

    df = spark.createDataFrame(list(sets.items()), "id long, t array<string>").repartition(2).select("id", tokens("t").alias("t"))
    first = {}
    for i, s in sets.items():
        if len(s) >= 3:
            first.setdefault(tuple(s), i)
    want = {(a, b, round(len({*s} & {*t}) / len({*s} | {*t}), 6)) for s, a in first.items() for t, b in first.items() if a < b and len({*s} & {*t}) / len({*s} | {*t}) >= 0.55}
    want |= {(first[tuple(s)], i, 1.0) for i, s in sets.items() if len(s) >= 3 and first[tuple(s)] != i}
    got = [tuple(x) for x in memory.similar_pairs(df, "id", "t", 0.55, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 8
    assert read.value == len(sets)


def test_fanned_out_takes_the_first_parents_that_have_chunks(spark):
    import random

    r = random.Random(4)
    scores = [(q, p, float(r.randrange(4))) for q in (1, 2) for p in range(60) if r.random() < 0.8]
    chunks = [(p, r.randrange(300)) for p in range(0, 60, 3) for _ in range(5)]
    got = R.fanned_out(spark.createDataFrame(scores, "query_id int, p long, score double"), spark.createDataFrame(chunks, "p long, c long"), "p", "c", 12)
    want = []
    for q in (1, 2):
        places = sorted((-s, p, c) for k, p, s in scores if k == q for p2, c in chunks if p2 == p)[:12]
        once = list({c: (q, c, -s) for s, _, c in reversed(places)}.values())[::-1]
        first = {c: i for i, (_, _, c) in reversed(list(enumerate(places)))}
        want += [(*row, n) for n, row in enumerate(sorted(once, key=lambda x: first[x[1]]), 1)]
    assert sorted((x["query_id"], x["c"], x["score"], x["rank"]) for x in got.collect()) == sorted(want)
