"""That what steps write and deal out doesn't grow faster than their tables."""

from pyspark.sql import functions as F

from tessera.functions import extraction as X
from tessera.operators import assembly as A, communities as C, index, linkage as L, pipeline, workflow as W
from tessera.plans import hybrid


def test_a_turn_writes_a_row_a_vertex(spark, monkeypatch):
    sizes = []
    plain = C.written
    monkeypatch.setattr(C, "written", lambda rows: sizes.append((out := plain(rows)).count()) or out)
    both = spark.createDataFrame([(a, b, 1.0) for a in range(30) for b in range(30) if a != b], "src bigint, dst bigint, w double")
    labels, _ = C._moves(both, 870.0, 1.0)
    assert labels.count() == 30
    assert max(sizes) == 30


def test_rows_meet_one_target_a_key(spark):
    rows = spark.createDataFrame([(1, 7, 5), (2, None, 5), (3, None, None)], "r int, a int, b int")
    targets = spark.createDataFrame([(9, 7, 1), (8, 7, 5), (6, 2, 5)], "t int, a int, b int")
    out = L.priority_link(rows, targets, ["a", "b"], "r", "t")
    assert sorted(map(tuple, out.collect())) == [(1, 8, "a"), (2, 6, "b")]
    # the targets of each key are reduced before they are joined, the matches after it
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Aggregate [") == 3


def test_questions_scores_are_added_up_where_the_blocks_are(spark):
    docs = spark.createDataFrame([(i, "red ring " * (i % 3 + 1)) for i in range(40)], "id bigint, text string")
    built = index.build(docs, "id", "text", "english")
    asked = index.asked_terms(built, spark.createDataFrame([(1, "rings"), (2, "red")], "query_id int, text string"))
    plan = str(index.scores(built, asked)._jdf.queryExecution().executedPlan())
    assert "hashpartitioning(block" in plan and "hashpartitioning(query_id" not in plan
    assert index.scores(built, asked).count() == 80


def plan_of(df):
    return str(df._jdf.queryExecution().executedPlan())


def test_facts_are_found_in_their_row(spark):
    answers = spark.createDataFrame([(1, '{"question_agent": {"hypothesis": " a  B ", "predictions": ["x", "X", "y"]}}'), (2, "no")], "k int, p string")
    facts = A.payload_facts(answers, "k", "p")
    assert "Exchange" not in plan_of(facts)
    assert sorted(map(tuple, facts.select("place", "category", "statement").collect())) == [(1, "hypothesis", "a B"), (2, "prediction", "x"), (3, "prediction", "y")]
    sessions = spark.createDataFrame([(1, "t", 3), (2, "u", 4)], "k int, title string, turn_number int")
    out = A.session_summaries(facts, sessions, "k")
    assert plan_of(out).count("Generate posexplode") == 1  # the facts are looked at once
    assert [tuple(r) for r in out.select("k", "fact_count").orderBy("k").collect()] == [(1, 3), (2, 0)]


def test_keywords_are_worked_out_once(spark):
    rows = spark.createDataFrame([("Intro\nKeywords: Red Ring; red ring; phages\n\n",)], "t string").select(X.extracted_keywords(F.col("t")).alias("k"))
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("aggregate(split(") == 1
    assert rows.first()["k"] == ["Red Ring", "phages", "Bacteriophages"]


def test_words_are_gathered_where_their_text_is(spark):
    plan = plan_of(hybrid.inverted_index_to_text(spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(doc_id#" in plan and plan.count("Exchange") == 1


def test_only_candidates_are_reranked(spark, monkeypatch):
    tables = []
    plain = pipeline.written
    monkeypatch.setattr(pipeline, "written", lambda rows: tables.append((out := plain(rows)).count()) or out)
    asked = spark.createDataFrame([(1, "q", None)], "query_id bigint, text string, identifier bigint")
    items = spark.range(50).select("id", F.lit("g").alias("group"), F.col("id").cast("string").alias("content"), F.lit(0.0).alias("importance"), F.lit(False).alias("excluded"))
    route = lambda q: q.crossJoin(items.where("id < 3")).select("query_id", "id", F.col("id").cast("double").alias("score"))
    rerank = lambda q: q.crossJoin(items).select("query_id", "id", (-F.col("id")).cast("double").alias("score"))
    none = lambda q: q.select("query_id", F.col("identifier").alias("id"), F.lit(1.0).alias("score"))
    found = pipeline.retrieve(asked, items, "id", {"r": route}, {}, none, pipeline.Settings({"r": 1.0}), reranker=rerank)
    assert sorted(r["id"] for r in found.anchors.collect()) == [0, 1, 2]
    assert tables == [3]


def test_a_nodes_edges_are_cut_before_they_are_dealt_out(spark):
    rows = [(1, 3), (1, 3), (1, 2), (2, 2), (2, 1), (1, 4), (4, 3)]
    out = W.edges_at(spark.createDataFrame(rows, "src bigint, dst bigint"), spark.createDataFrame([(1,), (2,)], "id bigint"), 3, ["src", "dst"])
    assert sorted(tuple(r) for r in out.select("id", "place", "src", "dst").collect()) == [(1, 1, 1, 2), (1, 2, 1, 3), (1, 3, 1, 4), (2, 1, 1, 2), (2, 2, 2, 1), (2, 3, 2, 2)]
    plan = plan_of(out)
    assert plan.count("WindowGroupLimit") == 2 and plan.index("hashpartitioning(id") < plan.rindex("Partial")


def test_an_items_groups_are_dealt_out_as_one_row(spark):
    routes = spark.createDataFrame([(1, "dense_original", "a", 1), (1, "dense_original", "b", 2), (1, "mesh", "c", 1), (1, "fts_english", "b", 1)], "query_id int, route string, item string, rank int")
    reranks = spark.createDataFrame([(1, "c", 0.9), (1, "z", 1.0)], "query_id int, item string, relevance double")
    out = A.ablations(routes, "item", reranks=reranks, keep=2)
    got = {(r["config"], r["rank"]): (r["item"], round(r["score"], 9)) for r in out.collect()}
    assert got["G0_pure_dense", 1] == ("a", round(1 / 61, 9)) and got["G0_pure_dense", 2] == ("b", round(1 / 62, 9))
    assert got["G1_pure_lexical", 1] == ("b", round(1 / 61, 9)) and ("G1_pure_lexical", 2) not in got
    assert got["G4_with_mesh_expansion", 1] == ("b", round(1 / 62 + 1 / 61, 9))
    best = 1 / 62 + 0.8 / 61
    assert got["G6_full_with_reranker", 1] == ("c", round(0.65 * 0.9 + 0.35 * 0.7 / 61 / best, 9)) and got["G6_full_with_reranker", 2] == ("b", 0.35)
    plan = plan_of(out)
    # nothing is dealt out once the groups stand in rows of their own
    assert plan.index("Generate inline") < plan.index("Exchange") and "hashpartitioning(config" not in plan
