import json

from pyspark.sql import functions as F

from tessera.functions import extraction as X
from tessera.operators import assembly as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_english_form(spark):
    assert one(spark, X.english_form(F.lit("plain words"))) == "plain words"
    assert one(spark, X.english_form(F.lit("大语言模型 in RAG-2 与 RAG-2"))) == "RAG-2 large language model"
    assert one(spark, X.english_form(F.lit("红色"))) is None and one(spark, X.english_form(F.lit(None).cast("string"))) is None


def test_summary_and_keywords(spark):
    good = "In this study we measured how the seven known enzymes of one plant respond to light and to heat."
    plain = "A sentence of more than twelve words that says little but is long enough to be counted here."
    text = " ".join([plain, "Short one.", good, "See https://example.org for more about the work of these many authors and their many long papers."])
    assert one(spark, X.extractive_summary(F.lit(text), 1)) == good
    assert one(spark, X.extractive_summary(F.lit(text))) == f"{plain} {good}" and one(spark, X.extractive_summary(F.lit("tiny  text"))) == "tiny text"
    abstract = "word " * 40
    assert one(spark, X.extractive_summary(F.lit(f"Title\nAbstract: {abstract}\nKeywords: a"))) == abstract.strip()
    cut = one(spark, X.bounded(F.lit("abcd. " * 400)))
    assert len(cut) <= 1400 and cut.endswith("d.") and one(spark, X.bounded(F.lit("x" * 2000))) == "x" * 1400 + "…"
    assert one(spark, X.extracted_keywords(F.lit("Keywords: Alpha; ALPHA, methods; b; gamma ray.\n\nOn Deep Learning"))) == ["Alpha", "gamma ray", "Deep learning"]
    assert one(spark, X.extracted_keywords(F.lit(""))) == []


def test_tasks(spark):
    found = one(spark, X.task_drafts(F.lit(None).cast("string"), F.lit("# A\n## B `x`\n#### C\n### D\n## E")))
    assert [(d["title"], d["source_section"]) for d in found] == [("B x", "B x"), ("C", "B x > C"), ("D", "B x > D"), ("E", "E")]
    assert [d["title"] for d in one(spark, X.task_drafts(F.lit("no json"), F.lit("# Only\n# Top")))] == ["Only", "Top"]
    assert [d["source_section"] for d in one(spark, X.task_drafts(F.lit("{}"), F.lit(None).cast("string")))] == ["完整协调输出"]
    mixed = json.dumps({"experiment_agent": {"work_packages": ["text", {"title": "x"}, None]}})
    assert [d["title"] for d in one(spark, X.task_drafts(F.lit(mixed), F.lit("")))] == ["x"]
    many = json.dumps({"experiment_agent": {"work_packages": [{"title": f"t{i}"} for i in range(40)]}})
    assert len(one(spark, X.task_drafts(F.lit(many), F.lit("## H")))) == 30


def test_recovered(spark):
    texts = ['say {not} {"a": [1, {"b": 2}]} end', "```toml\na = 1\n```", "{'a': (1, 2)}", "nothing", None, "{" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.recovered("t").alias("r")).orderBy("i").collect()
    assert [r["r"]["format"] for r in rows] == ["json", "toml", "literal", None, None, None]
    assert rows[0]["r"]["value"] == '{"a": [1, {"b": 2}]}'


def test_facts(spark):
    payload = {
        "question_agent": {"hypothesis": " H  one ", "predictions": ["p", "P ", "", None, "q"]},
        "experiment_agent": {"work_packages": [{"title": "T", "approach": "A", "evidence_ids": ["e1"]}, {}, "text"]},
        "selected_direction_id": 7,
        "preference_profile": {"a": ["x"], "b": "", "c": None, "d": "s"},
    }
    rows = spark.createDataFrame([(1, json.dumps(payload)), (2, "broken"), (3, None)], "k int, p string")
    facts = A.payload_facts(rows, "k", "p")
    got = [(r["category"], r["statement"], r["field_path"], r["evidence_ids"]) for r in facts.orderBy("place").collect()]
    assert got == [
        ("hypothesis", "H one", "question_agent.hypothesis", []), ("prediction", "p", "question_agent.predictions[0]", []), ("prediction", "q", "question_agent.predictions[4]", []),
        ("work_package", "T — A", "experiment_agent.work_packages[0]", ["e1"]), ("chosen_direction", "7", "selected_direction_id", []),
        ("user_preference", 'a: ["x"]', "preference_profile.a", []), ("user_preference", 'd: "s"', "preference_profile.d", []),
    ]
    assert A.payload_facts(rows, "k", "p", 2).count() == 2
    sessions = spark.createDataFrame([(1, "One", 2), (2, "Two", 1)], "k int, title string, turn_number int")
    texts = {r["k"]: r["summary"] for r in A.session_summaries(facts, sessions, "k").collect()}
    assert "## 核心假设\n- H one" in texts[1] and texts[2].endswith("摘要。") and "##" not in texts[2]


def test_expansion_is_greedy(spark):
    q = spark.createDataFrame([(1, "gene therapy"), (2, "unrelated"), (3, None)], "k int, t string")
    labels = spark.createDataFrame([("Genetic Therapy",), ("Genes",), ("therapy gene",), ("Genetic",), (" ",), (None,)], "label string")
    got = {r["k"]: r["added"] for r in A.expanded(q, labels, "k", "t", "label").collect()}
    # two like pairs first; then a label that adds nothing new is passed over
    assert got == {1: ["Genetic Therapy", "Genes"], 2: [], 3: []}
    assert A.expanded(q, labels, "k", "t", "label", 1).where("k = 1").first()["added"] == ["Genetic Therapy"]


def test_outline(spark):
    new = spark.createDataFrame([(1, 0, "In tro!", None, "a"), (1, 1, "In tro!", "In tro!", "b"), (1, 2, "??", "nowhere", "c"), (1, 3, "In-tro-2", "??", "d")], "s int, ordinal int, section_key string, parent_key string, title string")
    old = spark.createDataFrame([(1, "In-tro"), (1, "gone"), (2, "x")], "s int, section_key string")
    got = {(r["s"], r["section_key"]): (r["parent_key"], r["action"]) for r in A.outline_changes(new, old, "s").collect()}
    assert got == {(1, "In-tro"): (None, "update"), (1, "In-tro-2"): ("In-tro-2", "insert"), (1, "section-3"): (None, "insert"), (1, "In-tro-2-4"): ("section-3", "insert"), (1, "gone"): (None, "delete"), (2, "x"): (None, "delete")}


def test_curated_tags_stay(spark):
    papers = spark.createDataFrame([(1, ["Review"], True), (2, ["Review", "review"], False)], "paper_id int, publication_types array<string>, curated boolean")
    terms = spark.createDataFrame([(2, f"t{i}", i == 9) for i in range(10)], "paper_id int, label string, major boolean")
    assets = spark.createDataFrame([(2, "user_pdf", None)], "paper_id int, source string, depth string")
    old = spark.createDataFrame([(1, "mine", "mesh", "auto"), (2, "old", "mesh", "auto"), (2, "k", "pdf_keyword", "auto"), (2, "t1", "mesh", "manual")], "paper_id int, name string, kind string, origin string")
    got = {(r["paper_id"], r["name"], r["origin"]) for r in A.auto_tags(papers, terms, assets, old).collect()}
    assert got == {(1, "mine", "auto"), (2, "k", "auto"), (2, "t1", "manual"), (2, "Review", "auto"), (2, "User PDF", "auto")} | {(2, f"t{i}", "auto") for i in (9, 0, 2, 3, 4, 5, 6)}


def test_directions(spark):
    payload = {"directions": [{"topic": " T ", "objective": "why", "novelty": "one 0", "sources": ["https://a", "ftp://b"], "key": ""}, {"title": "no reason"}, "text"]}
    got = one(spark, X.directions(F.lit(json.dumps(payload))))
    assert [(d["title"], d["rationale"], d["novelty_points"], d["web_sources"], d["why_hot"]) for d in got] == [("T", "why", ["one 0"], ["https://a"], [])]
    assert got[0]["direction_id"].startswith("direction-1-") and not one(spark, X.directions(F.lit("broken")))


def test_tei(spark):
    rows = spark.createDataFrame([(1, "<TEI><div><head>H</head><p>a <i>b</i></p><table>t</table></div><div/></TEI>"), (2, "<broken"), (3, None)], "k int, x string")
    got = {r["k"]: r["s"] for r in rows.select("k", X.tei_sections("x").alias("s")).collect()}
    assert [tuple(s) for s in got[1]] == [(0, "H", "a b\n\nt")] and got[2] is None and got[3] is None


def test_replay_and_snapshot(spark):
    requests = spark.createDataFrame([(1, "w", "d", 1), (2, "w", "d", 2)], "request_id int, workflow string, digest string, revision int")
    stored = spark.createDataFrame([("d", 1, 0, "c1"), ("d", 1, 1, "c2")], "digest string, revision int, position int, item string")
    got = {(r["request_id"], r["hit"], r["item"]) for r in A.replayed(requests, stored, b"k").collect()}
    assert got == {(1, True, "c1"), (1, True, "c2"), (2, False, None)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id int")
    groups = spark.createDataFrame([("a", 0), ("b", 1)], "key string, level int")
    rows = A.graph_snapshot(edges, nodes, groups, 2, F.lit(2)).orderBy("part", "place").collect()
    assert [(r["part"], r["id"], r["other"]) for r in rows] == [("community", "b", "1"), ("community", "a", "0"), ("edge", "1", "2"), ("edge", "2", "3"), ("node", "1", None), ("node", "2", None)]
