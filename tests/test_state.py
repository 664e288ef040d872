"""State over streams, maintained tables, sections, semantic chunks and duplicate tables."""

import random
import re
import zlib
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, sections, tables
from tessera.streaming import state as S


def events(spark, rows):
    return spark.createDataFrame(rows, "key string, item bigint, outcome string, sec bigint, number bigint").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def test_cache_against_an_ordered_dictionary(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(12), "", r.randrange(0, 4000), n) for n in range(400)]
    got = {x["number"]: x["result"] for x in S.fed(S.slices(events(spark, rows).withColumnRenamed("key", "cache"), "ts", 3), str(tmp_path / "c"), lambda s: S.with_state(s, "cache", S.Cache(5, 60), S.Cache.SCHEMA)).collect()}
    want, held = {}, {"a": OrderedDict(), "b": OrderedDict()}
    for c, item, _, at, n in sorted(rows, key=lambda x: (x[3], x[4])):
        entries = held[c]
        since = entries.get(item)
        want[n] = "miss" if since is None else "hit" if at < since + 60 else "expired"
        if want[n] != "hit":
            entries[item] = at
        entries.move_to_end(item)
        while len(entries) > 5:
            entries.popitem(last=False)
    assert got == want and set(want.values()) == {"miss", "hit", "expired"}


def test_workflow_steps():
    at = ("initial", 0)
    for outcome, want in [("success", "planning"), ("success", "retrieving"), ("no_results", "planning"), ("success", "retrieving"), ("success", "analyzing"), ("success", "verifying"), ("needs_refinement", "planning"), ("success", "retrieving"), ("no_results", "failed")]:
        stage, n, allowed = S.moved(*at, outcome)
        assert allowed and stage == want
        at = (stage, n)
    assert S.moved(*at, "success") == ("failed", 2, False)
    assert S.moved("planning", 0, "no_results") == ("planning", 0, False)
    assert S.moved("analyzing", 1, "fatal_error") == ("failed", 1, True)
    assert S.moved("synthesizing", 1, "success") == ("completed", 1, True) and S.moved("completed", 1, "fatal_error")[2] is False


def test_workflow_state_survives_restarts(spark, tmp_path):
    rows = [("w", 0, o, i, i) for i, o in enumerate(["success", "success", "no_results", "no_results", "success", "fatal_error", "success"])]
    out = S.fed(S.slices(events(spark, rows).withColumnRenamed("key", "workflow"), "ts", 4), str(tmp_path / "w"), lambda s: S.with_state(s, "workflow", S.Workflow(), S.Workflow.SCHEMA))
    assert [(x["stage"], x["refinements"], x["allowed"]) for x in out.orderBy("number").collect()] == [("planning", 0, True), ("retrieving", 0, True), ("planning", 1, True), ("planning", 1, False), ("retrieving", 1, True), ("failed", 1, True), ("failed", 1, False)]


def test_maintained_table(spark, tmp_path):
    kept = S.Maintained(spark, str(tmp_path / "m"), "id", "id int, text string")
    batch = lambda rows: spark.createDataFrame(rows, "id int, text string, gone boolean, `order` int")
    kept.apply(batch([(1, "a", False, 1), (1, "b", False, 2), (2, "x", None, 1), (None, "n", False, 1), (9, None, True, 1)]), 0)
    rows = lambda: sorted((r["id"], r["text"], r["batch"]) for r in kept.table().collect())
    assert rows() == [(1, "b", 0), (2, "x", 0)]
    second = batch([(1, "b", False, 1), (2, None, False, 1), (3, "new", False, 1)])
    kept.apply(second, 1)
    assert rows() == [(1, "b", 0), (2, None, 1), (3, "new", 1)]
    assert kept.changes().where("batch = 1").count() == 2  # what didn't change isn't written
    kept.apply(second, 1)
    assert rows() == [(1, "b", 0), (2, None, 1), (3, "new", 1)] and kept.changes().where("batch = 1").count() == 2
    kept.apply(batch([(3, "", True, 1), (3, "", True, 2), (7, "", True, 1)]), 2)
    assert rows() == [(1, "b", 0), (2, None, 1)] and kept.changes().where("batch = 2").count() == 1
    small = kept.compact(str(tmp_path / "n"))
    assert sorted((r["id"], r["text"]) for r in small.table().collect()) == [(1, "b"), (2, None)]


ARTICLE = """<?xml version='1.0'?><article xmlns:x="u"><front><article-meta><abstract><p>About  it.</p><sec><p>More</p></sec></abstract></article-meta></front>
<body><sec><title>Results <i>now</i></title><p>One.</p><x:p>Two</x:p><sec><title>Sub</title><p>In</p><fig><p>no</p></fig></sec></sec><sec><p>nameless</p></sec><sec><title>Empty</title></sec></body></article>"""


def test_sections(spark):
    rows = [(1, ARTICLE), (2, "<a><body><p>x</p><div><p>y</p></div></body></a>"), (3, "<a>"), (4, None), (5, "<a><front/></a>"), (6, "<a><body/></a>"), (7, "<a><abstract><p>only</p></abstract></a>")]
    df = spark.createDataFrame(rows, "id int, x string")
    got = [tuple(r) for r in sections.sections_of(df, "id", "x").orderBy("id", "ordinal", "position").collect()]
    assert [(g[0], g[3], g[7]) for g in got if g[0] == 1] == [(1, "Abstract", "About it."), (1, "Abstract", "More"), (1, "Results now", "One."), (1, "Results now", "Two"), (1, "Results now > Sub", "In"), (1, "Section 4", "nameless")]
    assert [(g[5], g[6]) for g in got if g[3] == "Results now"] == [(0, 4), (6, 9)]
    assert [(g[3], g[7]) for g in got if g[0] == 2] == [("Body", "x"), ("Body", "y")]
    assert [(g[0], g[8]) for g in got if g[0] in (3, 4, 5, 6)] == [(3, "not well-formed"), (5, "no article body"), (6, "no text")]
    deep = "<a><body>" + "<sec><title>t</title><p>q</p>" * 2000 + "</sec>" * 2000 + "</body></a>"
    assert len(list(sections.sections(deep))) == 2000
    name = sections.article_sections(spark)
    df.createOrReplaceTempView("articles")
    assert spark.sql(f"SELECT count(*) FROM articles, LATERAL {name}(x) WHERE id = 1").first()[0] == 6


TOPICS = " ".join([
    "The oncogene drives tumor growth in the human cells.", "The oncogene in the human cells drives a tumor kinase.", "The tumor growth in human cells needs the oncogene.",
    "An orbit holds one rocky planet around its distant star.", "One rocky planet keeps its orbit around its distant star.", "Its distant star bends an orbit around one rocky planet.",
])


def test_semantic_breaks(spark):
    df = spark.createDataFrame([(1, TOPICS), (2, None), (3, "  \n "), (4, "One only.")], "id int, text string")
    got = chunking.chunk(df, "id", "text", target=120, most=140, overlap=0, least=15, semantic=True).orderBy("id", "ordinal").collect()
    mine = [r["chunk"] for r in got if r["id"] == 1]
    assert len(mine) == 2 and "orbit" not in mine[0] and "oncogene" not in mine[1]
    assert [r["chunk"] for r in got if r["id"] != 1] == ["One only."]
    for r in got:
        if r["id"] == 1:
            assert TOPICS[r["char_start"] : r["char_end"]] == r["chunk"]
    assert chunking.chunk(df, "id", "text", target=120, most=140, overlap=0, least=15).where("id = 1").count() == 1


def test_tokens_and_sentences_of_the_chunker():
    text = 'See a-b/c_d v1.2. "Quoted!" Next 中文。后 end\n\nNew--line ?! x'
    units = chunking.Units(text, 100)
    assert [text[s:e] for s, e in zip(units.starts, units.ends)] == re.findall(r"[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*|[㐀-鿿]|\S", text)
    spans = [text[units.starts[a] : units.ends[b - 1]] for a, b in zip(units.first, units.last)]
    assert spans == ["See a-b/c_d v1.2.", '"Quoted!', "Next 中文。后 end", "New--line ?!", "x"]
    assert [tuple(x) for x in chunking.Units("a b c d e", 2).chunks(2, 2, 0, 1, False)] == [(0, 3, 2), (4, 7, 2), (8, 9, 1)]


def test_texts_of_a_batch_are_chunked_together_and_alike(spark):
    texts = [TOPICS, "", 'Ends in "marks."', "  \n ", "One only.", "(a.) b.\n\nc " * 40, "ΑΣ οΣ. " * 9, "x" * 90 + " " + TOPICS, "中文。后 " * 30]
    alone = [(i, o, *c) for i, t in enumerate(texts) for o, c in enumerate(chunking.Units(t, 40).chunks(30, 40, 8, 5, True))]
    assert chunking.Units(texts, 40).packed(30, 40, 8, 5, True) == alone
    # a letter that is longer in lower case moves nothing behind it
    assert chunking.Units("\u0130 " + TOPICS, 140).breaks().tolist() == chunking.Units("i " + TOPICS, 140).breaks().tolist()
    data = np.frombuffer(b"abc" * 50, np.uint8)
    assert chunking.crc32_of(data, np.array([0, 1, 3]), np.array([3, 140, 0])).tolist() == [zlib.crc32(b"abc"), zlib.crc32((b"abc" * 50)[1:141]), 0]


@pytest.mark.parametrize("n", [1, 5])
def test_originals(spark, n):
    one = "| a | b |\n|---|:-:|\n| 1 | x |\n| 2 | y |"
    same = "|a|b|\n| --- | --- |\n|1|  x |\n|2|y|"
    other = "| a | b |\n|---|---|\n| 2 | y |\n| 1 | x |"
    df = spark.createDataFrame([(3, one), (5, "t\n" + same + "\n\n" + other), (7, other), (8, "none")] * n, "id int, text string").dropDuplicates(["id"])
    got = sorted(tuple(r) for r in tables.originals(tables.markdown_tables(df, "id", "text"), "id").select("id", "table_no", "first", "first_table_no", "repeated").collect())
    assert got == [(3, 0, 3, 0, False), (5, 0, 3, 0, True), (5, 1, 5, 1, False), (7, 0, 5, 1, True)]
