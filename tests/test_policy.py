import pytest
from pyspark.sql import functions as F

from tessera.operators import policy as P


def test_who_may_read_what(spark):
    rows = [(1, 1, "project_fact", "verified_research_claim", "research_run", 0.2), (1, 2, "project_fact", "note", "user", 0.9), (1, 3, "research_step", "x", "user", 0.95), (1, 4, "verified_claim", "x", "user", 0.1), (1, 5, "failed_route", None, None, 0.99), (1, 6, "other", "x", "user", 1.0)]
    df = spark.createDataFrame(rows, "query_id int, id int, kind string, category string, origin string, score double")
    got = [(r["id"], r["role"], r["evidence_eligible"]) for r in P.as_context(df, "synthesis").orderBy("place").collect()]
    assert [g[0] for g in got] == [1, 4, 2, 3, 5] and {g[2] for g in got} == {False}
    assert got[0][1] == "confirmed_project_fact" and got[2][1] == "project_context"
    assert [r["id"] for r in P.as_context(df, "brainstorm").orderBy("place").collect()] == [5, 3, 2, 1]
    assert [r["id"] for r in P.allowed(df, "brainstorm", ["research_step"]).collect()] == [3]
    with pytest.raises(ValueError):
        P.allowed(df, "brainstorm", ["verified_claim"])
    with pytest.raises(ValueError):
        P.allowed(df, "nobody")


def test_support_terms_lists_and_maps(spark):
    rows = [("ＡＢＣ v 2", "uses abc2 here"), ("Version 3.1 kit", "KIT 3-1"), ("版本 2 试剂", "试剂 和 2试剂"), ("xyz", "no"), ("!!", "no"), (None, "a"), ("ß", "STRASSE SS")]
    df = spark.createDataFrame(rows, "v string, e string")
    assert [r[0] for r in df.select(P.supported(F.col("v"), F.col("e"))).collect()] == [True, False, True, False, False, False, True]
    t = spark.createDataFrame([("中文字 A-1 单 x中 to",), (None,)], "t string").select(P.variant_terms(F.col("t"))).collect()
    assert sorted(t[0][0]) == sorted(["中文", "文字", "a-1", "单", "中", "to"]) and t[1][0] is None
    lists = spark.sql("SELECT 'ask' m, array('a', 'ask', 'b') s, array('b', 'c') f UNION ALL SELECT 'Generate x', array('a'), array('a')")
    assert [r[0] for r in lists.select(P.supplements(F.col("m"), F.col("s"), F.col("f"), "Generate")).collect()] == [["ask", "a", "b", "c"], ["a"]]
    m = spark.sql("SELECT map('a', 1, 'b', 2) l, map('b', CAST(NULL AS INT), 'c', 3) r").select(P.right_wins(F.col("l"), F.col("r"))).first()[0]
    assert m == {"a": 1, "b": None, "c": 3}
    plan = P.base_plan(spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "question string, place int, query string"), "question").orderBy("place").collect()
    assert [(r["action_id"], r["gain"]) for r in plan] == [("required-q1", 0.9), ("required-q2", 0.7)]
