import pytest
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.operators import plots, workflow as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*values):
    return F.array(*[F.lit(v).cast("string") for v in values])


def test_text_rules(spark):
    assert one(spark, P.lines_repaired(F.lit("Hy­phen in-\n  side  a \r\n\n  b\n"))) == "Hyphen inside a\nb"
    assert one(spark, P.clean_title(F.lit(" 2. **A  title:** "), F.lit("none"))) == "A title"
    assert one(spark, P.clean_title(F.lit(None).cast("string"), F.lit("none"))) == "none"
    assert one(spark, P.prefix_overlap(F.lit("genome Genomics cat"), F.lit("genomes cat genetics"))) == 2
    assert one(spark, P.ascii_terms(F.lit("The p53 of x and p53, TP-53"), ["the", "and", "of"])) == ["p53", "TP-53"]
    assert one(spark, P.clean_list(strings("- a", "", None, "• b", "a"), 5)) == ["a", "b"]
    assert one(spark, P.marker_hits(F.lit("Bad Thing"), ["thing", "other"])) == ["thing"]


def test_rules_of_work(spark):
    assert one(spark, P.says_retracted(strings("Review", "Retracted Publication"))) and not one(spark, P.says_retracted(F.lit(None).cast("array<string>")))
    asked = one(spark, P.followups(F.lit("q"), strings("a b", " new  gap ", "New gap", "no", "third"), strings("Q evidence  gap a b")))
    assert asked == ["q evidence gap new gap", "q evidence gap third"]
    assert [one(spark, P.retrieval_mode(strings(*r), F.lit(i))) for r, i in ((["fts"], False), (["dense_a"], False), (["fts"], True))] == ["hybrid-sparse", "hybrid-dense", "identifier"]
    assert one(spark, P.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert tuple(one(spark, P.retry_advice(F.lit("HTTP 503"), F.lit("failed")))) == (True, "transient_failure_retry_with_backoff")
    assert one(spark, P.completeness(a=F.lit(" "), b=F.lit(1)))["missing"] == ["a"]


def test_records(spark):
    terms = spark.createDataFrame([(1, ["A"]), (2, ["A.1", "B.2"]), (3, ["A.1.7"]), (4, ["A.1"])], "k int, numbers array<string>")
    assert sorted(map(tuple, W.tree_parents(terms, "k", "numbers").collect())) == [(2, 1), (3, 4), (4, 1)]
    rows = spark.createDataFrame([(None, "a", 1.0)], "u int, c string, v double")
    with pytest.raises(Exception, match="names no unit"):
        plots.paired(rows, "u", "c", "v").collect()
    assert plots.is_replicate("Rep 3") and not plots.is_replicate("report")
    with pytest.raises(ValueError):
        plots.error_bars(rows, "range")
    assert W.verified(spark.createDataFrame([(1, "x", []), (2, "x", ["e"]), (3, None, ["e"])], "claim_id int, statement string, evidence_ids array<string>"), spark.createDataFrame([("e", True)], "evidence_id string, valid boolean")).orderBy("claim_id").collect() == [(1, False), (2, True), (3, False)]
