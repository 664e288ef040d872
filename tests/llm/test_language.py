import random
import zlib

from pyspark.sql import functions as F

from tessera.llm.language import identify

ALPHABETS = {"xa": "aeioulmnr", "yb": "stkpzaeio", "zc": "äöüßqwxyv"}


def corpus(n=300, seed=9):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(ALPHABETS)[i % 3]
        text = " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(8, 60)))
        rows.append((i, text.title() if i % 4 == 0 else text, lang))
    return rows


def test_held_out_accuracy_and_no_use_of_their_language(spark):
    rows = corpus()
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    docs = spark.createDataFrame([(lang, i, t, 0.5, "s") for i, t, lang in rows], "lang string, doc_id bigint, text string, score double, k string").repartition(4)
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held
    assert sum(got[i]["lang_pred"] != lang for i, _, lang in rows if held[i]) <= 2
    # other languages on held-out rows change nothing
    lies = spark.createDataFrame([("qq" if held[i] else lang, i, t) for i, t, lang in rows], "lang string, doc_id bigint, text string")
    again = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify(lies).collect()}
    assert again == {i: (r["lang_pred"], round(r["score"], 9)) for i, r in got.items()}


def test_odd_rows(spark):
    rows = corpus(60)
    rows += [(100, None, "xa"), (101, "", "xa"), (102, "123 ?! \U0001f600", "xa"), (None, rows[0][1], None), (103, "sta" * 400_000, "yb"), (103, "sta" * 400_000, "yb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = identify(docs).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[None]["lang_pred"] == "xa" and not by[None]["held_out"] and by[103]["lang_pred"] == "yb"
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(docs.limit(0)).collect() == []
