"""The pipeline stage by stage against plain versions, on rows made for it."""

import random
import re

import corpus_pipeline


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def rows_of(seed=7):
    r = random.Random(seed)
    vocabulary = ["ab" + chr(97 + i % 26) + chr(97 + i // 26) * 2 for i in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = say(30)
    docs, labels = [], []
    for i in range(240):
        text = "\n".join(say(r.randrange(8, 30)) for _ in range(r.randrange(2, 6)))
        if i % 5 == 0:
            text = " | ".join(r.choice(vocabulary).upper() + "!!###" for _ in range(60))
        elif i % 7 == 0:
            text += "\nAll rights reserved by page %d." % i
        if i % 41 == 3:
            text += "\n" + item
        docs.append((i, text, "en", "src%d" % (i % 3), len(text)))
        if i % 2 == 0:
            labels.append((i, 0 if i % 5 == 0 else 1, 0))
    docs += [(1000 + i, docs[j][1].replace(docs[j][1].split()[3], "changed", 1), "en", "copy", 0) for i, j in enumerate((1, 2, 4))]
    docs += [(2000, None, None, None, None), (2001, "", "en", "x", 0)]
    return docs, labels, [(1, item)]


def test_stages(spark, tmp_path):
    docs, labels, bench = rows_of()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [read]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        assert kept[-1].columns == read.columns
    texts = [{r["doc_id"]: r["text"] for r in df.collect()} for df in kept]
    clean = {i for i, t in texts[0].items() if t and "!!###" not in t}
    assert {i for i, t in texts[1].items() if t} >= clean and not any("###" in (t or "") for t in texts[1].values())
    lines = [i for i, t in texts[2].items() if t and "All rights reserved" in t]
    assert lines == [min(i for i, t in texts[1].items() if t and "All rights reserved" in t)]
    ids = sorted(texts[2])
    sets = {i: shingles(texts[2][i]) for i in ids}
    gone = set(texts[2]) - set(texts[3])
    links = {b for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert gone == links
    leaked = {i for i, t in texts[3].items() if t and " ".join(words(bench[0][1])) in " ".join(words(t))}
    assert set(texts[3]) - set(texts[4]) == leaked and leaked
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(texts[4]) and all(r["exact"] in (True, None) for r in out)
