import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.resample import features, first_rows, resample


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def bag(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, per_cent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in bag(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        f = bag(text)
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], -r[1]))
    for k, r in enumerate(able[: per_cent * len(able) // 100]):
        r[4] = k + 1
    return out


def text_of(r, n):
    vocabulary = ["alpha", "Beta", "gämma", "x1", "δελτα", "z" * 70, "the", "of", "q" * 63, "r" * 64, "s" * 65]
    return "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))


def test_features_are_those_of_the_plain_version():
    r = random.Random(2)
    texts = [text_of(r, n) for n in (0, 1, 2, 3, 40, 500)] + ["", "a" * 100_000 + " b", "  .. "]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(x.encode()) for x in texts])
    got = [[] for _ in texts]
    for doc, bucket in features(np.frombuffer(data, np.uint8), offsets):
        for d, b in zip(doc.tolist(), bucket.tolist()):
            got[d].append(b)
    assert [sorted(x) for x in got] == [sorted(bag(x)) for x in texts]


def test_steps_do_not_matter(monkeypatch):
    import tessera.llm.resample as module

    data = np.frombuffer(text_of(random.Random(3), 100).encode(), np.uint8)
    whole = sorted(b for _, x in features(data, np.array([0, len(data)])) for b in x.tolist())
    monkeypatch.setattr(module, "STEP", 7)
    assert sorted(b for _, x in features(data, np.array([0, len(data)])) for b in x.tolist()) == whole


@pytest.mark.parametrize("per_cent", [5, 40, 100, 0])
def test_against_brute_force(spark, per_cent):
    r = random.Random(5)
    rows = [(i * 7, text_of(r, r.choice([3, 19, 20, 25, 60]))) for i in range(150)]
    rows += [(None, text_of(r, 30)), (5000, None), (5001, ""), (rows[3][0], rows[3][1]), (rows[3][0], rows[3][1]), (-4, text_of(r, 2000))]
    target = ["alpha beta alpha", None, "the x1", ""]
    docs = spark.createDataFrame([(1.5, t, i, 3) for i, t in rows], "score double, text string, doc_id bigint, rank int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((list(x) for x in resample(docs, bench, per_cent).collect()), key=str)
    assert got == sorted(brute(rows, target, per_cent), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "a b " * 30)], "doc_id bigint, text string")
    assert resample(docs, docs).collect() == []
    assert [x["rank"] for x in resample(one, docs).collect()] == [None]
    assert [x["rank"] for x in resample(one, docs, per_cent=100).collect()] == [1]


def test_selection_over_the_whole_range_of_numbers(spark):
    r = random.Random(6)
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    values = [(r.choice(edge + [r.randrange(-(1 << 63), 1 << 63)]), r.choice([1, 2, 3]), i) for i in range(300)]
    rows = spark.createDataFrame(values, "a bigint, b bigint, c bigint")
    for k in (0, 1, 2, 77, 150, 299, 300, 400):
        got = rows.where(first_rows(rows, [F.col("a"), F.col("b"), F.col("c")], k)).collect()
        assert sorted(map(tuple, got)) == sorted(values)[:k]
