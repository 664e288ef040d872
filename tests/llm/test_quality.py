import math
import random
import re
import zlib

import numpy as np

from tessera.llm.quality import N_KINDS, PRIOR_BYTES, PRIOR_WORDS, WIDTH, classify, keep_good, statistics
from tessera.llm.kernels import flat


def plain_statistics(text):
    """The statistics of one text, word by word."""
    data = text.encode()
    if not data:
        return [0.0] * WIDTH
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    lowered = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]

    def kind(c):
        if 97 <= c < 123:
            return 0
        if 65 <= c < 91:
            return 1
        if 48 <= c < 58:
            return 2
        if c in b" \t\n\v\f\r":
            return 3
        if c in b".,;:?!'\"()-":
            return 4
        return 6 if c >= 128 else 5

    kinds = [sum(kind(c) == k for c in data) for k in range(N_KINDS)]
    n, lengths = len(words), [len(w) for w in words]
    mean = sum(lengths) / n if n else 0.0
    spread = math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0)) if n else 0.0
    repeated = sum(a == b for a, b in zip(lowered, lowered[1:]))
    doubled = sum(a == b and kind(a) in (4, 5) for a, b in zip(data, data[1:]))
    bare = sum(all(kind(c) in (4, 5) for c in w) for w in words)
    return [
        math.log1p(n), mean, spread, math.log1p(len(set(lowered))) / math.log1p(max(n, 1)) if n else 0.0, math.sqrt(repeated / (n + PRIOR_WORDS)), math.log1p(n / (1 + data.count(b"\n"))),
        math.sqrt(doubled / (len(data) + PRIOR_BYTES)), math.sqrt(bare / (n + PRIOR_WORDS)), *[math.sqrt(k / (len(data) + PRIOR_BYTES)) for k in kinds[1:]],
    ]


def corpus(n=600, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(r.choice(words) for _ in range(r.randrange(5, 120))).capitalize() + "." if good else " ".join(r.choice(["BUY!!!", "###", "$$", "click", "7777"]) for _ in range(r.randrange(5, 60)))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_statistics_against_a_plain_version():
    import pyarrow as pa

    texts = [t for _, t in corpus(60)[0]] + ["", " \n ", "é ü!!  ..", "a a A b", "..!!,, x"]
    got = statistics(*flat(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-6)  # a variance is a difference of two sums


def test_scores_against_plain_densities_and_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(t, i, "x", 0.1) for i, t in rows], "text string, doc_id bigint, k string, score double").repartition(5)
    marks = spark.createDataFrame([*labels, (labels[0][0], None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(docs, marks).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    assert {i: r["held_out"] for i, r in got.items()} == held
    x = np.array([plain_statistics(t) for _, t in rows])
    y = {i: q for i, q, _ in labels if not held[i]}
    own = [np.array([x[i] for i in y if y[i] == c]) for c in (0, 1)]
    every = np.concatenate(own)
    mean, scale = every.mean(axis=0), every.std(axis=0)
    scale[scale < 1e-9] = 1
    logs = []
    for part in own:
        z = (part - mean) / scale
        cov = np.cov(z.T, bias=True)
        cov = 0.98 * cov + 0.02 * np.trace(cov) / WIDTH * np.eye(WIDTH) + 1e-3 * np.eye(WIDTH)
        d = (x - mean) / scale - z.mean(axis=0)
        logs.append(math.log(len(part) / len(every)) - 0.5 * (np.linalg.slogdet(cov)[1] + (d @ np.linalg.inv(cov) * d).sum(axis=1)))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert np.allclose([got[i]["score"] for i, _ in rows], want, atol=1e-4)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    wrong = [i for i in range(len(rows)) if held[i] and got[i]["predicted"] != (i % 3 > 0)]
    assert len(wrong) <= 2


def test_odd_rows(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame([*rows, (None, "free text"), (7, None), (8, ""), (8, ""), (9, "y" * 3_000_000)], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = classify(docs, marks).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in out)
    assert not [r for r in out if r["doc_id"] is None][0]["held_out"]
    assert {r["score"] for r in classify(docs, marks.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in classify(docs, marks.where("quality = 1")).collect()} == {1.0}
    assert classify(docs.limit(0), marks).collect() == []
    assert keep_good(docs, marks).columns == docs.columns
