import hashlib
import random
import re

import pytest

from tessera.llm.fingerprints import edits, fingerprints, merged, sketch


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w)] if 0 < len(w) < 5 else [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    return md5(" ".join(w))[:16], {md5(x)[:15] for x in shingles if md5(x) < "4"}


def line(s):
    return s[0] + ":" + "".join(sorted(s[1]))


def like(a, b):
    return 1.0 if a[0] == b[0] else len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 0.0


def inside(a, b):
    return 1.0 if a[0] == b[0] else len(a[1] & b[1]) / len(a[1]) if a[1] else 0.0


def brute(rows):
    docs = {}
    for i, t in rows:
        docs[i] = min(docs.get(i, t or ""), t or "", key=lambda x: x.encode())
    order = sorted((i for i in docs if i is not None), reverse=True) + [None] * (None in docs)
    out = []
    for k, i in enumerate(order):
        t, after = docs[i], docs[order[(k + 1) % len(order)]]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b, c = plain(t), plain(e), plain(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), line(a), line(b), like(a, b), like(a, c), inside(a, b), inside(a, c)))
    return out


def rows_of(r, n):
    words = ["Alpha", "beta", "ÄÖ", "x y", "the", "of", "𝒳z", "1.5"] + ["w%d" % i for i in range(200)]
    text = lambda: "".join(r.choice(words) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.choice([0, 1, 3, 5, 9, 60, 300])))
    rows = [(r.randrange(-1000, 1000) * 10 + i % 10, text()) for i in range(n)]
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 200])
def test_against_brute_force(spark, n):
    rows = rows_of(random.Random(n), n)
    docs = spark.createDataFrame([(1, t, i, "x") for i, t in rows], "range int, text string, doc_id bigint, s string").repartition(3)
    got = sorted((tuple(x) for x in edits(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_null_and_repeated_keys_and_long_texts(spark):
    r = random.Random(4)
    rows = rows_of(r, 30) + [(None, "no key here at all"), (None, "another one"), (7, None), (8, ""), (9, "ab"), (9, "aa cc"), (9, None), (11, "long words " * 60_000), (12, "long words " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x[0]: tuple(x) for x in edits(docs).collect()}
    assert got == {x[0]: x for x in brute(rows)}
    assert got[11][3] == got[12][3] and got[12][6] == 1.0
    only = spark.createDataFrame([(None, "a b c d e f g h")], "doc_id bigint, text string")
    assert [tuple(x) for x in edits(only).collect()] == brute([(None, "a b c d e f g h")])


def test_interface(spark):
    rows = rows_of(random.Random(5), 40) + [(1, None), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, fingerprints(docs).collect())) == sorted((i, line(plain(t))) for i, t in rows)
    groups = docs.selectExpr("doc_id % 3 as g", "text").withColumn("sketch", sketch("text"))
    got = {(x["g"], format(x["hash"], "015x")) for x in merged(groups, "g").collect()}
    fmod = lambda i: i % 3 if i >= 0 else -(-i % 3)
    assert got == {(fmod(i), h) for i, t in rows for h in plain(t)[1]}
