import random

from tessera.llm import top_k as T
from tessera.llm.top_k import top_k


def brute(rows, k, scale=64):
    import math

    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * float(x)) for x in v]
            good[i] = min(good[i], w) if i in good else w
    out = []
    for q, a in good.items():
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, top_k(df, **kw).collect()))


def test_against_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, -0.5, 0.3, 1.0]) for _ in range(4 if i % 7 else 3)]) for i in range(230)]
    rows += [(20, None), (400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (None, [1.0] * 4), (41, [9.0] * 4), (40, [0.5] * 4), (440, [])]
    r.shuffle(rows)
    df = spark.createDataFrame([(v, i, i, "x") for i, v in rows], "embedding array<float>, vec_id bigint, query_id bigint, rank string").repartition(5)
    assert got(df, k=6) == brute(rows, 6)
    assert got(df.limit(0)) == []
    few = df.where("vec_id in (60, 61, 62)")
    assert got(few) == brute([x for x in rows if x[0] in (60, 61, 62)], 20)


def test_large_values_and_ties(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-(10**6), 10**6)) for _ in range(64)]) for i in range(300)] + [(1000 + i, [1e6] * 64) for i in range(30)] + [(2000, [1e6] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(df) == brute(rows, 20)


def test_finite_vectors_of_any_size(spark):
    # the largest products don't fit, most scores do; what doesn't is cut to 64 bits
    rows = [(i, [1e9 if i == 20 else float(i), float(i % 3), -1e9 if i == 21 else 1.0]) for i in range(60)] + [(100, [1e30, 1.0, 0.0]), (101, [-1e30, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    low, high = -(2**63), 2**63 - 1
    w = {i: [min(high, max(low, int(64 * x))) for x in v] for i, v in rows}
    want = []
    for q in (i for i in w if i % 20 == 0):
        scores = sorted((-min(high, max(low, sum(a * b for a, b in zip(w[q], w[i])))), i) for i in w if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got(df) == sorted(want)
