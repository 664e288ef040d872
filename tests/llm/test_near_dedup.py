import random

import numpy as np
import pyarrow as pa

from tessera.llm.kernels import flat
from tessera.llm.near_dedup import near_duplicates, shingle_sets


def test_large_buckets_are_salted(spark, monkeypatch):
    import tessera.llm.near_dedup as module

    monkeypatch.setattr(module, "MOST", 6)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(rows)


def brute(rows):
    def shingles(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed, families=40):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, passage = [], [r.choice(vocabulary) for _ in range(60)]
    for f in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 60, 250]))]
        if f % 3 == 0:
            base = passage + base
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).title() if r.random() < 0.3 else "\n".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  TWO"), (1005, "é Ü")]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(1003, "one two", "y")], "doc_id bigint, text string, component_id string")
        assert {tuple(r) for r in near_duplicates(df.repartition(3)).collect()} == brute(rows)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == {(None, 2, None, True), (1, 2, 1, True)}
    assert near_duplicates(df.limit(0)).collect() == []


def test_sets_stay_in_their_text():
    values, owner = shingle_sets(*flat(pa.array(["a b c d e", None, "a b", "c d e f g", "b c d e"])))
    assert np.bincount(owner, minlength=5).tolist() == [1, 0, 1, 1, 1] and len(set(values.tolist())) == 4


def test_short_pairs_at_the_threshold(spark):
    rows, n = [], 0
    for size, more, times in ((3, 1, 2000), (6, 2, 2000), (9, 3, 1000), (30, 10, 500), (69, 23, 500), (90, 30, 500)):
        for _ in range(times):
            # the second text has all shingles of the first, and ``more`` others: 75 % exactly
            words = ["q%d.%d" % (n, i) for i in range(size + 4 + more)]
            rows += [(2 * n, " ".join(words[: size + 4])), (2 * n + 1, " ".join(words))]
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {i: c for i, _, c, _ in near_duplicates(df).collect()}
    assert [i for i in range(n) if not got[2 * i] == got[2 * i + 1] == 2 * i] == []


def test_only_links_are_left_of_a_group_of_near_copies(spark, monkeypatch):
    import tessera.llm.near_dedup as module

    # 150 texts that share 70 % of their shingles with each other, one group of which links: each is outside the largest component
    r, rows = random.Random(3), []
    base = ["b%d" % i for i in range(164)]
    for i in range(150):
        own = list(base)
        if i > 9:
            at = r.randrange(130)
            own[at : at + 26] = ["t%d.%d" % (i, k) for k in range(26)]
        rows.append((i, " ".join([*own, "x%d" % i])))
    tested, seen = module.tested, []
    monkeypatch.setattr(module, "tested", lambda pairs, sets: seen.append(pairs.count()) or tested(pairs, sets))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {tuple(x) for x in near_duplicates(df).collect()} == brute(rows)
    monkeypatch.setattr(module, "FULL", 0)
    whole, seen[:] = list(seen), []
    assert {tuple(x) for x in near_duplicates(df).collect()} == brute(rows)
    assert whole[:2] == seen[:2] and whole[2] * 10 < seen[2]


def test_signatures_are_dealt_out_once_a_phase(spark, monkeypatch):
    import re

    import tessera.llm.near_dedup as module

    plans = []
    plain = module.written
    monkeypatch.setattr(module, "written", lambda rows: plans.append(str(rows._jdf.queryExecution().executedPlan())) or plain(rows))
    rows = corpus(4)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == brute(rows)
    first = next(p for p in plans if "hashpartitioning(bucket" in p and ", salt" in p)
    # by bucket alone only counts are dealt out, not the members with what is compared of them
    assert len(re.findall(r"hashpartitioning\(bucket#\w+, \d+\)", first)) == 1


def test_components_are_extended(spark):
    from tessera.llm.components import components, extended

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)]
    frame = lambda e: spark.createDataFrame(e, "a bigint, b bigint")
    whole = sorted(map(tuple, components(frame(edges)).collect()))
    assert sorted(map(tuple, extended(components(frame(edges[:180])), frame(edges[180:])).collect())) == whole
    assert sorted(map(tuple, extended(components(frame(edges[:0])), frame(edges)).collect())) == whole


def test_buckets_are_compared_at_once():
    import tessera.llm.near_dedup as module

    r = np.random.default_rng(7)

    def rows(sizes, small):
        bucket = np.repeat(2 * np.arange(len(sizes)) + small, sizes)
        texts = r.integers(0, 256, (len(bucket), module.PACKED), dtype=np.uint8)
        for i in range(1, len(bucket)):
            if bucket[i] == bucket[i - 1] and i % 3:  # near copies of the member before, and others
                texts[i] = texts[i - 1]
                texts[i, : 4 * (i % 3)] ^= 1
        n = np.bitwise_count(texts[:, : module.BINS]).sum(axis=1, dtype=np.int64) if small else np.full(len(bucket), 200)
        zeros = np.zeros(len(bucket), np.int64)
        return pa.RecordBatch.from_pydict({"bucket": bucket, "salt": zeros, "band_no": zeros, "id": np.arange(len(bucket)), "n": n.astype(np.int64), "comp": np.arange(len(bucket)), "salted": pa.array([False] * len(bucket)), "outer": pa.array([False] * len(bucket)), "visitor": pa.array([False] * len(bucket)), "sig": module.rows_of_bytes(texts)}), texts, n

    def expected(batch, texts, n, small):
        """Star by star, on rows."""
        bucket, found = batch.column("bucket").to_numpy(), set()
        for g in np.unique(bucket):
            free = np.flatnonzero(bucket == g)
            while len(free):
                own = texts[free, : module.BINS]
                modal = np.array([np.bincount(own[:, i], minlength=256).argmax() for i in range(module.BINS)])
                c = free[(own == modal).sum(axis=1).argmax() if len(free) > 2 else 0]
                same = np.bitwise_count(texts[free, : module.BINS] & texts[c, : module.BINS]).sum(axis=1, dtype=np.int64) if small else (own == texts[c, : module.BINS]).sum(axis=1)
                shared = -(-module.PERCENT * (n[free] + n[c]) // (100 + module.PERCENT))
                near = (100 * np.minimum(n[free], n[c]) >= module.PERCENT * np.maximum(n[free], n[c])) & ((same >= shared) if small else (same >= module.MAY))
                near[free == c] = False
                found |= {(max(c, i), min(c, i)) for i in free[near].tolist()}
                free = free[~near & (free != c)]
        return {(int(a), int(b)) for a, b in found}

    for sizes in ([2] * 500, [1, 3, 40, 2, 7, 150]):
        for small in (0, 1):
            batch, texts, n = rows(sizes, small)
            got = list(module.stars(1)(iter([batch])))
            # a batch for all of them, not one for each star
            assert len(got) <= 2
            assert {(a, b) for g in got for a, b in zip(g.column("a").to_pylist(), g.column("b").to_pylist())} == expected(batch, texts, n, small)
