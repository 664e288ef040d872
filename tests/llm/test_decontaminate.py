import random

import numpy as np

from tessera.llm.decontaminate import EDITS, best_end, contaminated, without_contaminated


def prefix_distance(item, text):
    """(least distance of the item to a prefix of the text, the shortest such prefix)."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row))


def substring_distance(item, text):
    """The least distance of the item to a stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_exact_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(2))
        want = prefix_distance(a, b)
        assert best_end(np.array(a), np.array(b), 20) == want
        assert best_end(np.array(a), np.array(b), 3) == (want if want[0] <= 3 else (4, 0))


def test_recall_and_exactness(spark):
    r = random.Random(2)
    vocabulary = ["w%d" % i for i in range(500)] + ["The"] * 40
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [say(r.choice([6, 15, 30, 60])) for _ in range(30)]
    docs = []
    for i in range(300):
        w = say(r.choice([0, 20, 300]))
        if i % 2:
            x = list(r.choice(items))
            for _ in range(r.randrange(0, max(1, int(len(x) * 0.3)))):
                p = r.randrange(len(x))
                x[p : p + r.choice([0, 1, 1])] = r.choice([["new"], []]) if p else x[p : p + 1]
            at = r.choice([0, len(w), r.randrange(len(w) + 1)])
            w[at:at] = x
        docs.append((i, " ".join(w).upper() if i % 3 == 0 else "\n".join(w)))
    docs[9] = (9, docs[9][1] + " Odd\tONE out out")
    short = {99: ["w1", "w2"], 97: ["odd", "one", "out"], 96: ["odd"], 95: ["out"], 94: ["one", "out", "odd"]}
    truth = {(i, k) for i, t in docs for k, x in [*enumerate(items), *short.items()] if substring_distance([a.lower() for a in x], t.lower().split()) <= int(EDITS * len(x))}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(k, " ".join(x)) for k, x in short.items()] + [(93, " "), (98, None), (0, " ".join(items[0]))], "item_id bigint, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(500, None, 1), (501, "", 1), (None, " ".join(items[0]), 1), docs[1] + (1,)], "doc_id bigint, text string, item_id int").repartition(3)
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(df, bench).collect()}
    assert not got - truth and len(truth) > 100
    assert {x for x in got if x[1] in short} == {x for x in truth if x[1] in short} >= {(9, 97), (9, 96), (9, 95)}
    assert len(got) >= 0.97 * len(truth)
    kept = {x["doc_id"] for x in without_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs if i not in {a for a, _ in got}} | {500, 501, None}
    assert contaminated(df, bench.limit(0)).collect() == [] and contaminated(df.limit(0), bench).collect() == []
