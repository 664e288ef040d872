import random
import re
from collections import defaultdict
from itertools import combinations

from tessera.llm.line_dedup import without_recurring_lines


def line_templates(line):
    """(template, documents that it needs) of a line, by the rules as the module states them."""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)) if x]
    n = len(w)
    numbers = [i for i, x in enumerate(w) if re.search("[0-9]", x)]
    if 2 * len(numbers) <= n:
        w = ["<*>" if i in numbers else x for i, x in enumerate(w)]
    else:
        numbers = []
    found = {(tuple(w), 3)} if w else set()
    if n >= 12:
        cuts = [3 + (n - 3) * j // 4 for j in range(5)]
        for left_open in [{i} for i in range(4)] + ([set(p) for p in combinations(range(4), 2)] if n < 25 else []):
            t = [None if any(cuts[i] <= p < cuts[i + 1] for i in left_open) else x for p, x in enumerate(w)]
            found.add((tuple(t) + tuple(sorted(left_open)), 3))
    elif n >= 4:
        words = [i for i in range(1, n) if i not in numbers]
        for left_open in [{i} for i in words] + [set(p) for p in combinations(words, 2)]:
            if (len(numbers) + len(left_open)) / n <= 0.4:
                found.add((tuple(None if i in left_open else x for i, x in enumerate(w)), 5))
    return found


def brute(rows):
    carriers = defaultdict(list)
    for i, t in rows:
        for k in {k for line in (t or "").split("\n") for k in line_templates(line)}:
            carriers[k].append(i)
    bad = {k: min(v) for k, v in carriers.items() if len(v) >= k[1] and min(v) < max(v)}
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0)
            continue
        keep = [line for line in t.split("\n") if not any(bad.get(k, i) != i for k in line_templates(line))]
        n = len(t.split("\n")) - len(keep)
        out[i] = ("\n".join(keep).rstrip("\n") if n else t, n)
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["é%d" % i if i % 9 == 0 else "W" + chr(97 + i % 26) * (i // 26 + 1) for i in range(60)]
    boiler = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 3, 8, 14, 30, 40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randrange(6)):
            if r.random() < 0.5:
                w = r.choice(boiler).split()
                if r.random() < 0.4:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
                lines.append(" ".join(w) if r.random() < 0.8 else "\t".join(w).upper().replace("É", "é"))
            else:
                lines.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 20))))
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, f"page {i} of 9\n\nbody of {'abcdefgh'[i]} alone\n") for i in range(5)] + [(300, None), (301, ""), (302, "\n\n")]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id bigint, id string").repartition(3)
    got = {x["doc_id"]: (x["text"], x["n"]) for x in without_recurring_lines(df, dropped="n").collect()}
    assert got == brute(rows)
    assert got[201] == ("", 2) and got[200][1] == 0


def test_fields_of_short_and_long_lines(spark):
    names, places = ["alice", "bob", "carol", "dave", "eve", "frank"], ["home", "work", "berlin", "paris", "rome", "oslo"]
    tail = "session opened by service seven after check of all the usual rights without any remark"
    rows = [(i, f"User {a} logged in from {p}\n{12 * i} {i} {i / 7}\nAt noon today {a} came over to {p} and the {tail}\nsaid {a} to {p} once {i}") for i, (a, p) in enumerate(zip(names, places))]
    got = dict(without_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "text").collect())
    assert got[0] == rows[0][1]
    for i in range(1, 6):
        # rows of numbers stay, and so does a line of which more than two tokens in five would be fields
        assert got[i] == "\n".join(rows[i][1].split("\n")[1::2])


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "a"), (7, "b"), (7, "b"), (7, "b")], "doc_id bigint, text string")
    assert sorted(map(tuple, without_recurring_lines(df).collect()), key=str) == [(7, "b")] * 3 + [(None, "a")] * 3
    assert without_recurring_lines(df.limit(0)).collect() == []
