"""The join against counting every pair, and its bounds against brute force."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import components, ngramjoin, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Components by all pairs: {(id, text): (n, component)}."""
    sets = []
    for k, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
        a, b = sets[i], sets[j]
        if a and b and (same_id or 100 * len(a & b) >= 80 * len(a | b)):
            up[top(j)] = top(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and sets[i]:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(
        ((k, len(sets[i]), None if k is None else least[top(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str
    )


def check(spark, rows):
    df = spark.createDataFrame([(*r, "g", 1) for r in rows], "doc_id long, text string, s string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join_components(df).collect()), key=str)
    assert got == plain(rows)


def test_hard_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    long_ = " ".join(f"v{i}" for i in range(30000))
    check(spark, [
        (9, base), (3, base.upper()), (5, base + " end"), (4, None), (2, ""), (7, " \n\t"), (8, "one two"), (1, "ONE\ttwo"), (6, "one two three"),
        (None, base), (None, "z y x w v u"), (10, long_), (11, long_ + " x y z"), (12, "a b c d e"), (12, "a b c d e"), (13, "p q r s t u"), (13, base + " x"),
        (14, "É b c d e"), (15, "é b c d e"),
    ])


def test_chains_and_near_groups(spark):
    random.seed(3)
    rows, key = [], 0
    for _ in range(4):
        words = [f"{random.random():.4f}" for _ in range(80)]
        for _ in range(30):
            if random.random() < 0.6:
                words = list(words)
                words[random.randrange(len(words))] = f"{random.random():.4f}"
            rows.append((key := key + 1, " ".join(words)))
    shared = [f"s{i}" for i in range(40)]
    rows += [(key := key + 1, " ".join(shared + [f"{random.random():.4f}" for _ in range(random.randint(1, 30))])) for _ in range(40)]
    random.shuffle(rows)
    check(spark, rows)


def test_all_links_of_a_group_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "COUNT_SETS", 7)  # groups of several blocks, and packs of small ones
    monkeypatch.setattr(ngramjoin, "COUNT_COLUMNS", 64)
    random.seed(8)
    rows, key = [], 0
    for size in (3, 25, 5, 2, 4):
        words = [f"{random.random():.4f}" for _ in range(90)]
        for _ in range(size):
            near = list(words)
            for _ in range(random.randint(0, 2)):
                near[random.randrange(90)] = f"{random.random():.4f}"
            rows += [(key := key + 1, " ".join(near))] * random.choice((1, 1, 1, 2))
    rows += [(None, rows[0][1]), (key + 1, None), (key + 2, "one two"), (key + 3, "one two"), (key + 4, "alone")]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert sum(want) > 2 * len(rows)  # more than any star's links
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngramjoin.join_components(df)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == sorted(((k, n) for (k, _), n in zip(rows, want)), key=str)


def test_empty(spark):
    assert ngramjoin.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_bound():
    random.seed(4)
    for _ in range(3000):
        n, m = random.randint(1, 30), random.randint(1, 30)
        o = random.randint(0, min(n, m))
        if 100 * o >= 80 * (n + m - o):
            assert o >= n - ngramjoin.prefix_size(n) + 1


def test_components(spark):
    random.seed(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (50, 60), (60, 55)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if x not in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op4_ngram_join(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.orderBy(F.col("doc_id")).collect()])


def test_set_names_differ():
    assert ngramjoin.set_name(np.array([1, 2], np.uint64)) != ngramjoin.set_name(np.array([1, 3], np.uint64))
