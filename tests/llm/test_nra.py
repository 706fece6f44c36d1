"""Top-k against sorting all scores, on hard and random vectors."""

import math

import numpy as np

from tidewake.llm import nra, queries


def plain(queries_, rows, k):
    out = []
    for q, v in {(q, tuple(v)) for q, v in queries_ if usable(q, v)}:
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, x)), i) for i, x in rows if usable(i, x) and i != q and len(x) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def usable(i, v):
    return i is not None and v is not None and len(v) > 0


def run(spark, queries_, rows, k):
    kind = "vec_id long, vector array<double>, extra string"
    frame = lambda x: spark.createDataFrame([(i, None if v is None else [float(a) for a in v], "e") for i, v in x], kind)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nra.top_k(frame(queries_), frame(rows), k).collect())


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(nra, "CANDIDATES_A_BLOCK", 70)
    monkeypatch.setattr(nra, "QUERIES_A_BLOCK", 9)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-9, 10, 6).tolist()) for i in range(400)] + [(1000 + i, [3, 0, -2, 1, 1, 5]) for i in range(150)]
    queries_ = rows[::17]
    assert run(spark, queries_, rows, 20) == plain(queries_, rows, 20)


def test_hard_rows(spark):
    rows = [(1, [1, 2]), (2, [1, 2]), (3, None), (4, []), (5, [0, 0]), (None, [9, 9]), (6, [1, 2, 3]), (7, [-4, 4]), (7, [-4, 4]), (8, [2**30, -(2**30)]), (9, [10**9, 10**9])]
    queries_ = [(1, [1, 2]), (1, [1, 2]), (3, None), (6, [1, 2, 3]), (7, [-4, 4]), (9, [10**9, 1])]
    assert run(spark, queries_, rows, 3) == plain(queries_, rows, 3)
    assert run(spark, [], rows, 3) == [] and run(spark, queries_, [], 3) == []


def test_bounds_never_lose_a_winner():
    rng = np.random.default_rng(2)
    for turn in range(60):
        scale = 10 ** (turn % 3 * 7)
        q, x = rng.integers(-30, 31, (5, 8)) * scale, rng.integers(-30, 31, (300, 8)) * scale
        q[0], q[1, :5] = 0, 0
        lists = nra.Lists(x.astype(float))
        found, depths = nra.open_candidates(lists, q.astype(float), np.zeros((5, 300), bool), 10)
        for v, left, depth in zip(q, found, depths):
            score = np.array([sum(int(a) * int(b) for a, b in zip(v, row)) for row in x], object)
            assert set(np.flatnonzero(score >= sorted(score)[-10])) <= set(left.tolist()) and 0 <= depth <= 1


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (2000, 4)).astype(float)
    x[:30] += 40
    left, depth = nra.open_candidates(nra.Lists(x), np.full((2, 4), 5.0), np.zeros((2, 2000), bool), 10)
    assert all(len(a) < 100 for a in left) and (depth == nra.DEPTHS[0]).all()


def test_few_scores_are_resolved():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.standard_normal((4000, 16)) / 4)
    ids = np.arange(4000)
    *_, resolved, depth = nra.search_block(ids[:50], x[:50], ids, x, 20)
    assert resolved < 0.1 * 50 * 4000 and depth < 0.9


def test_a_row_repeated_many_times(spark):
    rows = [(1, [1, 2])] * 300 + [(2, [2, 1]), (3, [5, 5])]
    assert run(spark, [(3, [5, 5]), (1, [1, 2])], rows, 4) == plain([(3, [5, 5]), (1, [1, 2])], rows, 4)


def test_scaled(spark):
    rows = [(1, [0.5, -0.01]), (2, [math.nan, 1.0]), (3, [math.inf]), (4, [None, 1.0]), (5, None), (6, []), (7, [1e30])]
    df = spark.createDataFrame(rows, "i int, e array<float>")
    got = {r.i: r.v for r in df.select("i", nra.scaled("e").alias("v")).collect()}
    assert got[1] == [32.0, -1.0] and all(got[i] is None for i in (2, 3, 4, 5, 6))


def test_whole_small_table(spark):
    rows = [(r.vec_id, [math.floor(64 * float(x)) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op7_exact_topk(spark, "/root/testdata/sf0.001").collect())
    assert got == plain([r for r in rows if r[0] % 20 == 0], rows, 20)
