"""Projected search against all inner products."""

import math

import numpy as np
import pytest

from tidewake.llm import annsearch, queries

KIND = "vec_id long, embedding array<double>, score string, `a.b` int"


def found(spark, queries_, rows, k):
    frame = lambda x: spark.createDataFrame([(i, v, "s", 1) for i, v in x], KIND)
    out = {}
    for r in sorted(annsearch.nearest(frame(queries_), frame(rows), k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def plain(queries_, rows, k):
    good = lambda i, v: i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    out = {}
    for i, v in queries_:
        if good(i, v):
            scored = sorted((-float((np.array(v) * np.array(x)).sum()), j) for j, x in rows if good(j, x) and j != i and len(x) == len(v))
            if scored:
                out[i] = [(n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return out


def recall(got, want):
    assert set(got) == set(want) and all(len(got[i]) == len(want[i]) for i in want)
    return sum(len({x[1] for x in got[i]} & {x[1] for x in want[i]}) for i in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["normal", "clustered", "lengths"])
def test_recall_in_many_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(annsearch, "ROWS_A_CELL", 100)
    monkeypatch.setattr(annsearch, "LEAF_ROWS", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 24))
    if kind == "clustered":
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 2000)] + 0.2 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 0.5, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows[::40], rows, 10), plain(rows[::40], rows, 10)
    assert recall(got, want) >= 0.9
    score = {(i, j): float((x[i] * x[j]).sum()) for i in got for _, j, _ in got[i]}
    for i, best in got.items():
        assert best == [(n, j, score[i, j]) for n, j in enumerate(sorted((j for _, j, _ in best), key=lambda j: (-score[i, j], j)), 1)]


def test_hard_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0, 3.0]), (7, [-4.0, 4.0]), (7, [-4.0, 4.0]), (8, [math.nan, 1.0]), (9, [math.inf, 1.0]), (10, [None, 1.0])]
    queries_ = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (3, None), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [-4.0, 4.0]), (8, [math.nan, 1.0])]
    assert found(spark, queries_, rows, 3) == plain([q for n, q in enumerate(queries_) if n != 1], rows, 3)
    assert found(spark, [], rows, 3) == {} and found(spark, queries_, [], 3) == {}


def test_a_vector_of_many_rows(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(400, [0.0, 1.0, 1.0]), (401, [9.0, 9.0, 0.0])] + [(7, [1.0, 2.0, 0.5])] * 5
    queries_ = [(7, [1.0, 2.0, 0.5]), (401, [9.0, 9.0, 0.0]), (500, [0.0, 0.0, 1.0])]
    assert found(spark, queries_, rows, 6) == plain(queries_, rows, 6)


def test_large_ids(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "ROWS_A_CELL", 50)
    x = np.random.default_rng(5).standard_normal((600, 6))
    rows = [(2**62 + i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows[::7], rows, 5), plain(rows[::7], rows, 5)
    assert recall(got, want) >= 0.9 and {j for best in got.values() for _, j, _ in best} <= {i for i, _ in rows}


def test_chi_square():
    ratio = annsearch.stop_ratio()
    assert abs(annsearch.chi_square(ratio) - annsearch.CONFIDENCE) < 1e-9
    draws = (np.random.default_rng(2).standard_normal((200_000, annsearch.DIMENSIONS)) ** 2).sum(1)
    assert abs((draws <= ratio).mean() - annsearch.CONFIDENCE) < 0.003


def test_reading_stops_early(monkeypatch):
    monkeypatch.setattr(annsearch, "LEAF_ROWS", 16)
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 24))[rng.integers(0, 50, 4000)] + 0.05 * rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = annsearch.Space(1.0, np.random.default_rng(4).standard_normal((25, annsearch.DIMENSIONS)), np.zeros(0, int), np.zeros(0))
    block = annsearch.Block(space, pd.DataFrame({"v": list(x), "members": [[{"id": i, "copies": 1}] for i in range(4000)]}))
    *_, verified = block.search(np.arange(100), x[:100], np.full(100, -np.inf), 10, annsearch.stop_ratio())
    assert verified < 0.25 * 100 * 4000


def test_whole_small_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {}
    for r in queries.op12_ann_search(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = plain([r for r in rows if r[0] % 20 == 0], rows, 20)
    assert recall(got, want) >= 0.95
