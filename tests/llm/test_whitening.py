"""Whitening against numpy's eigenvectors and exact integers."""

import math

import duckdb
import numpy as np
import pytest

from tidewake.llm import queries, whitening

KIND = "vec_id long, embedding array<double>, whitened string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "w", 1) for i, v in rows], KIND)


def plain(rows, most=16):
    """{(id, component): (n, deviation, |whitened|, explained)} by another eigensolver."""
    xs = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for width in {len(x) for _, x in xs}:
        listed = sorted({tuple(x) for _, x in xs if len(x) == width})
        n, sums = len(listed), [sum(c) for c in zip(*listed)]
        y = np.array(listed, float) - np.array(sums) / n
        cov = y.T @ y / n
        e, u = np.linalg.eigh(cov)
        for i, x in xs:
            if len(x) == width:
                for c in range(min(most, width)):
                    if e[-1 - c] > 1e-9 * e[-1]:
                        w = (np.array(x) - np.array(sums) / n) @ u[:, -1 - c] / math.sqrt(e[-1 - c])
                        out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), round(abs(w), 6), round(e[-1 - c] / np.trace(cov), 8)))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(r.identity_error < 1e-9 for r in rows)
    return sorted(((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 6), round(r.explained, 8)) for r in rows), key=str)


def test_against_another_eigensolver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * [5, 3, 2, 1, 0.5, 0.2] + rng.standard_normal()).tolist()) for i in range(300)] + [(900 + i, [1.0] * 6) for i in range(100)]
    assert got(whitening.whiten(frame(spark, rows), 4)) == plain(rows, 4)


def test_hard_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(40)] + [(None, [0.5, 0.25, 1.0]), (3, [0.5, 0.25, 1.0]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, math.nan, 2.0]), (54, [math.inf, 0.0, 0.0])]
    rows += [(60 + i, [float(i), 2.0 * i]) for i in range(9)] + [(80, [7.0]), (81, [7.0])]  # of rank one; all equal
    assert got(whitening.whiten(frame(spark, rows))) == plain(rows)
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_large_entries(spark):
    rows = [(i, [float(2**18 * (i * i % 7)), float(i)]) for i in range(7)]
    first = lambda found: [x[:4] for x in found if x[1] == 1]
    assert first(got(whitening.whiten(frame(spark, rows)))) == first(plain(rows))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0])])).collect()
    with pytest.raises(Exception, match="no long"):
        whitening.whiten(frame(spark, [(i, [float(2**40 * i), float(i * i)]) for i in range(9)])).collect()


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for most in (5, 2**20, 2**27, 2**40):
        y = rng.integers(-most, most + 1, (50, 4))
        whole = [sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for i, j in zip(*np.triu_indices(4))]
        assert whitening.products(y).tolist() == whole


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (5, 5), (8, 3), (33, 33)):
        b = rng.standard_normal((d, rank)) * np.logspace(0, 5, rank)
        order, factor = whitening.pivoted_cholesky(b @ b.T)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, (b @ b.T)[np.ix_(order, order)], rtol=1e-9, atol=1e-9 * (b * b).sum())
        assert np.allclose(np.triu(factor, 1), 0)
        squared, unit = whitening.jacobi(factor)
        assert np.allclose(unit.T @ unit, np.eye(rank), atol=1e-12) and np.allclose(squared, np.linalg.svd(factor)[1][:rank] ** 2, rtol=1e-9)


def test_whole_small_table(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(path).collect()]
    out = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    found = got(out)
    assert found == plain(rows)
    sql = f"""
    WITH x AS (SELECT vec_id, [floor(c::DOUBLE * 64)::BIGINT + 1000000 FOR c IN embedding] AS x FROM '{path}'),
    e AS (SELECT i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (SELECT DISTINCT x FROM x)) GROUP BY i)
    SELECT vec_id, max(n), sum((n * v - s) * (n * v - s))::BIGINT FROM (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM x) JOIN e USING (i) GROUP BY 1"""
    assert {x[0]: (x[2], x[3]) for x in found} == {i: (n, d) for i, n, d in duckdb.sql(sql).fetchall()}
