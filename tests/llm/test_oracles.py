"""Queries of the operators that SQL can express, against their SQL; and what the entry point lists."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidewake.llm import queries

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = queries.queries()[name](spark, PATH)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


#: The columns that a contract fixes, of queries whose other columns SQL can't express.
BASE = {
    "op6_lm_score": r"""
WITH t AS (SELECT doc_id, crc % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w FROM crc_documents),
c AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM t WHERE NOT held_out) GROUP BY 1),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
e AS (SELECT doc_id, held_out, unnest(w) AS w FROM t)
SELECT e.doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 1) / ((n.n + 1)::DOUBLE * 1) ) - log10(n.n + n.v + 1.0) + log10(n.n + 1.0)), 6) AS base_score
FROM e LEFT JOIN c USING (w) CROSS JOIN n GROUP BY 1""",
    "op9_license_scan": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT unnest(['mit', 'apache-2', 'cc-by-nc']) AS label, unnest([['under', 'the', 'mit', 'license'], ['apache', 'license', 'version', '2'], ['cc', 'by', 'nc']]) AS ws),
f AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), p WHERE w[i] = ws[1] AND w[i:i + len(ws) - 1] = ws)
SELECT t.doc_id, CAST(len(any_value(t.w)) AS BIGINT) AS n_words, count(f.place) AS n_base, min(f.place) AS first_word, max(f.place) AS last_word, coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS base_labels
FROM t LEFT JOIN f USING (doc_id) GROUP BY 1""",
}


@pytest.mark.parametrize("name", sorted(BASE))
def test_contract_columns(spark, name):
    import zlib

    con = duckdb.connect()
    documents = con.execute(f"SELECT doc_id, text FROM '{PATH}/documents.parquet'").df()
    con.register("documents", documents)
    con.register("crc_documents", documents.assign(crc=[zlib.crc32(str(k).encode()) for k in documents["doc_id"]]))
    cursor = con.execute(BASE[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    rows = queries.queries()[name](spark, PATH).select(*names).collect()
    got = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(abs(a - b) < 1e-4 if isinstance(a, float) else a == b for a, b in zip(g, w)), (g, w)


def test_one_query_for_each_operator():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in found if re.match(rf"op{n}_", q)]) == 1
    assert found["pipeline"] == corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for path in (root / "tidewake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidewake.llm" not in path.read_text()
