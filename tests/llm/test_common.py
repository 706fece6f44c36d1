"""Vectorised words against plain regular expressions, and the shared samples and filters."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import common

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZ  \t\n\x0b.0é한 "), max_size=20), min_size=1, max_size=6))
def test_words(texts):
    for pattern, kind in ((SPACED, common.NOT_SPACE), (ALNUM, common.LETTERS_DIGITS)):
        for first, end, data, offsets in common.slices(pa.array(texts, pa.string()), 16):
            starts, ends, hashes, at = common.words(data, offsets, kind)
            got = [[lower(bytes(data[starts[i] : ends[i]]).decode()) for i in range(at[k], at[k + 1])] for k in range(end - first)]
            assert got == [pattern.findall(lower(t)) for t in texts[first:end]]
            names = [w for t in texts[first:end] for w in pattern.findall(lower(t))]
            assert len(set(hashes.tolist())) == len(set(names))
            assert hashes.tolist() == common.hash_words(names).tolist() if kind is common.NOT_SPACE else True


def test_slices_cover_every_row():
    texts = pa.array(["", None, "x" * 100, "", "yy", None])
    rows = [(first, end, bytes(data)) for first, end, data, _ in common.slices(texts, 10)]
    assert [r[0] for r in rows][1:] == [r[1] for r in rows][:-1] and rows[-1][1] == 6
    assert b"".join(r[2] for r in rows) == b"x" * 100 + b"yy"
    assert list(common.slices(pa.array([], pa.string()))) == []
    assert [r[:2] for r in common.slices(texts.slice(2, 2), 1000)] == [(0, 2)]


def test_key_filter(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) AS h")
    bits = common.key_filter(keys, "h")
    mine = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(5000, 15000).selectExpr("xxhash64(id) AS h").collect()], np.int64).view(np.uint64)
    assert common.in_filter(bits, mine).all() and common.in_filter(bits, other).mean() < 0.01
    assert not common.key_filter(keys.limit(0), "h").any()


def test_bounded_sample(spark):
    rows = spark.range(5000).selectExpr("id", "xxhash64(id) AS key", "if(id < 40, 'few', 'many') AS g").union(spark.sql("SELECT 1L, 2L, CAST(NULL AS STRING)"))
    got = {r.g: r.n for r in common.bounded_sample(rows, "g", "key", 100, "id").groupBy("g").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {"few": 40, "many": 100}


def test_written_and_checkpoint(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b")
    assert common.written(df).collect() == common.checkpoint(df).collect() == df.collect()


def test_most_frequent(spark):
    counts = spark.range(1, 3001).selectExpr("id AS h", "CAST(3000 / id AS LONG) * 7 AS c")
    want = sorted((int(3000 / i) * 7 for i in range(1, 3001)), reverse=True)
    for limit in (0, 1, 5, 100, 5000):
        got = sorted((r.c for r in common.most_frequent(counts, "c", limit).collect()), reverse=True)
        assert len(got) <= limit and got == want[: len(got)]
    assert len(common.most_frequent(counts, "c", 5000).collect()) == 3000 and common.most_frequent(counts, "c", 5000, 8).count() < 3000


def test_words_across_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(300):
        data = rng.choice(np.frombuffer(b"aAb \n", np.uint8), rng.integers(0, 60))
        offsets = np.sort(np.concatenate([[0, len(data)], rng.integers(0, len(data) + 1, rng.integers(0, 4))]))
        whole = common.words(data, offsets)
        monkeypatch.setattr(common, "BLOCK_BYTES", int(rng.integers(1, 9)))
        parts = common.words(data, offsets)
        monkeypatch.undo()
        assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole, parts))


def test_memory_of_a_long_text():
    import tracemalloc

    data = np.frombuffer(b"some words of a long text. " * 600_000, np.uint8)
    tracemalloc.start()
    common.words(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)
