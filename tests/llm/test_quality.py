"""Shrinkage against the formula, and held-out quality."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import quality, queries


def test_rates_follow_the_formula(spark):
    docs = [(i, "some plain words here", f"h{i % 3}", f"p{i % 2}") for i in range(60)] + [(100, "new", "h9", "p0"), (101, "x", "h0", "p9"), (None, None, None, None)]
    labels = [(i, int(i % 3 != 0 or i % 4 == 0), 0) for i in range(48)]
    d = spark.createDataFrame([(*r, 1.0, "c") for r in docs], "doc_id long, text string, source string, lang string, score double, y string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, score int")
    got = {r.doc_id: r for r in quality.score(d, lab, F.lit(True)).collect()}
    assert len(got) == len(docs)
    known = {k: y for k, y, _ in labels}
    place = {k: (s, p) for k, _, s, p in docs}
    site = lambda level: {}
    hosts, paths = site(0), site(1)
    for k, y in known.items():
        for table, key in ((hosts, place[k][0]), (paths, place[k])):
            n, g = table.get(key, (0, 0))
            table[key] = (n + 1, g + y)
    rate = (sum(known.values()) + 0.5) / (len(known) + 1)
    frame = lambda t: spark.createDataFrame([(str(k[0] if isinstance(k, tuple) else k), *v) for k, v in t.items()], "host string, n long, good long")
    kh, kp = quality.strength(frame(hosts), []), quality.strength(frame(paths), ["host"])
    for k, r in got.items():
        own = (1, known[k]) if k in known else (0, 0)
        n, g = hosts.get(place[k][0], (0, 0))
        host = (kh * rate + g - own[1]) / (kh + n - own[0])
        n, g = paths.get(place[k], (0, 0))
        path = (kp * host + g - own[1]) / (kp + n - own[0])
        assert math.isclose(r.host_rate, host, rel_tol=1e-9) and math.isclose(r.path_rate, path, rel_tol=1e-9)
        odds = math.log(r.doc_score / (1 - r.doc_score)) + math.log(path / (1 - path)) - math.log(rate / (1 - rate))
        assert math.isclose(r.score, 1 / (1 + math.exp(-odds)), rel_tol=1e-6) and r.keep == int(r.score >= 0.5)


def test_strength(spark):
    frame = lambda rows: spark.createDataFrame(rows, "host string, n long, good long")
    whole = lambda rows: quality.strength(frame([("h", *r) for r in rows]), [])
    apart, alike = whole([(100, 95), (100, 5), (100, 90)]), whole([(100, 50), (100, 51), (100, 49)])
    assert apart < 10 and alike == quality.STRENGTH[1] and quality.strength(frame([]), ["host"]) == quality.STRENGTH[1]
    # Hosts far apart, paths alike within each: only the spread within hosts counts for paths.
    nested = [("a", 100, 90), ("a", 100, 91), ("b", 100, 10), ("b", 100, 9)]
    assert quality.strength(frame(nested), []) < 10 and quality.strength(frame(nested), ["host"]) == quality.STRENGTH[1]
    mixed = [("a", 100, 95), ("a", 100, 5), ("b", 100, 90), ("b", 100, 10)]
    assert quality.strength(frame(mixed), ["host"]) < 10


def plain_features(text):
    data = text.encode()
    size = max(len(data), 1)
    marks = b".,;:'\"-()"
    kinds = [
        sum(97 <= c <= 122 or c >= 128 for c in data), sum(65 <= c <= 90 for c in data), sum(48 <= c <= 57 for c in data), sum(c in marks for c in data),
        sum(33 <= c < 127 and not chr(c).isalnum() and c not in marks for c in data),
    ]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    n = max(len(words), 1)
    return words, [k / size for k in kinds] + [sum(map(len, words)) / n / 10, len(set(words)) / n, None, math.log1p(len(words)) / 10]


def test_classifier_against_plain_code(spark):
    random.seed(3)
    texts = ["", "One TWO, three! 44", "é à ü -- (x)", "a a a a b\tb\n b"] + [" ".join(random.choices(["good", "Words", "here,", "12", "%%", "x."], k=random.randint(1, 30))) for _ in range(60)]
    joined = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = quality.features(np.frombuffer(joined, np.uint8), offsets)
    for row, text in zip(got, texts):
        words, want = plain_features(text)
        neighbours = {(a, b) for a, b in zip(words[:-1], words[1:])}
        for value, expected in zip(row, want):
            assert expected is None or math.isclose(value, expected, abs_tol=1e-12)
        # Each word with the one before it; the first one's is the last word of the text before.
        assert abs(row[7] * max(len(words), 1) - len(neighbours)) <= 1
    labels = [(i, int(i % 2)) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "h", "p") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    weights = quality.fit_logistic(got, np.array([float(i % 2) for i in range(len(texts))]))
    scored = {r.doc_id: r.doc_score for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).collect()}
    scale = np.array([1, 4, 10, 4, 10, 1, 1, 1, 1])
    for i, row in enumerate(got):
        z = row * scale
        evidence = float(np.clip(np.concatenate([z, z * z, [1.0]]) @ weights, -12, 12))
        assert abs(scored[i] - 1 / (1 + math.exp(-evidence))) < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 1), (1, 7)]])
def test_few_labels(spark, labels):
    d = spark.createDataFrame([(1, "a b", "h", "p"), (1, "a b", "h", "p"), (2, "", None, "p"), (3, "x " * 40000, "h", None)], "doc_id long, text string, source string, lang string")
    got = quality.score(d, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).collect()
    assert len(got) == 4 and all(0 < r.score < 1 and r.doc_score == 0.5 for r in got)
    assert quality.score(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True)).count() == 0


def test_held_out_quality(spark):
    path = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("keep")).cast("int"))).first()[0] > 0.93
