"""The block recursion against the plain one, counts against a plain count, and a better held-out score."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import hmmlm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model(classes=7, states=hmmlm.STATES, seed=1):
    rng = np.random.default_rng(seed)
    m = hmmlm.begin({"hot": np.zeros(0, np.uint64), "hot_count": np.zeros(0, int), "tokens": 0, "vocabulary": 0, "own": np.zeros(1, np.uint64), "class_count": rng.integers(1, 50, classes).astype(float), "class_words": np.zeros(0)}, seed)
    m.move[:] = rng.dirichlet(np.ones(states), states)
    m.start[:] = rng.dirichlet(np.ones(states))
    return m


def plain(m, codes):
    """Log-likelihood, expected emissions, moves and starts, by the textbook recursions."""
    s, n = len(m.start), len(codes)
    alpha, beta = np.zeros((n, s)), np.ones((n, s))
    alpha[0] = m.start * m.ratio[codes[0]]
    for t in range(1, n):
        alpha[t] = alpha[t - 1] @ m.move * m.ratio[codes[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = m.move @ (m.ratio[codes[t + 1]] * beta[t + 1])
    whole = alpha[-1].sum()
    gamma = alpha * beta / whole
    emitted = np.zeros((len(m.ratio), s))
    np.add.at(emitted, codes, gamma)
    moves = sum((np.outer(alpha[t], m.ratio[codes[t + 1]] * beta[t + 1]) * m.move / whole for t in range(n - 1)), np.zeros((s, s)))
    return math.log(whole), emitted, moves, gamma[0]


def test_recursions():
    m, rng = model(), np.random.default_rng(2)
    lengths = [1, 2, 64, 65, 128, 129, 200, 7]
    texts = [rng.integers(0, 7, n) for n in lengths]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    emitted, moves, starts, total = hmmlm.expected(m, np.concatenate(texts), begins)
    each = [plain(m, t) for t in texts]
    assert np.allclose(total, [e[0] for e in each])
    for got, k in ((emitted, 1), (moves, 2), (starts, 3)):
        assert np.allclose(got, sum(e[k] for e in each))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    codes = np.concatenate([rng.integers(0, 3, 300), rng.integers(3, 7, 300)] * 3)
    begins = np.array([0, 600, 1200, 1800])
    m = model()
    m.class_count[:] = np.bincount(codes, minlength=7) + 1.0
    seen = []
    for _ in range(12):
        emitted, moves, starts, total = hmmlm.expected(m, codes, begins)
        seen.append(total.sum())
        m = hmmlm.updated(m, emitted, moves, starts)
    assert seen[-1] > seen[0] and all(b > a - 1.0 for a, b in zip(seen[2:], seen[3:]))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def check_counts(got, rows, learned):
    tokens = {i: [*WORD.findall(lower(t)), None] for i, (_, t) in enumerate(rows)}
    count = Counter(w for i in tokens if learned[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    want = sorted(((k, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]), 5)) for i, (k, _) in enumerate(rows)), key=str)
    assert sorted(((r[0], r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5) + 0.0) for r in got), key=str) == want
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(hmmlm, "HOT_WORDS", 8)  # so that most words meet the joined table
    monkeypatch.setattr(hmmlm, "MODEL_WORDS", 3)
    rows = [(1, "The cat  sat"), (2, None), (3, ""), (4, "the\tCAT ran away é É"), (4, "the\tCAT ran away é É"), (None, "the unknown"), (5, "new words only"), (6, "the cat " * 15000), (7, "a b c d e f g h i j k")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, h int, row string")
    learned = F.coalesce(F.col("doc_id") != 5, F.lit(False))
    check_counts(hmmlm.score(df, learned).collect(), rows, [k is not None and k != 5 for k, _ in rows])
    check_counts(hmmlm.score(df, F.lit(False)).collect(), rows, [False] * len(rows))
    assert hmmlm.score(df.limit(0), F.lit(True)).count() == 0


def test_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = queries.op6_lm_score(spark, path).collect()
    check_counts(got, rows, [zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_probabilities():
    """Over all texts of up to a few tokens the class probabilities add up to those texts' total mass."""
    m = model(classes=3)
    share = m.share
    end, total, alive = 0, 0.0, m.start * 1.0
    # Ends are class 0: the mass of texts that end at each length is what the chain emits there.
    for _ in range(200):
        total += float(alive @ (m.ratio[end] * share[end]))
        alive = (alive * (m.ratio[1] * share[1] + m.ratio[2] * share[2])) @ m.move
    assert abs(total - 1) < 1e-6
