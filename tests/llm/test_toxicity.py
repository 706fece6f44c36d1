"""The kernel against counting subsequences, and held-out toxicity."""

import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import queries, toxicity


def plain(s, t, order, decay):
    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if [s[i] for i in a] == [t[i] for i in b]:
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    rng = np.random.default_rng(1)
    marks = [b"idiot", b"scum", b"abcab"]
    for order in (2, 3, 4):
        for _ in range(20):
            s = bytes(rng.choice(list(b"idotscumab"), rng.integers(0, 9)).tolist())
            row = np.frombuffer(s.ljust(toxicity.UNIT_BYTES, b"\0"), np.uint8)[None]
            got = toxicity.kernel(row, marks, order, 0.7)[0]
            assert np.allclose(got, [plain(s, z, order, 0.7) / max(len(s) / len(z), 1) for z in marks], rtol=1e-4)


def machine():
    words = "the of and on as it house tree walk green river stone idea moon".split()
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(240):
        text = list(rng.choice(words, 30))
        bad = i % 3 == 0
        if bad:
            for w in rng.choice(["idiot", "moron", "scumbag"], 3):
                text[rng.integers(30)] = w
        texts.append((" ".join(text) + ". " + " ".join(rng.choice(words, 20)) + ".").encode())
        labels.append(bad)
    return toxicity.train(texts, labels)


def score(m, text):
    data = text.encode()
    return float(m.score(*toxicity.Scorer(m).margins(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0])


def forms(w):
    """Gapped, spaced and inserted forms of a word."""
    m = len(w) // 2
    return [
        w, w.upper() + "!", "-".join(w), ".".join(w), "_".join(w), " ".join(w), ". ".join(w), w[:m] + "x" + w[m:], w[:m] + "1" + w[m:], w[:m] + "-" + w[m:], w[:m] + "##" + w[m:],
        w[:m] + w[m] * 2 + w[m:], w + "s", f'"{w}"', f"({w[:1]}-{w[1:]})", w[:1] + "z" + w[1:],
    ]


def test_plain_gapped_and_spaced_insults():
    m = machine()
    clean = [score(m, t) for t in ("", "the house on the green river", "it walks. as stone", "nice weather", "a tree, 1 2 3 4", "...", "stone " * 3000)]
    assert max(clean) < 0.5 < min(score(m, t) for t in ("you idiot", "the IDIOT. walks", "what a moron!", "i d i o t on the tree", "the " * 5000 + "idiot"))
    assert min(score(m, f"you {f} on the river") for w in ("idiot", "moron") for f in forms(w)) > 0.5


def whole_scores(rows, labels, usable):
    """Scores by plain code: units, kernel by subsequences, margins by sentence; only the fitted numbers are the machine's."""
    texts = sorted((k, t) for k, t in rows if t is not None and k in labels and usable(k))
    m = toxicity.train([t.encode() for _, t in texts], [bool(labels[k]) for k, _ in texts])
    known = {}

    def similar(unit):
        if unit not in known:
            def like(p, z):
                return plain(p, z, 4, 0.75) / plain(z, z, 4, 0.75) / max(len(p) / len(z), 1)

            pieces = [unit[i : i + 24] for i in range(0, max(1, len(unit) - 12), 12)] if len(unit) > 24 else [unit]
            known[unit] = np.array([max(like(p, z) for p in pieces) if w else like(unit[: len(z) + 1], z) for z, w in zip(m.landmarks, m.whole)])
        return known[unit]

    out = {}
    for k, t in rows:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        sentences, words_, singles, runs = [[]], 0, [], []
        for line in low.split(b"\n"):
            for w in [x for x in re.split(rb"[\x20\x09-\x0D]+", line) if x]:
                words_ += 1
                unit = bytes(c for c in w if c > 127 or chr(c).isalnum())
                sentences[-1].append(unit)
                singles.append((len(unit) == 1 and len(w) <= 3, unit, len(sentences) - 1))
                if w[-1:] in b".!?":
                    sentences.append([])
            if sentences[-1]:
                sentences.append([])
        at = 0
        while at < len(singles):
            end = at
            while end < len(singles) and singles[end][0]:
                end += 1
            if end - at >= 3:
                runs.append((singles[at][2], b"".join(u for _, u, _ in singles[at:end])))
            at = max(end, at + 1)
        best = [np.max([similar(u) for u in [*s, *(u for j, u in runs if j == i)]], axis=0) for i, s in enumerate(sentences) if s]
        margins = [float(b @ m.alpha + m.bias) for b in best] or [m.bias]
        near = max((float(b[m.sure].max()) for b in best), default=0.0) if len(m.sure) else 0.0
        found = min(max((near - 0.34) / (0.56 - 0.34), 0), 1)
        hits = sum(bool(((similar(u) >= 0.75) & ~m.whole).any()) for s in sentences for u in s) if words_ else 0
        past, worst = sum(x > 0 for x in margins) if words_ else 0, max(margins)
        z = m.curve @ [np.log1p(past), np.log(words_ + 3) * (1 - max(min(max(worst / 3, 0), 1), found)), found, np.log((hits + 0.5) / (words_ / 1000 + 0.5))] + m.shift
        out[k] = z
    return out


def test_whole_query_against_plain_code(spark, tmp_path):
    words_ = "the of and on as it house tree walk river stone idea".split()
    rng = np.random.default_rng(6)
    rows, labels = [(900, None), (901, ""), (902, "I D I O T. you"), (903, "st-one id-iot! x")], []
    for i in range(60):
        text = list(rng.choice(words_, 12)) + (["idiot,", "mo-ron"] if i % 3 == 0 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text) + ".\n" + " ".join(rng.choice(words_, 4))))
        labels.append((i, int(i % 3 == 0)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    usable = lambda k: zlib.crc32(str(k).encode()) % 5 != 0
    known = dict(labels)
    want = whole_scores(rows, known, usable)
    train = [known[k] for k, _ in rows if k in known and usable(k)]
    moved = np.log(sum(train) / (len(train) - sum(train))) - np.log(np.mean(train) / (1 - np.mean(train)))  # all labelled rows are in the sample
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, z in want.items():
        assert abs(got[k].score - 1 / (1 + np.exp(-(z + moved)))) < 2e-3 and got[k].predicted == int(got[k].score >= 0.5) and got[k].held_out == (not usable(k))


def test_frame(spark):
    m = machine()
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "moron here"), (4, "plain words"), (5, "x" * 100000), (6, "\n\n . "), (7, "the tree " * 30000 + "idiot")]
    df = spark.createDataFrame([(*r, 9, "p") for r in rows], "doc_id long, text string, score int, predicted string")
    got = toxicity.score(df, m).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 1)]
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.limit(0), m).count() == 0
    none = toxicity.score(df, None).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (9, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels.limit(0), F.lit(True)) is None
    toxicity.score(df, toxicity.fit(df, labels, F.col("doc_id").isNotNull())).collect()


def test_letters_put_in_at_any_length():
    """Insults with a letter or two put in, in clean words of ordinary length."""
    m, rng = machine(), np.random.default_rng(7)
    words_ = "the of and on as it house tree walk green river stone idea moon".split()
    for n in (4, 50, 200, 400):
        text = lambda w: " ".join([*rng.choice(words_, n), w])  # noqa: B023, E731
        share = [np.mean([score(m, text(toxicity.put_in(w, k, 1000 + i).decode())) >= 0.5 for w in (b"idiot", b"moron", b"scumbag") for i in range(30)]) for k in (0, 1, 2)]
        assert share[0] == 1 and share[1] >= 0.9 and share[2] >= 0.6, (n, share)
        assert np.mean([score(m, text("moon")) >= 0.5 for _ in range(50)]) == 0


def test_one_large_text_changes_no_other_score(spark):
    words_ = "the of and on as it house tree walk river stone idea".split()
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(words_, 12)) + (" you idiot" if i % 3 == 0 else "")) for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(121)]
    kind = "doc_id long, text string"
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    a = toxicity.fit(spark.createDataFrame(rows, kind), known, F.lit(True))
    b = toxicity.fit(spark.createDataFrame([*rows, (120, "you idiot. " * 1_700_000)], kind), known, F.lit(True))
    tests = ["you idiot", "the house", "tree " * 300, "river idixot stone"]
    assert max(abs(score(a, t) - score(b, t)) for t in tests) < 0.02 and score(b, "you idiot") > 0.9


def test_landmarks_are_not_cut_within_a_character():
    texts = [f"réeuxñ{s} réeuxñ{s}{s} of".encode() for s in "abcdefghij"] * 3 + [b"of the and"] * 30
    marks, _, _ = toxicity.choose_landmarks(texts, np.array([True] * 30 + [False] * 30))
    assert marks and all(z.decode() for z in marks)


def test_table_bound_changes_nothing():
    m = machine()
    text = " ".join(f"idiot{i} the moron tree{i}." for i in range(300)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    assert np.allclose(toxicity.Scorer(m, 50).margins(data, offsets), toxicity.Scorer(m).margins(data, offsets))


def test_held_out_toxicity(spark):
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in queries.op10_toxicity(spark, path).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    bad, good = [r.score for r in got if labels[r.doc_id]], [r.score for r in got if not labels[r.doc_id]]
    area = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    assert area > 0.96 and np.mean([s >= 0.5 for s in good]) < 0.015 and np.mean([s >= 0.5 for s in bad]) > 0.8
