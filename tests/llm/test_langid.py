"""Gradients against differences, prediction against the training pass, and held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import langid, queries


def test_gradients():
    rng = np.random.default_rng(1)
    net = langid.fresh(["a", "b"], units=3, seed=2)
    for name in ("inputs", "states", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += rng.standard_normal(net.bias.shape)
    codes, mask, label = rng.integers(0, 5, (6, 4)), np.ones((6, 4), np.float32), np.array([0, 1, 1, 0])
    mask[4:, 1] = 0
    _, grads = langid.loss_and_gradients(net, codes, mask, label)
    for weights, grad in zip(net.weights(), grads):
        for at in [tuple(rng.integers(0, k) if k != 256 else rng.integers(0, 5) for k in weights.shape) for _ in range(8)]:
            kept = weights[at]
            sides = []
            for step in (1e-3, -1e-3):
                weights[at] = kept + step
                sides.append(langid.loss_and_gradients(net, codes, mask, label)[0])
            weights[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-3 - grad[at]) < 1e-3


def plain(net, text, window):
    """Mean label probabilities of a text by the recursion as it is written down."""

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    total = np.zeros(len(net.languages))
    for at in range(0, len(text), window):
        cut = text[at : at + window]
        states = []
        for d, order in ((0, range(len(cut))), (1, range(len(cut) - 1, -1, -1))):
            h, held = np.zeros(8), {}
            for t in order:
                r, z = (sigmoid(net.inputs[d, g][cut[t]] + h @ net.states[d, g]) for g in (0, 1))
                n = np.tanh(net.inputs[d, 2][cut[t]] + r * (h @ net.states[d, 2] + net.bias[d]))
                h = (1 - z) * n + z * h
                held[t] = h
            states.append(held)
        for t in range(len(cut)):
            logits = states[0][t] @ net.out[0] + states[1][t] @ net.out[1] + net.out_bias
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / max(1, len(text))


def test_reader_agrees_with_plain_recursion():
    net = langid.train([b"abcabcabc", b"xyzxyzxyz", b"abcab", b"zyx"], ["l", "m", "l", "m"], epochs=3)
    texts = [b"", b"a", b"abcxyz" * 5, b"zzz"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for text, p in zip(texts, langid.Reader(net, batch=2, window=7).read(data, offsets)):
        assert np.allclose(p, plain(net, text, 7), atol=1e-4)


def test_whole_query_against_plain_code(spark, tmp_path):
    rng = np.random.default_rng(4)
    say = {"en": "the of and to in that is".split(), "xx": "zu der die und mit ein".split()}
    rows = [(i, " ".join(rng.choice(say[lang], rng.integers(1, 40))), lang) for i, lang in enumerate(["en", "xx"] * 20)] + [(100, None, "en"), (101, "12 .", "en"), (102, "zu the", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    net = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, text, _ in rows:
        assert got[k].held_out == held(k)
        if not any(c.isalpha() for c in text or ""):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        p = plain(net, text.encode(), langid.WINDOW)
        assert abs(got[k].score - p.max()) < 1e-3 and (got[k].lang_pred == net.languages[p.argmax()] or np.ptp(p) < 1e-3)


def test_sample_holds_whole_texts(spark, monkeypatch):
    rows = [(i, f"text {i} " * (i + 1), "a" if i % 5 else "b") for i in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(df, F.lit(True), "doc_id", "text", "lang", 7)
    assert {t.decode() for t, _ in sample} <= {t for _, t, _ in rows} and sorted({n for _, n in sample}) == ["a", "b"] and len(sample) <= 14
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 1)
    assert len(langid.training_sample(df, F.lit(True), "doc_id", "text", "lang", 7)) == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_hard_rows(spark):
    rows = [(1, "the and of the", "en", 9), (2, None, "en", 9), (3, "", "fr", 9), (4, "123 ...", "fr", 9), (5, "et le la les", "fr", 9), (None, "the of", None, 9), (5, "et le la les", "fr", 9), (6, "the and " * 20000, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = langid.fit(df, F.col("doc_id").isNotNull())
    got = langid.predict(df, net).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    kept = langid.keep(df, net, 0.0).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 5, 5, 6] and kept[0].asDict().keys() == {"doc_id", "text", "lang", "score"}
    assert langid.fit(df.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.keep(df, None, 0.5).count() == 0 and langid.predict(df.limit(0), net).count() == 0
