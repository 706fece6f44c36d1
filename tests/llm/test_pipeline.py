"""The pipeline stage by stage: decisions against the operators' brute force, columns, and hard rows."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_decontam import plain as leaks
from tests.llm.test_linededup import plain as deduped
from tests.llm.test_ngramjoin import plain as joined

PATH = "/root/testdata/sf0.001"


def test_whole_small_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, PATH)
        rows = docs.collect()
        if name == "sentencepiece":
            assert {r.doc_id: r.ids for r in rows} == {k: model.encode(t) for k, t in before.items()}
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        listed = sorted(before.items())
        if name == "language_id":
            assert after == {k: after[k] for k in after} and len(after) >= len(before) - 2 and all(before[k] == t for k, t in after.items())
        elif name == "line_dedup":
            want = {k: t for k, t, _, gone in deduped(listed) if not gone or t.replace("\n", " ").strip()}
            assert after == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_join":
            assert sorted(after) == sorted(k for k, _, c in joined(listed) if k == c)
        elif name == "decontamination":
            assert sorted(after) == sorted(set(before) - {k for k, _ in leaks(listed, items)})
        docs = spark.createDataFrame(rows, docs.schema)
        before = after
    run = corpus_pipeline.run(spark, PATH)
    assert sorted(r.doc_id for r in run.select("doc_id").collect()) == sorted(before)


def test_hard_rows(spark):
    prose = "the and of that with this was for in on by as it is from are"
    rows = [(1, prose, "en", "a", 0), (2, prose + " more", "en", "a", 0), (3, None, None, None, None), (4, "", "fr", "a", 0), (5, "12 34", "fr", "a", 0), (None, prose + " words", "fr", None, 1), (1, prose, "en", "a", 0)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, PATH)
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), PATH).count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns


def test_columns_of_any_name_keep_their_values(spark):
    names = ["k", "_drops", "_lines", "_cuts", "n_lines", "n_dropped", "lines0", "_n", "component_id", "row", "name", "first", "n", "id", "key", "score", "lang_pred", "item_id", "words", "hits", "a.b", "back`tick", "c0"]
    prose = ["the and of that with this was for in on by as it is from are", "el perro de la casa es muy grande y come todo el dia por que si", "some other words that are not like the first ones in any way at all"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(prose)] + [(None, "a text without an id but with words of its own kind", "en", "a", 5)] * 2 + [(7, "rows of one id with other words to read today", "en", "a", 3), (7, "of one id the second row with quite different content", "en", "b", 4)]
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in names))
    at = names.index("k")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, PATH)
        assert out.columns == docs.columns
        for r in out.collect():
            i = int(r.k[1:])
            assert r.doc_id == rows[i][0] and list(r)[5:] == [f"{c}{i}" for c in names] and names[at] == "k"
        want = {"language_id": 7, "line_dedup": 7, "ngram_join": 6, "decontamination": 7}[name]
        assert out.count() == want


def test_rows_without_an_id_all_stay(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, text, "x")] * 5 + [(1, text, "x"), (2, text, "x"), (2, text, "x"), (3, "other words here", "x"), (3, "other words here", "x")], "doc_id long, text string, source string")
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in corpus_pipeline.ngram_join(spark, docs, PATH).collect())
    assert got == [(False, 0)] * 5 + [(True, 1), (True, 3)]
