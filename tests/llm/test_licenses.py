"""The automaton's places against a plain search, its matches against brute force."""

import random
import re

import numpy as np

from tidewake.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text):
    found = WORD.findall(lower(text or ""))
    places = [
        (i, label)
        for phrase, label in licenses.BASE_PHRASES
        for i in range(len(found))
        if found[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(found), sorted(places)


def test_places_of_hard_texts(spark):
    texts = [
        None, "", "...", "Under the MIT License", "under the mit licenses", "x under-the/mit\nLICENSE under the mit license",
        "Apache License, Version 2.0", "apache license version 20", "cc BY-NC cc by nc cc by", "éunder the mit license",
        "under the under the mit license mit license", "word " * 30000 + "CC-BY-NC", "İ under the mit license", "cc by nc" * 3,
    ]
    random.seed(1)
    vocabulary = "under the mit license apache version 2 0 cc by nc licensed x".split()
    texts += [" ".join(random.choices(vocabulary, k=random.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    short = {r.doc_id: r for r in licenses.digest(licenses.scan(df)).collect()}
    assert len(got) == len(short) == len(texts)
    for i, text in enumerate(texts):
        n, places = plain(text)
        assert got[i].n_words == n
        assert sorted((p.first, p.label) for p in got[i].places) == places
        row = short[i]
        assert row.n_base == len(places)
        assert (row.first_word, row.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_matching_statistics():
    random.seed(2)
    templates = [(" ".join(random.choices("abcd", k=random.randint(4, 9))), str(i)) for i in range(6)]
    phrases = [("a b c", "p")]
    machine = licenses.Automaton(phrases, templates)
    every = [t.split() for t, _ in phrases + templates]
    for _ in range(200):
        text = random.choices("abcd", k=25)
        ends = {}
        for end in range(1, len(text) + 1):
            ends[end - 1] = max(k for k in range(end + 1) if any(t[i : i + k] == text[end - k : end] for t in every for i in range(len(t) + 1)))
        maximal = {(n, e) for e, n in ends.items() if n >= licenses.MIN_MATCH and ends.get(e + 1, 0) <= n}
        places, matches = machine.scan([machine.ids[w] for w in text], 0)
        assert {(n, e) for _, n, e in matches} == maximal
        assert sorted(at for _, at in places) == [i for i in range(len(text)) if text[i : i + 3] == ["a", "b", "c"]]


def test_gapped_template_is_covered():
    machine = licenses.Automaton(licenses.BASE_PHRASES, licenses.TEMPLATES)
    text = b"redistribution and use in source and binary forms, with a change or two, are permitted provided that the following conditions are met"
    _, _, spans = licenses.scan_piece(machine, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [(s["label"], s["cover"] >= licenses.MIN_COVER) for s in spans[0] if s["label"] == "bsd"] == [("bsd", True)]


def test_clean_prose_has_no_label(spark):
    docs = spark.createDataFrame([(1, "the use of this software and the work of the public in the source of it all")], "doc_id long, text string")
    assert licenses.digest(licenses.scan(docs)).first().labels == ""


def spans_of(text):
    machine = licenses.Automaton(licenses.BASE_PHRASES, licenses.TEMPLATES)
    data = text.encode()
    return licenses.scan_piece(machine, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[2][0]


def test_every_copy_of_a_notice_has_a_span():
    bsd = licenses.TEMPLATES[11][0]
    gapped = "redistribution and use in source and binary forms with a change or two are permitted provided that the following conditions are met"
    for copies in ([bsd] * 3, [gapped] * 3, [bsd, gapped, bsd], [bsd] * 200):
        for between in (" ", " x " * 100):
            got = [s for s in spans_of(between.join(copies)) if s["label"] == "bsd" and s["cover"] >= licenses.MIN_COVER]
            step = [len(c.split()) for c in copies]
            firsts = [sum(step[:i]) + i * len(between.split()) for i in range(len(copies))]
            assert [(s["first"], s["last"]) for s in got] == [(f, f + n - 1) for f, n in zip(firsts, step)]


def test_other_versions_have_no_versioned_label(spark):
    texts = {
        1: ("licensed under the gnu general public license version 2", "gpl"),
        2: ("licensed under the apache license version 1 1", "apache"),
        3: ("this work is licensed under the gnu general public license version 3", "gpl-3"),
        4: ("licensed under the apache license version 2 0", "apache-2"),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.digest(licenses.scan(docs)).collect()} == {k: label for k, (_, label) in texts.items()}


def test_later_sentences_have_labels():
    text = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    assert [s["label"] for s in spans_of(text) if s["cover"] >= licenses.MIN_COVER] == ["bsd"]


def test_whole_licence_texts(spark):
    mit = next(t for t, label in licenses.TEMPLATES if label == "mit" and len(t.split()) > 100)
    boost = next(t for t, label in licenses.TEMPLATES if label == "boost")
    rows = [(1, "MIT License\n\nCopyright (c) 2020 someone\n\n" + mit), (2, boost), (3, "a permission is hereby granted free of charge to any friend"), (4, " ".join(mit.split()[:90]) + " x " * 300 + " ".join(mit.split()[90:]))]
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "mit", 2: "boost", 3: "", 4: "mit"}
