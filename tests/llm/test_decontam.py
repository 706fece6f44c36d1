"""Overlaps against laying every item beside every text, by code of its own."""

import itertools
import random
import re

from tidewake.llm import decontam, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def beside(text, item):
    """Most equal words of a stretch at any alignment, 0 where none holds the item: the rule word by word."""
    n, best = len(item), 0
    if 0 < n < 5:
        return n if text == item else 0
    for shift in range(1 - n, len(text)):
        equal = [0 <= shift + j < len(text) and text[shift + j] == item[j] for j in range(n)]
        if sum(equal) < 4:
            continue
        if n < 10:
            if 10 * sum(equal) >= 8 * n:
                best = max(best, sum(equal))
            continue
        # Any stretch of ten words or more decides; those of 10 and of 15 to 17 words make up what is reported.
        holds = any(10 * sum(equal[a:b]) >= 8 * (b - a) for a in range(n) for b in range(a + 10, n + 1))
        covered = set()
        for m in (10, 15, 16, 17):
            for a in range(n - m + 1):
                if 10 * sum(equal[a : a + m]) >= 8 * m:
                    covered.update(range(a, a + m))
        assert holds == bool(covered)
        run = 0
        for j in range(n):
            run = run + equal[j] if j in covered else 0
            best = max(best, run)
    return best


def plain(docs, items):
    """{(id, item): most equal words}."""
    found = {}
    split = [(name, WORD.findall((text or "").lower())) for name, text in items if name is not None]
    for k, t in docs:
        w = WORD.findall((t or "").lower())
        have = set(w)
        for name, b in split:
            if k is not None and b and len(have & set(b)) * 10 >= min(8, len(set(b)) * 4):
                if matched := beside(w, b):
                    found[k, name] = max(matched, found.get((k, name), 0))
    return found


def test_hard_rows(spark):
    random.seed(1)
    item = [f"b{i}" for i in range(40)]
    changed = list(item)
    for i in (7, 18, 29):
        changed[i] = "other"
    prose = lambda n: " ".join(random.choices([f"w{i}" for i in range(60)], k=n))
    docs = [
        (1, prose(50) + " " + " ".join(item) + " " + prose(30)), (2, prose(20) + " " + " ".join(changed)), (3, " ".join(item[10:24])), (4, prose(400)), (5, None), (6, ""),
        (7, " ".join(item[:6]) + " x " + " ".join(item[20:24])), (None, " ".join(item)), (8, prose(3000) + " " + " ".join(item)), (9, "One two THREE, four; five six."), (9, prose(10)),
        (10, ("B0 " + " ".join(item[1:]).upper() + ".\n") * 3), (11, "one two three four five"), (12, "three four"), (13, "three"), (14, "a three four"), (15, " ".join(item[2:10])),
    ]
    items = [(1, " ".join(item)), (2, "one two three four five six"), (3, None), (4, ""), (5, "three four"), (None, "w1 w2 w3 w4 w5 w6 w7"), (6, " ".join(item)), (7, "three"), (1, "one two three four five six")]
    d = spark.createDataFrame([(*r, "x", 1, "s", 2) for r in docs], "doc_id long, text string, item string, first int, words string, k1 int")
    b = spark.createDataFrame([(*r, 1, "z") for r in items], "item_id long, text string, h int, iw string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.overlaps(d, b).collect()}
    want = plain(docs, items)
    assert got == want and {k for k, _ in want} == {1, 2, 3, 8, 9, 10, 11, 12, 13, 15}
    kept = decontam.clean(d, b).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(k) for k, _ in docs if k not in {k for k, _ in want})
    assert decontam.clean(d, b).columns == d.columns
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0


def replaced_words():
    """Items of 5 to 40 words, each in texts with words replaced: all places up to 17 words, random ones past that; some with too many."""
    random.seed(4)
    items, docs = [], []
    for n in range(5, 41):
        item = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        most = n - -(-8 * n // 10)
        for errors in range(most + 2):
            places = list(itertools.combinations(range(n), errors)) if n <= 17 and errors <= most else [random.sample(range(n), errors) for _ in range(40)]
            for bad in places:
                text = ["q"] * random.randint(0, 3) + [f"e{random.randrange(10**9)}" if j in bad else w for j, w in enumerate(item)] + ["q"] * random.randint(0, 3)
                docs.append((len(docs), " ".join(text), n, errors <= most))
    return items, docs


def test_replaced_words(spark):
    items, docs = replaced_words()
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.overlaps(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    texts = dict(items)
    want = {(k, n): m for k, text, n, _ in docs if (m := beside(text.split(), texts[n].split()))}
    assert got == want
    assert all((k, n) in want for k, _, n, sure in docs if sure)
    assert len(want) < len(docs)


def test_masks_leave_every_placement_free():
    free = lambda masks, n, bad: any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1))
    for n in range(5, 21):
        masks = decontam.MASKS[decontam.item_class(n)]
        assert all(free(masks, n, set(bad)) for bad in itertools.combinations(range(n), n - decontam.needed(n)))


def test_whole_small_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    rows = queries.op5_decontaminate(spark, path).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in rows} == plain(docs, items)
    assert all(r.last_word - r.first_word + 1 >= r.matched for r in rows)
