"""Line dedup against a plain pass over all pairs of lines."""

import random

from tidewake.llm import linededup


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain(rows):
    """(id, text, n_lines, n_dropped) of each row."""
    first_key = lambda k: (k is not None, k)
    norm = lambda x: x.strip(" ").lower()
    places = [((first_key(k), i), norm(x)) for k, t in rows if t is not None for i, x in enumerate(t.split("\n")) if norm(x)]
    distinct = {}
    for place, x in places:
        distinct[x] = min(place, distinct.get(x, place))
    near = {
        x for x, p in distinct.items() for y, q in distinct.items()
        if q < p and min(len(x), len(y)) >= linededup.CHARS_AN_EDIT and distance_within_one(x, y)
    }
    out = []
    for k, t in rows:
        if t is None:
            out.append((k, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for i, x in enumerate(lines) if not norm(x) or (norm(x) not in near and distinct[norm(x)] >= (first_key(k), i))]
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


NAMES = ["k", "_drops", "_lines", "_cuts", "row", "drops", "lines", "cuts", "k1", "k2", "h1", "at", "id", "first"]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 3, *(f"{c}{i}" for c in NAMES)) for i, r in enumerate(rows)], f"doc_id long, text string, n_lines int, {', '.join(f'{c} string' for c in NAMES)}")
    out = linededup.dedup(df)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(plain(rows), key=str)
    mine = {r.k: r for r in got}
    for i, (k, _) in enumerate(rows):
        assert mine[f"k{i}"].doc_id == k and [mine[f"k{i}"][c] for c in NAMES] == [f"{c}{i}" for c in NAMES]
    assert [r.n for r in linededup.dedup(df, lines_col="n", dropped_col="m").collect()] == [r.n_lines for r in got]


def test_hard_rows(spark):
    base = "a line of quite some length here"
    rows = [
        (1, base + "\n\nshort\nshort\n"), (2, base), (3, base.replace("quite", "quita")), (4, base.replace("quite", "quit")), (5, base + "e"),
        (6, None), (7, ""), (None, "short\n only here"), (8, "  SHORT  \nonly here"), (9, "x\ny"), (9, "x\ny"), (10, "shorx"),
        (11, ("é" * 30 + "\n") * 3), (12, "é" * 29 + "è"), (13, "z" * 24), (14, "z" * 25), (15, "z" * 23), (16, "q" * 20000 + "\n" + "q" * 19999),
        (17, "Z" * 26), (18, "\n\n"), (19, "ab" * 13), (20, "ba" * 13), (21, "b" + "ab" * 12),
    ]
    check(spark, rows)


def test_random_rows(spark):
    random.seed(5)
    lines = ["".join(random.choices("ab ", k=random.randint(0, 30))) for _ in range(25)]
    for _ in range(60):
        x = random.choice(lines)
        i = random.randrange(len(x) + 1)
        lines.append(random.choice([x[:i] + "c" + x[i:], x[:i] + x[i + 1 :], x[:i] + "d" + x[i + 1 :]]))
    check(spark, [(i, "\n".join(random.choices(lines, k=random.randint(1, 6)))) for i in range(80)])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(df).count() == 0 and linededup.dedup(df).columns == ["doc_id", "text", "n_lines", "n_dropped"]
