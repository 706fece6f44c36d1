"""The trie of conversations against prefixes in a dictionary."""

import hashlib
import random
import re
import zlib

import pytest

from tidewake.llm import prefixtrie

KIND = "conv_id long, turn long, role string, text string, depth string, `a.b` int"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(rows):
    members = {}
    paths = rebuilt(rows)
    for c, ts in paths.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p, m in members.items():
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + cost
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], KIND)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = prefixtrie.trie(*prefixtrie.shared_heads(df))
    assert out.columns == names
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 2)
    monkeypatch.setattr(prefixtrie, "CHUNK", 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, small, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), rng.choice(["hi there", "yes", " ok  then\n go", ""])) for c in rng.sample(range(-30, 90), 60) for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14]))]
    assert found(spark, rows) == plain(rows)


def test_copies_snapshots_and_a_long_one(spark, small):
    long_ = [(1, t, "u", f"turn {t}") for t in range(60)]
    copies = [(100 + c, t, "u", f"turn {t}") for c in range(70) for t in range(6)]
    snapshots = [(300 + c, t, "u", f"s {t}") for c in range(25) for t in range(c + 1)]
    rows = long_ + copies + snapshots
    assert found(spark, rows) == plain(rows)


def test_hard_rows(spark, small):
    rows = [(None, 1, "u", "x"), (1, None, "u", "first"), (1, 2, None, None), (1, 1, "u", "a b"), (1, 1, "u", "a b"), (2, 1, "", ""), (25, 1, "u", "alone"), (26, 1, "u", "alone"), (-40, 3, "u", "minus"), (-41, 3, "u", "minus"), (2**62, 1, "u", "far")]
    rows += [(3, 1, "u", "é wörd " * 30000), (23, 1, "u", "é wörd " * 30000), (23, 2, "a", "\x0b\x0c one \t two\r\nthree")]
    assert found(spark, rows) == plain(rows)
    assert any(len(t) == 0 for t in rebuilt(rows).values())
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []


def test_ties_are_ordered_alike(spark):
    rows = [(c, 1, role, text) for c in (1, 2) for role, text in (("a", "x"), ("b", "y"), ("a", "z"))]
    once, again = found(spark, rows), found(spark, rows[::-1])
    assert once == again


def test_blocks_without_siblings_are_not_grouped_by_turn(spark):
    rows = [(1, t, "u", f"{t}") for t in range(12)]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], KIND)
    turns, members = prefixtrie.shared_heads(df)
    assert [r.n_convs for r in prefixtrie.trie(turns, members).collect()] == [1] * (members.first().length + 1)
