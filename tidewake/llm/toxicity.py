"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A sentence's units are its lower-cased words without their signs ("i-d-i-o-t" is
the unit "idiot", "st*pid" is "stpid"), and every run of single-character words
read as one unit ("i d i o t"). The gap-weighted subsequence kernel counts the
character subsequences of length ``ORDER`` that a unit shares with a landmark, each
weighted by ``DECAY`` to the power of the stretches it takes in both, over the
landmark's kernel with itself and over how many times the unit is longer:
inserted or dropped characters lower it, but don't lose it. A sentence's similarity
to a landmark is that of its best unit. Nyström's map turns the similarities into
features, on which a linear support vector machine is trained.

Landmarks and machine are learned from at most ``ROWS_A_CLASS`` labelled training
rows of either label (those of lowest hash of the id), so the driver holds a bounded
sample, of at most ``common.SAMPLE_BYTES`` of text; texts over ``common.SAMPLE_TEXT_BYTES``
aren't learned from, and don't change what is. Labels are of texts: a toxic text's sentence with the highest margin and
those past the margin stand for it, chosen anew each round; every sentence of a clean
text is clean. Landmarks that hardly any clean text holds are insults by themselves:
copies of them with characters put in or doubled are further toxic examples. A logistic curve fitted to the sample turns the margin of
a text's worst sentence, the number of its sentences past the margin and that of its
words into a score.

Scoring keeps a table of distinct units with their similarities in each task, emptied
at ``TABLE_ENTRIES`` units. Units longer than ``UNIT_BYTES`` are read in overlapping
stretches. Null, empty and blank texts get the score of a text of no words without
similarities. A score of exactly 0.5 is predicted 1. Very long texts
are scored whole, words hashed in blocks. Rows without an id are scored, not learned
from, and count as not held out; repeated rows give a result each; extra columns
aren't read; an empty table gives no rows. Without rows of both labels every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import LOWER, labelled_sample, slices, words

ROWS_A_CLASS = 1200
LANDMARKS = 24
ORDER = 4
DECAY = 0.75
UNIT_BYTES = 24
TABLE_ENTRIES = 300_000
_BLOCK = 1024
#: Taken out of units: ASCII characters that are neither letters nor digits.
_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Logarithm of how much likelier a landmark's texts are if it marks toxic ones: more than a group of near copies gives
#: its words. Where toxic texts are few, a tenth of their number.
UNLIKELY = 30.0
#: Words with so many bytes in common from their beginning are of one stem.
STEM = 5
#: Landmarks with this logarithm of shares of toxic and clean texts or more are insults by themselves.
SURE = 3.0
#: A margin that no clean text has by chance.
STRONG = 3.0
#: Weights of toxic sentences, of gapped copies of insults, and of clean sentences.
WEIGHTS = (0.08, 0.4, 0.52)
#: Similarity to an insult from which it counts, and from which a text's length no longer does.
NEAR, CERTAIN = 0.34, 0.56
#: Similarity from which a word begins like a landmark, and words of clean text with one such by chance.
LIKE, USUAL = 0.75, 1000
#: Copies for the curve, as a part of its clean texts: with one and with two characters put in.
PUT_IN = (0.3, 0.15)
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".!?"]] = True


def kernel(strings: np.ndarray, landmarks: list[bytes], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of byte rows (zero-padded on the right) with each landmark."""
    n, m = len(strings), len(landmarks)
    width = max(map(len, landmarks))
    # Time-major over the landmark's characters; 0 in a string and 1 in a landmark match nothing.
    marks = np.ones((width, m), np.uint8)
    for j, z in enumerate(landmarks):
        marks[: len(z), j] = np.frombuffer(z, np.uint8)
    out = np.zeros((n, m), np.float32)
    lam, square = np.float32(decay), np.float32(decay * decay)
    size = (strings != 0).sum(1)
    # levels[i][t]: kernel of order i with the landmark's first t characters, gaps to the ends counted
    levels = [np.ones((width + 1, n, m), np.float32)] + [np.zeros((width + 1, n, m), np.float32) for _ in range(order - 1)]
    run, step = np.empty((n, m), np.float32), np.empty((n, m), np.float32)
    for at in range(int(size.max()) if n else 0):
        same = (strings[:, at][None, :, None] == marks[:, None, :]).astype(np.float32)
        same *= square
        for t in range(width):
            np.multiply(levels[order - 1][t], same[t], out=step)
            out += step
        for i in range(order - 1, 0, -1):
            run[:] = 0
            for t in range(width):
                run *= lam
                np.multiply(levels[i - 1][t], same[t], out=step)
                run += step
                cell = levels[i][t + 1]
                cell *= lam
                cell += run
    # A string longer than the landmark meets more subsequences by chance.
    return out / np.maximum(size[:, None] / np.array([len(z) for z in landmarks]), 1).astype(np.float32)


def similarities(units: list[bytes], landmarks: list[bytes], own: np.ndarray, order: int = ORDER, whole: np.ndarray | None = None) -> np.ndarray:
    """Kernel of each unit with each landmark over the landmark's with itself; the best stretch of a long unit.

    Landmarks that aren't ``whole`` are beginnings, which only a unit's own beginning is held against, one character longer than they are.
    """
    if whole is not None and not whole.all():
        out = np.zeros((len(units), len(landmarks)), np.float32)
        for pick in (np.flatnonzero(whole), *np.flatnonzero(~whole)[:, None]):
            marks = [landmarks[i] for i in pick]
            begin = whole[pick].all()
            if len(pick):
                out[:, pick] = similarities(units if begin else [u[: len(marks[0]) + 1] for u in units], marks, own[pick], order)
        return out
    rows, owner = [], []
    for i, u in enumerate(units):
        for at in range(0, max(1, len(u) - UNIT_BYTES // 2), UNIT_BYTES // 2) if len(u) > UNIT_BYTES else (0,):
            rows.append(u[at : at + UNIT_BYTES])
            owner.append(i)
    out = np.zeros((len(units), len(landmarks)), np.float32)
    if not rows:
        return out
    owner = np.array(owner)
    strings = np.frombuffer(b"".join(r.ljust(UNIT_BYTES, b"\0") for r in rows), np.uint8).reshape(-1, UNIT_BYTES)
    # Only a unit that shares ``order`` different or repeated letters with a landmark has a kernel at all.
    present = np.zeros(256, np.uint32)
    for j, z in enumerate(landmarks):
        present[list(z)] |= np.uint32(1 << j)
    bits = present[strings]
    shared = np.zeros((len(rows), len(landmarks)), np.uint8)
    for j in range(len(landmarks)):
        shared[:, j] = ((bits >> np.uint32(j)) & 1).sum(1)
    some = np.flatnonzero((shared >= order).any(1))
    some = some[np.argsort((strings[some] != 0).sum(1), kind="stable")]
    for at in range(0, len(some), _BLOCK):
        pick = some[at : at + _BLOCK]
        np.maximum.at(out, owner[pick], kernel(strings[pick], landmarks, order) / own)
    return out


@dataclass
class Machine:
    """Landmarks, their own kernels, one weight each, a bias, and a logistic curve over a text's figures."""

    landmarks: list[bytes]
    own: np.ndarray
    alpha: np.ndarray
    bias: float
    curve: np.ndarray
    shift: float
    sure: np.ndarray  #: which landmarks are insults by themselves
    whole: np.ndarray  #: whether a landmark is a word and not the beginning of words

    def similar(self, units: list[bytes]) -> np.ndarray:
        return similarities(units, self.landmarks, self.own, whole=self.whole)

    def score(self, margin: np.ndarray, past: np.ndarray, size: np.ndarray, near: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_figures(margin, past, size, near, hits) @ self.curve + self.shift, -40, 40)))


def _figures(margin: np.ndarray, past: np.ndarray, size: np.ndarray, near: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """What the curve sees of texts: sentences past the margin, how long a text is, as a long one meets a word that
    looks like an insult by chance, how near it comes to one, and how many of its words begin as toxic texts' do, beside as many as a clean one has.
    The length counts the less, the higher the margin is and the nearer an insult, and from STRONG or CERTAIN on not at all."""
    found = np.clip((near - NEAR) / (CERTAIN - NEAR), 0, 1)
    return np.stack([np.log1p(past), np.log(size + 3) * (1 - np.maximum(np.clip(margin / STRONG, 0, 1), found)), found, np.log((hits + 0.5) / (size / USUAL + 0.5))], axis=1)


def split_units(data: np.ndarray, offsets: np.ndarray):
    """Units of a piece: (start, end, hash, sentence number, text) of each word, and the runs of single-character words.

    Runs of three such words or more are units of their own: (first word, word
    behind the last); their bytes are those of their words without signs.
    """
    starts, ends, hashes, first = words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # A sentence ends with a word that ends in one of .!? or before a line break or the text's end.
    closes = _SENTENCE[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    breaks = np.flatnonzero(data == 10)
    opens = np.ones(len(starts), bool)
    if len(starts) > 1:
        broken = np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
        opens[1:] = closes[:-1] | (text[1:] != text[:-1]) | broken
    sentence = np.cumsum(opens) - 1
    single = np.zeros(len(starts), bool)
    for i in np.flatnonzero(ends - starts <= 3):  # a character with a sign before or behind it, or both
        single[i] = len(data[starts[i] : ends[i]].tobytes().translate(None, _SIGNS)) == 1
    runs = []
    if single.any():
        edges = np.diff(np.concatenate([[False], single, [False]]).astype(np.int8))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if b - a >= 3 and text[a] == text[b - 1]:
                runs.append((a, b))
    return starts, ends, hashes, sentence, text, runs


def _merged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bytes:
    return LOWER[data[starts[a] : ends[b - 1]]].tobytes().translate(None, _SIGNS)


class Scorer:
    """Similarities of distinct units, kept between texts."""

    def __init__(self, machine: Machine, entries: int = TABLE_ENTRIES):
        self.machine, self.entries = machine, entries
        self.rows: dict[int, int] = {}
        self.table = np.zeros((0, len(machine.landmarks)), np.float32)

    def look_up(self, hashes: np.ndarray, unit) -> np.ndarray:
        """Similarities of distinct hashes; unit(i) gives the bytes of the i-th."""
        keys = hashes.tolist()
        missing = [i for i, h in enumerate(keys) if h not in self.rows]
        if len(self.rows) + len(missing) > self.entries:
            self.rows, self.table, missing = {}, self.table[:0], list(range(len(keys)))
        if missing:
            self.rows.update((keys[i], len(self.table) + k) for k, i in enumerate(missing))
            new = self.machine.similar([unit(i) for i in missing])
            self.table = np.concatenate([self.table, new])
        return self.table[np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))]

    def sentences(self, data: np.ndarray, offsets: np.ndarray):
        """Best similarities of each sentence, each sentence's text, and the number of words and of words that begin like a landmark of each text."""
        starts, ends, hashes, sentence, text, runs = split_units(data, offsets)
        if not len(starts):
            return np.zeros((0, len(self.machine.landmarks)), np.float32), np.zeros(0, int), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        low = LOWER[data].tobytes()
        found = self.look_up(distinct, lambda i: low[starts[one[i]] : ends[one[i]]].translate(None, _SIGNS))
        heads = np.flatnonzero(np.diff(np.concatenate([[-1], sentence])))
        # Most units have no similarity worth keeping; only the others are looked at by sentence.
        best = np.zeros((len(heads), found.shape[1]), np.float32)
        live = np.flatnonzero((found.max(1) > 0)[back])
        if len(live):
            owners = sentence[live]
            cuts = np.flatnonzero(np.diff(np.concatenate([[-1], owners])))
            best[owners[cuts]] = np.maximum.reduceat(found[back[live]], cuts)
        begins = ((found >= LIKE) & ~self.machine.whole).any(1)[back]
        if runs:
            rows = self.machine.similar([_merged(data, starts, ends, a, b) for a, b in runs])
            np.maximum.at(best, sentence[[a for a, _ in runs]], rows)
        count = lambda of: np.bincount(of, minlength=len(offsets) - 1).astype(float)
        return best, text[heads], count(text), count(text[begins])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: the margin of its worst sentence, how many sentences are past the margin, its words, how near it comes to an insult, and its words that begin like a landmark."""
        best, owner, size, hits = self.sentences(data, offsets)
        m = self.machine
        return *text_margins(best @ m.alpha + m.bias, owner, len(offsets) - 1, m.bias), size, nearest(best, m.sure, owner, len(offsets) - 1), hits


def text_margins(each: np.ndarray, owner: np.ndarray, texts: int, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The highest margin of each text's sentences (the bias without any), and how many are past it."""
    worst = np.full(texts, float(bias))
    if len(each):
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
        worst[owner[cuts]] = np.maximum.reduceat(each, cuts)
    return worst, np.bincount(owner[each > 0], minlength=texts).astype(float)


def nearest(best: np.ndarray, sure: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The highest similarity of each text's sentences to a landmark that is an insult."""
    out = np.zeros(texts)
    if len(best) and len(sure):
        np.maximum.at(out, owner, best[:, sure].max(1))
    return out


def choose_landmarks(texts: list[bytes], toxic: np.ndarray, count: int = LANDMARKS) -> tuple[list[bytes], list[bytes], list[bool]]:
    """Words and word beginnings that mark toxic texts, one after another; those of them that are insults by themselves; and which are words.

    A beginning is held by texts with two different words of it, as one may be chance. A candidate gains log(share of toxic texts / share of clean texts) from each
    toxic text that holds it; a text counts half for each landmark it has, so
    that landmarks spread over all kinds of toxic texts. Of words and
    beginnings of one stem one is chosen.
    """
    holders: dict[bytes, set[int]] = {}
    clean: Counter = Counter()
    for i, (text, label) in enumerate(zip(texts, toxic)):
        found, begun = set(), Counter()
        for unit in {word.translate(None, _SIGNS)[:UNIT_BYTES] for word in text.translate(LOWER.tobytes()).split()}:
            begun.update(unit[:k] for k in range(max(ORDER, 5), len(unit)) if unit[k] & 0xC0 != 0x80)  # no cut within a character
            if len(unit) >= ORDER:
                found.add(unit + b"$")
        found.update(u for u, n in begun.items() if n >= 2)
        if label:
            for unit in found:
                holders.setdefault(unit, set()).add(i)
        else:
            clean.update(found)
    bad, good = int(toxic.sum()), int((~toxic).sum())
    rated = {u: np.log(len(d) / bad / ((clean[u] + 0.5) / (good + 1))) for u, d in holders.items() if len(d) >= 3}
    # Among so many candidates some are frequent by chance: what counts is how unlikely that is.
    rated = {u: r for u, r in rated.items() if r > 0.7 and len(holders[u]) * (r - 1 + np.exp(-r)) >= min(UNLIKELY, 0.1 * bad)}
    weight, chosen, sure, whole = np.ones(len(texts)), [], [], []
    while rated and len(chosen) < count:
        gain = {u: r * weight[list(holders[u])].sum() for u, r in rated.items()}
        best = max(gain, key=lambda u: (gain[u], u))
        name, rate = best.rstrip(b"$"), rated.pop(best)
        if not any(z[:STEM] == name[:STEM] for z in chosen):
            chosen.append(name)
            whole.append(best.endswith(b"$"))
            weight[list(holders[best])] *= 0.5
            if best.endswith(b"$") and rate >= SURE:
                sure.append(name)
    return chosen, sure, whole


def gapped(word: bytes) -> list[bytes]:
    """Copies of a word with one or two characters put in or one doubled, inside it."""
    out = []
    for i in range(1, len(word)):
        out += [word[:i] + c + word[i:] for c in (b"x", b"1")] + [word[:i] + word[i - 1 : i] + word[i:]]
        if i + 2 < len(word):
            out.append(word[:i] + b"x" + word[i : i + 2] + b"y" + word[i + 2 :])
    return out


def put_in(word: bytes, count: int, turn: int) -> bytes:
    """A copy of a word with so many letters inside it, which and where follow from the turn."""
    for k in range(count):
        draw = (turn * 7919 + k * 104729 + 13) * 2654435761 % 2**32
        at = 1 + draw // 26 % (len(word) - 1)
        word = word[:at] + bytes([97 + draw % 26]) + word[at:]
    return word


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), 0.0
    total = weight.sum()
    pace = 1 / (1 / c + 2 * ((x * x).sum(1) + 1).max())
    vw, vb = w.copy(), b
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y / total
        nw, nb = vw + pace * (2 * x.T @ slack - vw / (c * total)), vb + pace * 2 * slack.sum()
        beta = (t - 1) / (t + 2)
        vw, vb, w, b = nw + beta * (nw - w), nb + beta * (nb - b), nw, nb
    return w, b


def train(texts: list[bytes], toxic: list[bool], rounds: int = 3) -> Machine | None:
    """Landmarks, a machine over sentences and the curve of text margins; None without both labels."""
    label = np.array(toxic, bool)
    if not label.any() or label.all():
        return None
    landmarks, sure, words_ = choose_landmarks(texts, label)
    whole = np.array(words_, bool)
    if not landmarks:
        return None
    padded = np.zeros((len(landmarks), UNIT_BYTES), np.uint8)
    for i, z in enumerate(landmarks):
        padded[i, : len(z)] = np.frombuffer(z, np.uint8)
    gram = kernel(padded, landmarks)
    own = np.diagonal(gram).copy()
    machine = Machine(landmarks, own, np.ones(len(landmarks)), 0.0, np.zeros(4), 0.0, np.zeros(0, int), whole)
    scorer = Scorer(machine)
    # Piece by piece, so that the driver needs no more than a task.
    parts = [(first, *scorer.sentences(data, offsets)) for first, _, data, offsets in slices(pa.array(texts, pa.binary()).cast(pa.string()))]
    feats = np.concatenate([f for _, f, *_ in parts])
    owner = np.concatenate([o + first for first, _, o, *_ in parts])
    size, hits = (np.concatenate([part[i] for part in parts]) for i in (3, 4))
    # Nyström: features = k(s, Z) K(Z, Z)^(-1/2), with the landmarks' similarities scaled alike
    scaled = (gram / np.sqrt(own[:, None] * own[None, :])).astype(np.float64)
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = feats.astype(np.float64) @ root
    heads = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
    bounds = np.concatenate([heads, [len(owner)]])
    named = owner[heads]
    alpha, bias = np.ones(len(landmarks)), 0.0
    copies = machine.similar([u for z in sure for u in gapped(z)]).astype(np.float64) @ root
    for turn in range(rounds):
        margin = feats @ alpha + bias
        worst = np.array([a + int(np.argmax(margin[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], int)
        clear = margin > 0 if turn else feats.max(1) > 0.9
        bad = np.union1d(worst[label[named]], np.flatnonzero(clear & label[owner]))
        good = np.flatnonzero(~label[owner])
        parts = (x[bad], copies, x[good])
        y = np.concatenate([np.full(len(part), sign) for part, sign in zip(parts, (1.0, 1.0, -1.0))])
        # Clean sentences weigh more in all: toxic ones are chosen, and some of them wrongly.
        weight = np.concatenate([np.full(len(part), share / max(1, len(part))) for part, share in zip(parts, WEIGHTS)]) * len(y)
        w, bias = _hinge(np.concatenate(parts), y, weight)
        alpha = root @ w
    worst, past = text_margins(feats @ alpha + bias, owner, len(texts), float(bias))
    named_sure = np.array([landmarks.index(z) for z in sure], int)
    near = nearest(feats, named_sure, owner, len(texts))
    curve = np.zeros(5)
    # Empty texts are clean; as many as a four-hundredth of the sample say so to the curve.
    empty = np.tile(_figures(np.array([bias]), np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1)), (max(1, len(texts) // 400), 1))
    figures, labelled = [_figures(worst, past, size, near, hits), empty], [label, np.zeros(len(empty))]
    clean = np.flatnonzero(~label)
    for count, part in zip((1, 2), PUT_IN) if sure else ():
        hosts = clean[np.arange(int(part * len(clean))) * 31 % len(clean)]
        seen = machine.similar([put_in(sure[i % len(sure)], count, i) for i in range(len(hosts))])
        margin = seen @ alpha + bias
        figures.append(_figures(np.maximum(worst[hosts], margin), past[hosts] + (margin > 0), size[hosts] + 1, np.maximum(near[hosts], seen[:, named_sure].max(1, initial=0)), hits[hosts]))
        labelled.append(np.ones(len(hosts)))
    figures, y = np.concatenate(figures), np.concatenate(labelled)
    u = np.column_stack([figures, np.ones(len(figures))])
    for _ in range(50):  # Newton steps of a logistic regression, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(u @ curve, -40, 40)))
        h = (u * (p * (1 - p))[:, None]).T @ u + 1e-2 * np.eye(5)
        curve = curve + np.clip(np.linalg.solve(h, u.T @ (y - p) - 1e-2 * curve), -2, 2)
    # Copies put in made toxic texts more of the examples than they are of the texts.
    odds = lambda x: float(np.log(x.mean() / (1 - x.mean())))
    return Machine(landmarks, own, alpha, float(bias), curve[:4], float(curve[4]) + odds(label) - odds(y), named_sure, whole)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS_A_CLASS) -> Machine | None:
    """A machine trained on the usable labelled rows."""
    sample = labelled_sample(docs, labels, usable, id_col, text_col, label_col, rows)
    machine = train([t.encode() for t, _ in sample], [bool(y) for _, y in sample])
    if machine:
        # The sample holds as many rows of either label as there are, up to a bound; scores are for the labels' own shares.
        counts = {r[label_col]: r["count"] for r in labels.where(usable).groupBy(label_col).count().collect()}
        share = sum(y for _, y in sample) / len(sample)
        machine.shift += float(np.log(counts[1] / counts[0]) - np.log(share / (1 - share)))
    return machine


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine) if machine else None
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                p = machine.score(*scorer.margins(data, offsets)) if scorer else np.zeros(end - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(p.astype(float)), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
