"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward gated recurrent layer read the bytes of a text; at each
position a softmax over both states labels the position, and a document's
probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time with Adam.

Fitting sample: at most ``ROWS_A_LANGUAGE`` labelled training rows a language,
those of lowest hash of the id, with their whole texts; at most ``SAMPLE_BYTES`` of
text a language, and one row at least. Training draws stretches anywhere in them. Prediction covers every byte of every text,
cut into windows of ``WINDOW`` bytes that start from zero states, so memory doesn't
grow with a text's length: a label sees its window, not past it. More than
``common.MOST_GROUPS`` different labels are an error.

Null texts and texts without a letter are ``und`` with score 0. Rows without an
id are predicted, but never learned from, and count as not held out. Repeated
rows give a result each. Without labelled rows every text is ``und``. Of languages of
equal probability the first in alphabetical order is predicted. Extra columns aren't
read (``keep`` hands them on); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import bounded_sample, quoted, slices, written

ROWS_A_LANGUAGE = 384
SAMPLE_BYTES = 1 << 22
#: Bytes of all languages' samples: many languages have less each.
ALL_BYTES = 1 << 27
#: Stretches of a text that an epoch draws.
DRAWN = 2
WINDOW = 128
#: Windows that go through the network together.
BATCH = 2048
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights. Of each direction: byte tables, recurrent matrices and a candidate bias, for the gates r, z and the candidate n."""

    languages: list[str]
    inputs: np.ndarray  # direction, gate, byte, unit
    states: np.ndarray  # direction, gate, unit, unit
    bias: np.ndarray  # direction, unit
    out: np.ndarray  # direction, unit, language
    out_bias: np.ndarray  # language

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.bias, self.out, self.out_bias]


def fresh(languages: list[str], units: int = 8, seed: int = 7) -> Network:
    """Untrained weights."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        languages,
        draw(2, 3, 256, units, scale=0.3),
        draw(2, 3, units, units, scale=units**-0.5),
        np.zeros((2, units), np.float32),
        draw(2, units, len(languages), scale=units**-0.5),
        np.zeros(len(languages), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def loss_and_gradients(net: Network, codes: np.ndarray, mask: np.ndarray, label: np.ndarray):
    """Mean cross-entropy of all positions and its gradients; codes and mask are time by batch."""
    steps, batch = codes.shape
    units = net.bias.shape[1]
    kept = []
    states = np.zeros((2, steps, batch, units), np.float32)
    for d in range(2):
        h = np.zeros((batch, units), np.float32)
        trace = {}
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            r = _sigmoid(net.inputs[d, 0][codes[t]] + h @ net.states[d, 0])
            z = _sigmoid(net.inputs[d, 1][codes[t]] + h @ net.states[d, 1])
            m = h @ net.states[d, 2] + net.bias[d]
            n = np.tanh(net.inputs[d, 2][codes[t]] + r * m)
            trace[t] = (h, r, z, m, n)
            h = (n + z * (h - n)) * mask[t][:, None]
            states[d, t] = h
        kept.append(trace)
    logits = states[0] @ net.out[0] + states[1] @ net.out[1] + net.out_bias
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    total = mask.sum()
    right = p[:, np.arange(batch), label]
    loss = -(np.log(right + 1e-9) * mask).sum() / total
    delta = p
    delta[:, np.arange(batch), label] -= 1
    delta *= (mask / total)[:, :, None]
    grads = [np.zeros_like(w) for w in net.weights()]
    grads[4] += delta.sum((0, 1))
    for d in range(2):
        grads[3][d] = np.einsum("tbu,tbk->uk", states[d], delta, optimize=True)
        back = delta @ net.out[d].T
        carry = np.zeros((batch, units), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, r, z, m, n = kept[d][t]
            g = (carry + back[t]) * mask[t][:, None]
            dz = g * (h - n) * z * (1 - z)
            dn = g * (1 - z) * (1 - n * n)
            dm = dn * r
            dr = dn * m * r * (1 - r)
            carry = g * z
            for gate, dg, into in ((0, dr, dr), (1, dz, dz), (2, dn, dm)):
                np.add.at(grads[0][d, gate], codes[t], dg)
                grads[1][d, gate] += h.T @ into
                carry += into @ net.states[d, gate].T
            grads[2][d] += dm.sum(0)
    return float(loss), grads


def stretches(text: bytes, steps: int, count: int, rng: np.random.Generator) -> list[bytes]:
    """``count`` stretches of a text drawn at random, or all of them if there are no more; the last one may be short."""
    n = -(-len(text) // steps)
    pick = range(n) if n <= count else rng.choice(n, count, replace=False)
    return [text[i * steps : (i + 1) * steps] for i in pick]


def train(texts: list[bytes], labels: list[str], units: int = 8, steps: int = 64, batch: int = 128, epochs: int = 10, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network to whole labelled texts by backpropagation through time.

    Each epoch draws ``DRAWN`` stretches of ``steps`` bytes from every text, anywhere in it, so that
    a long text doesn't outweigh short ones.
    """
    languages = sorted(set(labels))
    net = fresh(languages, units, seed)
    rng = np.random.default_rng(seed)
    names = {name: i for i, name in enumerate(languages)}
    sizes = sum(min(DRAWN, -(-len(t) // steps)) for t in texts)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    done, total = 0, epochs * -(-sizes // batch)
    for _ in range(epochs if sizes else 0):
        cuts = [(cut, names[name]) for text, name in zip(texts, labels) for cut in stretches(text, steps, DRAWN, rng)]
        codes = np.frombuffer(b"".join(c.ljust(steps, b"\0") for c, _ in cuts), np.uint8).reshape(-1, steps).astype(np.intp)
        mask = (np.arange(steps) < np.array([len(c) for c, _ in cuts])[:, None]).astype(np.float32)
        label = np.array([n for _, n in cuts])
        order = rng.permutation(len(codes))
        for at in range(0, len(codes), batch):
            pick = order[at : at + batch]
            _, grads = loss_and_gradients(net, codes[pick].T, mask[pick].T, label[pick])
            done += 1
            pace = rate * (1 - 0.9 * done / total)
            for w, g, a, b in zip(net.weights(), grads, first, second):
                np.clip(g, -1, 1, out=g)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (pace * (a / (1 - 0.9**done)) / (np.sqrt(b / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """A trained network laid out for prediction; gate weights are halved for a sigmoid by tanh."""

    def __init__(self, net: Network, batch: int = BATCH, window: int = WINDOW):
        self.net, self.batch, self.window = net, batch, window
        half = np.array([0.5, 0.5, 1.0], np.float32)[None, :, None, None]
        self.inputs = np.ascontiguousarray(net.inputs * half)
        self.states = np.ascontiguousarray(net.states * half)
        self.units = net.bias.shape[1]

    def _run(self, codes: np.ndarray, mask: np.ndarray | None, d: int) -> np.ndarray:
        """States of one direction: time, window, unit."""
        steps, n = codes.shape
        held = np.empty((steps, n, self.units), np.float32)
        h = np.zeros((n, self.units), np.float32)
        r, z, c, m = (np.empty_like(h) for _ in range(4))
        (wr, wz, wn), (ur, uz, un), bias = self.inputs[d], self.states[d], self.net.bias[d]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            at = codes[t]
            wr.take(at, 0, r, "clip")
            wz.take(at, 0, z, "clip")
            wn.take(at, 0, c, "clip")
            r += np.matmul(h, ur, out=m)
            np.tanh(r, out=r)
            z += np.matmul(h, uz, out=m)
            np.tanh(z, out=z)
            np.matmul(h, un, out=m)
            m += bias
            m *= 0.5
            r += 1
            r *= m
            c += r
            np.tanh(c, out=c)
            # h = n + sigmoid * (h - n), where sigmoid = (z + 1) / 2
            h -= c
            z += 1
            z *= 0.5
            h *= z
            h += c
            if mask is not None:
                h *= mask[t][:, None]
            held[t] = h
        return held

    def windows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over positions of each window's label probabilities."""
        steps = int(lengths.max())
        at = np.minimum(starts[None, :] + np.arange(steps)[:, None], len(data) - 1)
        codes = data[at].astype(np.intp)
        mask = None if (lengths == steps).all() else (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        logits = self._run(codes, mask, 0).reshape(-1, self.units) @ self.net.out[0]
        logits += self._run(codes, mask, 1).reshape(-1, self.units) @ self.net.out[1]
        logits += self.net.out_bias
        np.exp(logits, out=logits)  # states are within 1, so logits are bounded
        logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
        p = logits.reshape(steps, len(starts), -1)
        if mask is not None:
            p *= mask[:, :, None]
        return p.sum(0)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean label probabilities of each text; zeros where it is empty."""
        sizes = np.diff(offsets)
        count = -(-sizes // self.window)
        owner = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = offsets[owner] + place * self.window
        lengths = np.minimum(self.window, offsets[owner + 1] - starts)
        total = np.zeros((len(sizes), len(self.net.languages)))
        order = np.argsort(-lengths, kind="stable")  # full windows together, then by length
        for at in range(0, len(order), self.batch):
            pick = order[at : at + self.batch]
            np.add.at(total, owner[pick], self.windows(data, starts[pick], lengths[pick]))
        return total / np.maximum(sizes, 1)[:, None]


def training_sample(df: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, rows: int = ROWS_A_LANGUAGE) -> list[tuple[bytes, str]]:
    """At most ``rows`` labelled texts a language, in a fixed order."""
    labelled = df.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("key"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    light = labelled.select("lang", "key", "row", F.octet_length("text").cast("long").alias("n"))
    picked = bounded_sample(light, "lang", "key", rows, "row")
    order = Window.partitionBy("lang").orderBy("key", "row")
    # Light rows, at most ``rows`` a language. A text over a share of the bound takes no room from others; every language has its shortest.
    picked = written(picked)
    room = min(SAMPLE_BYTES, ALL_BYTES // max(1, picked.select("lang").distinct().count()))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("n", "key", "row")) == 1
    small = picked.withColumn("least", least).where((F.col("n") <= room // 16) | F.col("least"))
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    few = written(small.withColumn("fits", (total <= room) | F.col("least")).where("fits").select("lang", "key", "row").distinct())
    # Repeated rows have the same text, so one of each is enough.
    found = labelled.join(few, ["lang", "key", "row"]).groupBy("lang", "key", "row").agg(F.min("text").alias("text")).orderBy("lang", "key", "row")
    return [(r.text.encode(), r.lang) for r in found.collect()]


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    kind = df.schema[id_col].dataType.simpleString()
    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    source = df.select(F.col(id_col), F.col(text_col), letters.alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                fine = batch.column(2).slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool)
                if reader:
                    p = reader.read(data, offsets)
                    names = np.array(net.languages, object)[p.argmax(1)]
                    score = np.clip(p.max(1), 0, 1)
                else:
                    names, score, fine = np.full(end - first, UNDETERMINED, object), np.zeros(end - first), fine & False
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.where(fine, names, UNDETERMINED), pa.string()), pa.array(np.where(fine, score, 0.0))],
                    names=[id_col, "lang_pred", "score"],
                )

    return source.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep(df: DataFrame, net: Network | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a language of at least this score."""
    # Batches are passed on whole, under names by place, so names of other columns don't matter; the check for letters rides along.
    letters = F.coalesce(F.col(quoted(text_col)).rlike("\\p{L}"), F.lit(False))
    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            texts, fine = batch.column(where), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            score = np.zeros(len(fine))
            if reader:
                for first, end, data, offsets in slices(texts):
                    score[first:end] = reader.read(data, offsets).max(1)
            kept = batch.filter(pa.array(fine & (score >= least)))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=[f"c{i}" for i in range(len(kept.columns) - 1)])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema))
    out = df.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)), letters.alias("_letters")).mapInArrow(run, kinds)
    return out.toDF(*df.columns)


def fit(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the usable labelled rows; None where there are none."""
    sample = training_sample(df, usable, id_col, text_col, lang_col)
    return train([t for t, _ in sample], [n for _, n in sample]) if sample else None
