"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts of all
training tokens come from one grouped aggregation. The model's latent states
emit classes: each of the ``MODEL_WORDS`` most frequent words (and the end) is
a class of its own, other words fall into ``BUCKETS`` classes by hash, within
which a word has its smoothed share of the class's count. The likelihood of a
text therefore splits exactly into that of its classes, which needs a bounded
table only, and a sum over its words' shares.

Baum-Welch: every task adds up expected emissions and transitions of its texts
by scaled forward and backward recursions; Spark sums them over tasks, and the
driver gets one bounded table a round. The start comes from rounds over a
sample of about ``SAMPLE_TEXTS`` texts (those of lowest hash, at most
``SAMPLE_BYTES``); rounds over all training texts follow until one gains less than
``TOLERANCE`` a token in log-likelihood, ``ROUNDS`` at most.

Scoring: counts of the ``HOT_WORDS`` most frequent words go to every task
(bounded by that number); all other tokens meet the whole count table in a
shuffled join, so any size of vocabulary works. The recursion runs in blocks of
``BLOCK`` tokens: products of a block's matrices first, for all blocks at once,
then vectors from block to block; no text is cut.

Null texts are empty: one end. Rows without an id are scored, not learned from,
and not held out. Repeated rows give a result each; extra columns aren't read; an
empty table gives no rows. Without training texts the states say nothing. Words of
one count are ordered by hash. Very long texts are hashed and run through in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import checkpoint, most_frequent, slices, words

STATES = 6
MODEL_WORDS = 4096
BUCKETS = 256
HOT_WORDS = 1 << 18
SAMPLE_TEXTS = 400
SAMPLE_ROUNDS = 12
ROUNDS = 3
#: Nats a token.
TOLERANCE = 0.005
#: Bytes of text of the sample, which the driver holds.
SAMPLE_BYTES = 1 << 24
BLOCK = 64
#: The hash of the end; a word's hash is 0 only if its polynomial hash is.
END = np.uint64(0)


class Lookup:
    """Places of known hashes by one probe; hashes that share a slot with a more frequent one are left out."""

    def __init__(self, hashes: np.ndarray, bits: int):
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        at = (hashes >> self.shift).astype(np.int64)
        self.slot[at[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
        self.hashes = hashes

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't known."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = self.slot[(h >> self.shift).astype(np.int64)]
        return np.where((at >= 0) & (self.hashes[at] == h), at, -1).astype(np.int64)


@dataclass
class Model:
    """Bounded tables: frequent words' counts, class counts and vocabularies, and the parameters."""

    hot: np.ndarray  # hashes, most frequent first
    hot_count: np.ndarray
    tokens: int
    vocabulary: int
    own: np.ndarray  # hashes that are classes of their own; the first is the end
    class_count: np.ndarray  # of own words, then of buckets
    class_words: np.ndarray  # distinct words of each bucket
    start: np.ndarray
    move: np.ndarray
    ratio: np.ndarray  # class by state: emission over the class's share

    @property
    def share(self) -> np.ndarray:
        """Smoothed share of each class among training tokens."""
        return (self.class_count + 1.0) / (self.class_count.sum() + len(self.class_count))

    def classes(self, hashes: np.ndarray, lookup: Lookup) -> np.ndarray:
        at = lookup(hashes)
        return np.where(at >= 0, at, len(self.own) + (hashes % np.uint64(BUCKETS)).astype(np.int64))


def with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts with ``end`` after each text, and where each text begins."""
    n = len(first) - 1
    begins = first + np.arange(n + 1)
    out = np.empty(len(values) + n, values.dtype)
    ends = begins[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = values
    out[ends] = end
    return out, begins


class Blocks:
    """Texts cut into blocks of BLOCK tokens: longest first, so that step t runs over a leading part."""

    def __init__(self, begins: np.ndarray, size: int = BLOCK):
        length = np.diff(begins)
        count = -(-length // size)
        self.text = np.repeat(np.arange(len(length)), count)
        place = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)
        starts = begins[self.text] + place * size
        sizes = np.minimum(size, begins[self.text + 1] - starts)
        order = np.argsort(-sizes, kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order] = np.arange(len(order))
        self.starts, self.sizes, self.first = starts[order], sizes[order], (place == 0)[order]
        self.steps = int(sizes.max()) if len(sizes) else 0
        self.active = [int(np.searchsorted(-self.sizes, -t, side="left")) for t in range(self.steps)]
        # The j-th block of each text that has one, as places in the order above.
        by_text = np.argsort(-count, kind="stable")
        self.texts = by_text
        heads = (np.cumsum(count) - count)[by_text]
        self.levels = []
        for j in range(int(count.max()) if len(count) else 0):
            n = int(np.searchsorted(-count[by_text], -j, side="left"))
            self.levels.append(self.rank[heads[:n] + j])


def products(model: Model, codes: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Scaled matrix product of each block, and the log of its scale."""
    s = len(model.start)
    n = len(blocks.starts)
    logs = np.zeros(n)
    eye = np.broadcast_to(np.eye(s), (n, s, s))
    out = np.where(blocks.first[:, None, None], eye, model.move[None])
    for t in range(blocks.steps):
        k = blocks.active[t]
        m = out[:k]
        if t:
            m = (m.reshape(-1, s) @ model.move).reshape(k, s, s)
        m = m * model.ratio[codes[blocks.starts[:k] + t]][:, None, :]
        if t % 4 == 3 or t >= blocks.steps - 1 or k < n:
            scale = m.sum((1, 2))
            m /= scale[:, None, None]
            logs[:k] += np.log(scale)
        out[:k] = m
    return out, logs


def forward(model: Model, blocks: Blocks, product: np.ndarray, logs: np.ndarray, n_texts: int):
    """State vectors before each block, and each text's log-likelihood of class ratios."""
    before = np.zeros((len(blocks.starts), len(model.start)))
    total = np.zeros(n_texts)
    v = np.broadcast_to(model.start, (n_texts, len(model.start))).copy()
    for level in blocks.levels:
        n = len(level)
        before[level] = v[:n]
        moved = np.einsum("ns,nst->nt", v[:n], product[level])
        scale = moved.sum(1)
        v[:n] = moved / scale[:, None]
        total[blocks.texts[:n]] += np.log(scale) + logs[level]
    return before, total


def expected(model: Model, codes: np.ndarray, begins: np.ndarray):
    """Expected emissions (class by state), moves and starts of the texts, and their log-likelihood of ratios."""
    s, n_texts = len(model.start), len(begins) - 1
    blocks = Blocks(begins)
    product, logs = products(model, codes, blocks)
    before, total = forward(model, blocks, product, logs, n_texts)
    after = np.ones((len(blocks.starts), s))
    for j in range(len(blocks.levels) - 1, 0, -1):
        level = blocks.levels[j]
        prior = blocks.levels[j - 1][: len(level)]
        back = np.einsum("nst,nt->ns", product[level], after[level])
        after[prior] = back / back.sum(1, keepdims=True)
    n = len(blocks.starts)
    alpha = np.zeros((blocks.steps, n, s))
    v = before.copy()
    for t in range(blocks.steps):
        k = blocks.active[t]
        u = v[:k] @ model.move
        if t == 0:
            u[blocks.first] = v[blocks.first]
        u *= model.ratio[codes[blocks.starts[:k] + t]]
        u /= u.sum(1, keepdims=True)
        v[:k] = alpha[t, :k] = u
    emitted = np.zeros((len(model.ratio), s))
    moves, starts = np.zeros((s, s)), np.zeros(s)
    beta = after.copy()
    for t in range(blocks.steps - 1, -1, -1):
        k = blocks.active[t]
        at = codes[blocks.starts[:k] + t]
        gamma = alpha[t, :k] * beta[:k]
        gamma /= gamma.sum(1, keepdims=True)
        for state in range(s):
            emitted[:, state] += np.bincount(at, gamma[:, state], len(emitted))
        y = model.ratio[at] * beta[:k]
        x = alpha[t - 1, :k] if t else before
        if t == 0:
            starts += gamma[blocks.first].sum(0)
            rest = ~blocks.first
            x, y_moved = x[rest], y[rest]
        else:
            y_moved = y
        reach = x @ model.move
        weight = (reach * y_moved).sum(1)
        moves += model.move * ((x / weight[:, None]).T @ y_moved)
        back = y @ model.move.T
        beta[:k] = back / back.sum(1, keepdims=True)
    return emitted, moves, starts, total


def updated(model: Model, emitted: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> Model:
    """Parameters from expected counts, smoothed by class shares and even moves."""
    share = model.share[:, None]
    emission = (emitted + 10.0 * share) / (emitted.sum(0) + 10.0)
    move = (moves + 1.0) / (moves.sum(1, keepdims=True) + len(starts))
    start = (starts + 1.0) / (starts.sum() + len(starts))
    return Model(**{**model.__dict__, "ratio": emission / share, "move": move, "start": start})


def begin(model_tables: dict, seed: int = 5) -> Model:
    """A model whose states differ at random."""
    rng = np.random.default_rng(seed)
    n = len(model_tables["class_count"])
    ratio = rng.uniform(0.2, 1.8, (n, STATES))
    share = (model_tables["class_count"] + 1.0) / (model_tables["class_count"].sum() + n)
    ratio /= (ratio * share[:, None]).sum(0)
    move = np.full((STATES, STATES), 0.2 / (STATES - 1)) + np.eye(STATES) * (0.8 - 0.2 / (STATES - 1))
    return Model(**model_tables, start=np.full(STATES, 1 / STATES), move=move, ratio=ratio)


def count_tokens(train: DataFrame, text_col: str) -> DataFrame:
    """(h, c): how often each token's hash stands in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(0), 1 << 22):
                hashes, count = np.unique(words(data, offsets)[2], return_counts=True)
                hashes, count = np.append(hashes, END), np.append(count, end - first)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count)], names=["h", "c"])

    return train.select(F.col(text_col)).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def tables(counts: DataFrame) -> dict:
    """The model's bounded tables, from the whole count table."""
    hot = most_frequent(counts, "c", HOT_WORDS).toPandas().sort_values(["c", "h"], ascending=[False, True])
    hashes, count = hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)
    words_ = hashes != END
    own = np.concatenate([[END], hashes[words_][:MODEL_WORDS]]).astype(np.uint64)
    own = np.concatenate([own[:1], own[1:][Lookup(own[1:], 18)(own[1:]) >= 0]])
    # An own word that shares the end's or another's slot would be no class of its own.
    own = own[np.isin(own, own[Lookup(own, 18)(own) >= 0])]
    by_hash = dict(zip(hashes.tolist(), count.tolist()))
    bucket = F.pmod("h", F.lit(BUCKETS)).cast("int")  # BUCKETS is a power of two, so signs don't matter
    sums = counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        total[r.b], distinct[r.b] = r.c, r.v
    tokens, vocabulary = int(total.sum()), int(distinct.sum())
    own_count = np.array([by_hash.get(int(h), 0) for h in own], float)
    at = (own % np.uint64(BUCKETS)).astype(int)
    np.subtract.at(total, at, own_count)
    np.subtract.at(distinct, at, (own_count > 0).astype(float))
    return {
        "hot": hashes, "hot_count": count, "tokens": tokens, "vocabulary": vocabulary, "own": own,
        "class_count": np.concatenate([own_count, total]), "class_words": distinct,
    }


def fit(train: DataFrame, counts: DataFrame, id_col: str, text_col: str) -> Model:
    """Baum-Welch: rounds over a sample for a start, then rounds over all training texts."""
    model = begin(tables(counts))
    n_texts = int(model.class_count[0])
    if not n_texts:
        return model
    # Twice as many rows as wanted are expected under the bar, of which the lowest are taken; first by their sizes alone.
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40))
    low = train.withColumn("_key", key).where(F.col("_key") < int(min(1.0, 2 * SAMPLE_TEXTS / n_texts) * (1 << 40)))
    sizes = low.select("_key", F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n")).distinct().orderBy("_key", "n").limit(SAMPLE_TEXTS).collect()
    kept, held = [], 0
    for r in sizes:
        # A text that doesn't fit takes no room from those behind it.
        if held + r.n <= SAMPLE_BYTES:
            held += r.n
            kept.append(r._key)
    rows = low.where(F.col("_key").isin(kept)).groupBy("_key").agg(F.min(text_col).alias("t")).orderBy("_key").collect() if kept else []
    texts = [(r.t or "").encode() for r in rows]
    if texts:
        data = np.frombuffer(b"".join(texts), np.uint8)
        _, _, hashes, first = words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        codes, begins = with_ends(model.classes(hashes, Lookup(model.own, 18)), first, 0)
        for _ in range(SAMPLE_ROUNDS):
            model = updated(model, *expected(model, codes, begins)[:3])
    before = None
    for _ in range(ROUNDS):
        model, likelihood = _round(train, model, text_col)
        if before is not None and likelihood - before < TOLERANCE * model.tokens:
            break
        before = likelihood
    return model


def _round(train: DataFrame, model: Model, text_col: str) -> tuple[Model, float]:
    """One round of Baum-Welch over all training texts, and their log-likelihood (of class ratios) before it.

    Tasks' expected counts are summed by Spark.
    """
    shared = train.sparkSession.sparkContext.broadcast(model)
    s, k = STATES, len(model.ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = Lookup(model.own, 18)
        total = np.zeros((k + s + 2, s))
        seen = False
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                _, _, hashes, first = words(data, offsets)
                codes, begins = with_ends(model.classes(hashes, lookup), first, 0)
                emitted, moves, starts, likelihood = expected(model, codes, begins)
                total[:k] += emitted
                total[k : k + s] += moves
                total[k + s] += starts
                total[k + s + 1, 0] += likelihood.sum()
                seen = True
        if seen:
            used = np.flatnonzero(total.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, j].copy()) for j in range(s))], names=["r", *(f"v{j}" for j in range(s))])

    kind = "r int, " + ", ".join(f"v{j} double" for j in range(s))
    rows = train.select(F.col(text_col)).mapInArrow(run, kind).groupBy("r").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(s))).toPandas()
    total = np.zeros((k + s + 2, s))
    total[rows["r"].to_numpy(int)] = rows[[f"v{j}" for j in range(s)]].to_numpy(float)
    return updated(model, total[:k], total[k : k + s], total[k + s]), float(total[k + s + 1, 0])


def _scored(df: DataFrame, model: Model, carried: list[str], text_col: str) -> DataFrame:
    """Per row what the bounded tables give, and the hashes of the tokens that they don't hold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup, hot = Lookup(model.own, 18), Lookup(model.hot, 21)
        log_share = np.log10(model.share)
        log_count = np.log10(np.append(model.hot_count, 0) + 1.0)
        inside = np.zeros(len(model.class_count))
        inside[len(model.own) :] = np.log10(model.class_count[len(model.own) :] + model.class_words + 1.0)
        end_count = model.class_count[0]
        for batch in batches:
            for begin_, stop, data, offsets in slices(batch.column(len(carried))):
                _, _, hashes, first = words(data, offsets)
                n_texts = stop - begin_
                text = np.repeat(np.arange(n_texts), np.diff(first))
                word_codes = model.classes(hashes, lookup)
                codes, begins = with_ends(word_codes, first, 0)
                blocks = Blocks(begins)
                _, ratios = forward(model, blocks, *products(model, codes, blocks), n_texts)
                at = hot(hashes)
                cold = at < 0
                base = np.bincount(text, np.where(cold, 0.0, log_count[at]), n_texts) + np.log10(end_count + 1.0)
                known = np.bincount(text[~cold], minlength=n_texts) + int(end_count > 0)
                bucket = word_codes >= len(model.own)
                score = ratios / np.log(10)
                score += np.bincount(np.repeat(np.arange(n_texts), np.diff(begins)), log_share[codes], n_texts)
                score += np.bincount(text, np.where(bucket, np.where(cold, 0.0, log_count[at]) - inside[word_codes], 0.0), n_texts)
                offsets_cold = np.concatenate([[0], np.cumsum(np.bincount(text[cold], minlength=n_texts))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(begin_, n_texts) for i in range(len(carried))), pa.array(np.diff(begins)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(offsets_cold, pa.array(hashes[cold].view(np.int64)))],
                    names=[*carried, "n_tokens", "known", "base", "model", "cold"],
                )

    return df.select(*carried, F.col(text_col)).mapInArrow(run, f"{kinds}, n_tokens long, known long, base double, model double, cold array<long>")


def score(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every whole text, learning from the ``learned`` rows."""
    docs = docs.select(F.col(id_col), F.col(text_col), learned.alias("learned"))
    train = docs.where("learned")
    counts = checkpoint(count_tokens(train, text_col))
    model = fit(train, counts, id_col, text_col)
    rows = checkpoint(_scored(docs, model, [id_col], text_col)).withColumn("row", F.monotonically_increasing_id())
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)
    cold = (
        rows.select("row", F.explode("cold").alias("h"))
        .join(counts, "h", "left")
        .groupBy("row")
        .agg(F.sum(log).alias("cold_log"), F.count("c").alias("cold_known"))
    )
    per_token = float(np.log10(model.tokens + model.vocabulary + 1.0))
    none = F.lit(0)
    return rows.drop("cold").join(cold, "row", "left").select(
        F.col(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("cold_known", none)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_log", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + F.coalesce("cold_log", F.lit(0.0))).alias("score"),
    )
