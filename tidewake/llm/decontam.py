"""Benchmark decontamination by spaced-seed hashing.

An item is held by a text where, at one alignment of the two, ``MIN_PART`` of
some stretch of the item are equal words in their places; the stretch has
``SPAN`` words or more, or the whole item where that is shorter. So up to a
fifth of the words may be replaced anywhere, by any others.

Fixed masks lay over consecutive words and ignore some of them; words at a
mask's marked places are hashed together, and hashes of the benchmark and of the
training texts are joined. The masks lose nothing: wherever the replaced words
of such a stretch stand, some mask lies on equal words alone (the tests try all
placements). Around hits the text and the item are laid side by side, and all
windows of ``WINDOWS`` words are counted: any longer stretch that qualifies
holds one of these. Overlapping windows that qualify are one stretch; the one
of most equal words is reported, of ties the first in the text, from its first
equal word to its last.

Training texts are read once. A filter built from the benchmark's hashes drops
nearly all windows in the task that reads them; it only ever lets too many
through, and what passes meets the benchmark's hashes in an exact join. The
words around hits travel with them, so texts are never shuffled; equal passages
of many texts are put together first and compared once.

Items under ``MIN_ITEM`` words say too little to be sought inside texts: they are
only found where they are a whole text, word for word. Items without words and
null or empty texts have no hits. Rows of one id, of texts or of items, are
judged together; rows without an id are never reported. Extra columns aren't
read; empty tables give no rows. Very long texts are read in blocks (see
``words``). Texts are lower-cased; words are runs of ASCII letters and digits
and of any other characters past ASCII, so changed case or punctuation hides
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import LETTERS_DIGITS, checkpoint, in_filter, key_filter, mix, quoted, slices, split_mix, words

#: Words of a stretch, and the part of them that are equal.
SPAN = 10
MIN_PART = 0.8
MIN_ITEM = 5
#: Windows that are counted. Past ten words, only in 15 to 17 can a fifth be replaced with no ten of them below a fifth.
WINDOWS = (10, 15, 16, 17)
#: Masks for items of so many words or more (up to the next entry). Ten words: every two places are free in one of the
#: first five, the last is for three replaced words in the middle of fifteen. Fewer words: every single place is.
MASKS = {
    5: ("1111", "10111", "11011", "11101"),
    7: ("11111", "1100111", "1110011"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111", "111110000011111"),
}
#: Words kept on either side of a hit: no window that holds it reaches further.
AROUND = max(WINDOWS)
#: Rows of a frequent hash or passage are dealt to so many tasks.
SALTS = 8


def item_class(n: int) -> int:
    """The key of the masks that an item of n words is sought with; its own length if it is sought as a whole text."""
    return n if n < MIN_ITEM else max(k for k in MASKS if k <= n)


def seeds(hashes: np.ndarray, first: np.ndarray, classes: tuple[int, ...], own: bool = False):
    """Yield (start word of each window, hash) of the masks of some classes; windows don't leave their text.

    With ``own`` (for items) every text only has the masks of its own class.
    """
    length = np.diff(first)
    end_of = np.repeat(first[1:], length)
    kind = np.array([item_class(int(n)) if n else 0 for n in length], int) if own else None
    for c in classes:
        shapes = [np.arange(c)] if c < MIN_ITEM else [np.array([i for i, x in enumerate(m) if x == "1"]) for m in MASKS[c]]
        for k, marked in enumerate(shapes):
            span = int(marked[-1]) + 1
            n = len(hashes) - span + 1
            if n <= 0:
                continue
            total = np.zeros(n, np.uint64)
            for factor, at in zip(split_mix(100 * c + k, len(marked)), marked):
                total += hashes[at : at + n] * factor
            fits = np.arange(n) + span <= end_of[:n]
            if c < MIN_ITEM:
                fits &= np.repeat(length, length)[:n] == c
            elif own:
                fits &= np.repeat(kind, length)[:n] == c
            starts = np.flatnonzero(fits)
            yield starts, mix(total[starts])


def item_seeds(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, h, at) of every benchmark item: its word hashes and each seed."""
    kind = bench.schema[id_col].dataType.simpleString()
    every = (*range(1, MIN_ITEM), *MASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in slices(batch.column(1)):
                _, _, hashes, first = words(data, offsets, LETTERS_DIGITS)
                owner = np.repeat(np.arange(end - begin), np.diff(first))
                found = [(owner[s], h, s - first[owner[s]]) for s, h in seeds(hashes, first, every, True)]
                if not found:
                    continue
                who, h, at = (np.concatenate(x) for x in zip(*found))
                lists = pa.array([hashes[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin).take(pa.array(who)), lists.take(pa.array(who)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32))], names=["item", "words", "h", "at"])

    return bench.select(F.col(id_col), F.lower(text_col)).mapInArrow(run, f"item {kind}, words array<long>, h long, at int")


def text_hits(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray, classes: tuple[int, ...]) -> DataFrame:
    """(id, first, words, hits) of every stretch of a text that passes the filter."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for begin, end, data, offsets in slices(batch.column(1)):
                _, _, hashes, first = words(data, offsets, LETTERS_DIGITS)
                found = [(s[keep], h[keep]) for s, h in seeds(hashes, first, classes) for keep in (in_filter(bits, h),)]
                at = np.concatenate([s for s, _ in found]) if found else np.zeros(0, int)
                if not len(at):
                    continue
                h = np.concatenate([h for _, h in found])
                order = np.lexsort((h, at))
                at, h = at[order], h[order].view(np.int64)
                owner = np.searchsorted(first, at, side="right") - 1
                apart = np.ones(len(at), bool)
                apart[1:] = (at[1:] - at[:-1] > 2 * AROUND) | (owner[1:] != owner[:-1])
                cuts = np.append(np.flatnonzero(apart), len(at))
                who = owner[cuts[:-1]]
                low = np.maximum(first[who], at[cuts[:-1]] - AROUND)
                high = np.minimum(first[who + 1], at[cuts[1:] - 1] + 2 * AROUND)
                sizes = high - low
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.arange(ends[-1]) + np.repeat(low - ends[:-1], sizes)
                hits = pa.StructArray.from_arrays([pa.array(h), pa.array((at - np.repeat(low, np.diff(cuts))).astype(np.int32))], names=["h", "at"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin).take(pa.array(who)),
                        pa.array((low - first[who]).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[flat].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), hits),
                    ],
                    names=["id", "first", "words", "hits"],
                )

    return docs.select(F.col(id_col), F.lower(text_col)).mapInArrow(run, f"id {kind}, first long, words array<long>, hits array<struct<h:long,at:int>>")


def needed(n: int) -> int:
    """Equal words that a window of n words must have: a fifth may differ."""
    return -(-n * round(100 * MIN_PART) // 100)


def best_stretch(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal words, first, last) of the best stretch, in words of the text, where the item's first word lies at ``shift``; zeros if there is none."""
    n = len(item)
    a, b = max(0, shift), min(len(text), n + shift)
    if a >= b:
        return 0, 0, 0
    equal = np.zeros(n, np.int64)  # words past the text's ends are not equal
    equal[a - shift : b - shift] = text[a:b] == item[a - shift : b - shift]
    total = np.concatenate([[0], np.cumsum(equal)])
    edges = np.zeros(n + 1, np.int64)
    for m in [w for w in WINDOWS if w <= n] if n >= SPAN else [n]:
        starts = np.flatnonzero(total[m:] - total[:-m] >= (needed(m) if n >= MIN_ITEM else n))
        edges[starts] += 1
        edges[starts + m] -= 1
    inside = np.concatenate([[0], np.cumsum(edges)[:-1] > 0, [0]]).astype(np.int8)
    begins, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    if not len(begins):
        return 0, 0, 0
    k = int(np.argmax(total[ends] - total[begins]))
    places = np.flatnonzero(equal[begins[k] : ends[k]]) + begins[k] + shift
    return len(places), int(places[0]), int(places[-1])


def _dealt(*columns: str) -> Column:
    """A part of 0 to SALTS - 1, the same whenever a row is made again."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _everywhere() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, matched, first_word, last_word) of every text and item that overlap; the best stretch of each pair."""
    items = checkpoint(item_seeds(bench.where(F.col(item_col).isNotNull()), item_col, item_text_col))
    lengths = items.select(F.least(F.size("words"), F.lit(max(MASKS))).alias("n")).distinct().collect()
    classes = tuple(sorted({item_class(r.n) for r in lengths}))
    stretches = text_hits(docs.where(F.col(id_col).isNotNull()), id_col, text_col, key_filter(items, "h"), classes)
    # A passage is known by its words and hits, in 128 bits.
    stretches = checkpoint(stretches.withColumn("k1", F.xxhash64("words", "hits")).withColumn("k2", F.xxhash64(F.lit(1), "hits", "words")))
    key = ["k1", "k2"]
    passages = checkpoint(stretches.groupBy(*key).agg(F.first("words").alias("text_words"), F.first("hits").alias("hits")))
    hits = passages.select(*key, F.explode("hits").alias("hit"), _dealt(*key)).select(*key, "salt", F.col("hit.h").alias("h"), F.col("hit.at").alias("at"))
    sides = (
        hits.join(items.select("h", F.col("at").alias("there"), "item", F.xxhash64("words").alias("iw"), _everywhere()), ["h", "salt"])
        .select(*key, "salt", "item", "iw", (F.col("at") - F.col("there")).alias("shift"))
        .distinct()
    )
    known = items.select("item", F.xxhash64("words").alias("iw"), F.col("words").alias("item_words")).distinct()
    laid = sides.join(passages.select(*key, "text_words"), key).join(known.select("item", "iw", "item_words", _everywhere()), ["item", "iw", "salt"])
    item_kind = bench.schema[item_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k1, k2, item, shift, text, other in zip(*(frame[c] for c in ("k1", "k2", "item", "shift", "text_words", "item_words"))):
                matched, first, last = best_stretch(np.asarray(text), np.asarray(other), shift)
                if matched:
                    out.append((k1, k2, item, matched, first, last))
            yield pd.DataFrame(out, columns=["k1", "k2", "item", "matched", "low", "high"])

    found = laid.select(*key, "item", "shift", "text_words", "item_words").mapInPandas(run, f"k1 long, k2 long, item {item_kind}, matched long, low long, high long")
    best = F.max(F.struct("matched", (-F.col("low")).alias("a"), (-F.col("high")).alias("b"))).alias("best")
    of_passage = checkpoint(found.groupBy(*key, "item").agg(best))
    # Passages of many texts: their rows are dealt, and so is what was found in them.
    placed = stretches.select("id", "first", *key, _dealt("id", "first")).join(of_passage.withColumn("salt", _everywhere()), [*key, "salt"])
    rows = placed.select("id", "item", F.struct(F.col("best.matched").alias("matched"), (F.col("best.a") - F.col("first")).alias("a"), (F.col("best.b") - F.col("first")).alias("b")).alias("best"))
    return rows.groupBy("id", "item").agg(F.max("best").alias("best")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.matched").alias("matched"), (-F.col("best.a")).alias("first_word"), (-F.col("best.b")).alias("last_word")
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of texts that no item contaminates, with all their columns."""
    bad = overlaps(docs, bench, id_col, **columns).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*(F.col(quoted(c)) for c in docs.columns))
