"""N-gram Jaccard join by vertical partitioning, to components of linked texts.

A text's set holds the 64-bit hashes of its distinct n-word shingles. Equal sets
become one node at once. All shingles stand in one global order: by hash, the
frequent ones behind all others by frequency. A prefix is a fifth of a set, so
only shingles of the ``LOW`` part of hashes are counted first; sets in which more
than ``CROWDED`` of those are frequent reach further, and have the rest of their
shingles counted too. Hashes are cut into fragments, each set into segments.

Candidates: two sets within the threshold share a shingle of their prefixes (the
first n - ceil(t * n) + 1 in global order). Sets of a prefix shingle are first
compared with one centre, the set that has it foremost, as the fewest changes
stand before it there: rows stay linear in the size of a group. The links found make components; only sets of one shingle
that are still in different components are then compared with each other, so
that no link that matters is lost. Sizes, the place of the first common shingle
and the number of shingles that two prefixes share drop pairs that can't reach
the threshold.

Counting: candidate pairs are dealt into blocks of sets, so a set travels once
to a block, not once a pair. In every block each fragment's overlaps are counted
by themselves, and the counts are summed by pair, so no step holds more of a
text than a segment.

Links: the components need only some of them, the rest lie inside components. A
component whose every pair was verified has all; the sets of any other are dealt
into blocks, and each fragment of two blocks gives a matrix of overlaps of all
their pairs. The matrices are summed and counted where they are, so no row is
made for a pair. A component takes time with the square of its distinct sets, as
the links themselves do where it is one group of near copies.

Null texts and texts without words have an empty set and no links; with fewer
words than n the whole sequence is one shingle. Rows of one id count as one
document in the components: they are linked. Rows without an id have no
component. Extra columns aren't read. Two shingles, or two sets, are taken as
equal where their 64-bit hashes are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import in_filter, key_filter, mix, most_frequent, slices, split_mix, words, written
from tidewake.llm.components import components

WORDS = 5
#: Similarity threshold as a ratio of integers.
NUMERATOR, DENOMINATOR = 80, 100
FRAGMENTS = 4
#: The part of hashes whose shingles are counted for all sets. Prefixes need a fifth, and a quarter where CROWDED are frequent.
LOW = int(0.3 * 2**64)
CROWDED = 0.2
#: Bytes of text whose sets a task holds at once, beside the shuffle's buffers.
SET_BYTES = 1 << 20
#: Sets of one side of a block.
BLOCK_SETS = 2000
#: Sets, and shingles in all, of one side of a block in which links are counted; shingles of a matrix at once.
COUNT_SETS, COUNT_SHINGLES, COUNT_COLUMNS = 500, 1 << 20, 4096
#: A shingle in so many sets is put behind the rare ones; the most frequent FREQUENT of these are.
FREQUENT_FROM, FREQUENT = 16, 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, hashes, first = words(data, offsets)
    count = np.diff(first)
    if len(hashes) >= n:
        factors = split_mix(n, n)
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total += hashes[k : len(hashes) - n + 1 + k] * factors[k]
        total = mix(total)
    else:
        total = np.zeros(0, np.uint64)
    begins, sizes = first[:-1].tolist(), count.tolist()
    for begin, size in zip(begins, sizes):
        if size >= n:
            total[begin : begin + size - n + 1].sort()  # windows that leave their text stand behind those of the text
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[first[:-1][count >= n]] = True
    sets = []
    for begin, size in zip(begins, sizes):
        if size >= n:
            end = begin + size - n + 1
            sets.append(total[begin:end][new[begin:end]])
        elif size:
            factors = split_mix(1000 + size, size)  # other factors: a short text equals only its like
            sets.append(mix((hashes[begin : begin + size] * factors).sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set and its size."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = mix(np.concatenate([sets[i] for i in some]) ^ np.uint64(0x5851F42D4C957F2D))
        total[some] = np.add.reduceat(flat, np.cumsum(sizes[some]) - sizes[some])
    return mix(total + sizes.astype(np.uint64)).view(np.int64)


def set_name(s: np.ndarray) -> np.int64:
    """A hash of a set and its size."""
    return set_names([s])[0]


def prefix_size(n: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """How many first shingles of a set of n must hold one of any set within the threshold."""
    return n + (-numerator * n) // denominator + 1 if n else 0


def _each_set(df: DataFrame, id_col: str, text_col: str, columns: str, build) -> DataFrame:
    """Rows that build(sets, names, seen) makes of every piece of texts; ``seen`` are names a task had before."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), SET_BYTES):
                sets = shingle_sets(data, offsets)
                taken, arrays = build(sets, set_names(sets), seen)
                ids = batch.column(0).slice(first, end - first).take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, {columns}")


def _new(sets: list[np.ndarray], names: list[np.int64], seen: set[int]) -> list[int]:
    """Rows whose set isn't empty and hasn't been met in this task: copies are put together before any shuffle."""
    out = []
    for i, name in enumerate(np.asarray(names).tolist()):
        if len(sets[i]) and name not in seen:
            seen.add(name)
            out.append(i)
    return out


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)


def named_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s, n) of every row: the name and the size of its set."""

    def build(sets, names, seen):
        return np.arange(len(sets)), [pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]

    return _each_set(df, id_col, text_col, "s long, n long", build)


def low_shingles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(g) of the sets' shingles in the low part of hashes; a set comes once from each task that has it."""

    def build(sets, names, seen):
        taken = _new(sets, names, seen)
        out = [sets[i][: np.searchsorted(sets[i], np.uint64(LOW))] for i in taken]
        return np.repeat(np.array(taken, np.int64), [len(x) for x in out]), [pa.array(_flat(out))]

    return _each_set(df, id_col, text_col, "g long", build).select("g")


def _found(hashes: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of s are among sorted hashes, and where."""
    if not len(hashes):
        return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    return hashes[at] == s, at


def crowded_shingles(df: DataFrame, id_col: str, text_col: str, frequent: np.ndarray) -> DataFrame:
    """(g) of the other shingles of sets whose low part is crowded with frequent ones."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def build(sets, names, seen):
        taken, out = [], []
        for i in _new(sets, names, seen):
            low = np.searchsorted(sets[i], np.uint64(LOW))
            if _found(shared.value, sets[i][:low])[0].sum() > CROWDED * low or not low:
                taken.append(i)
                out.append(sets[i][low:])
        return np.repeat(np.array(taken, np.int64), [len(x) for x in out]), [pa.array(_flat(out))]

    return _each_set(df, id_col, text_col, "g long", build).select("g")


def prefixes(df: DataFrame, id_col: str, text_col: str, last: np.ndarray) -> DataFrame:
    """(g, s, n, i): the prefix shingles of the sets and their places; ``last`` are the frequent ones in order.

    A set comes once from each task that has it.
    """
    by_hash = np.argsort(last)
    shared = df.sparkSession.sparkContext.broadcast((last[by_hash], by_hash))

    def build(sets, names, seen):
        hashes, place = shared.value
        taken, out = _new(sets, names, seen), []
        for i in taken:
            s = sets[i]
            size = prefix_size(len(s))
            known, at = _found(hashes, s)
            if known.any():
                s = np.concatenate([s[~known], s[known][np.argsort(place[at[known]])]])
            out.append(s[:size])
        counts = [len(x) for x in out]
        spread = lambda values, kind: pa.array(np.repeat(np.array(values, kind), counts))
        place_of = np.concatenate([np.arange(c, dtype=np.int32) for c in counts]) if counts else np.zeros(0, np.int32)
        return np.repeat(np.array(taken, np.int64), counts), [pa.array(_flat(out)), spread([names[i] for i in taken], np.int64), spread([len(sets[i]) for i in taken], np.int32), pa.array(place_of)]

    return _each_set(df, id_col, text_col, "g long, s long, n int, i int", build).select("g", "s", "n", "i")



def frequent_shingles(df: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The shingles to be put last, the most frequent of all last; at most FREQUENT of them.

    Any order gives right results, so the bound on their number only decides how
    many comparisons the rest costs.
    """
    counted = lambda rows: written(rows.groupBy("g").count().where(F.col("count") >= FREQUENT_FROM))
    ranked = lambda rows: most_frequent(rows, "count", FREQUENT).toPandas().sort_values(["count", "g"])["g"].to_numpy(np.int64).view(np.uint64)
    low = counted(low_shingles(df, id_col, text_col))
    high = counted(crowded_shingles(df, id_col, text_col, np.sort(ranked(low))))
    return ranked(low.union(high))


def _within(na: str, nb: str) -> Column:
    """Whether two sizes allow the threshold."""
    return F.least(na, nb) * DENOMINATOR >= F.greatest(na, nb) * NUMERATOR


def _reachable(na: str, nb: str, ia: str, ib: str) -> Column:
    """Whether two sets can reach the threshold if their first common shingle stands at these places."""
    most = F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib))
    return most * DENOMINATOR >= (F.col(na) + F.col(nb) - most) * NUMERATOR


def _enough(na: str, nb: str, common: Column) -> Column:
    """Whether two sets whose prefixes share so many shingles can reach the threshold.

    Up to where the first of the two prefixes ends, all common shingles are
    counted; past it, at most the rest of that set can be common.
    """
    rest = lambda n: -F.floor(-F.col(n) * NUMERATOR / DENOMINATOR) - 1
    most = common + F.greatest(rest(na), rest(nb))
    return most * DENOMINATOR >= (F.col(na) + F.col(nb) - most) * NUMERATOR


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """(g, s, n, i) of prefix shingles that two rows or more have."""
    several = rows.groupBy("g").count().where("count > 1").select("g")
    return rows.join(several, "g").distinct()


def segments(df: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """(s, n, f, seg) of the distinct sets whose name passes the filter: their shingles by fragment."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)
    shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())

    def build(sets, names, seen):
        bits = shared.value
        kept = in_filter(bits, names.view(np.uint64))
        taken, fragment, out = [], [], []
        for i in _new([x if k else x[:0] for x, k in zip(sets, kept)], names, seen):
            s = sets[i]
            cuts = np.searchsorted(s >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
            for f in range(FRAGMENTS):
                if cuts[f] < cuts[f + 1]:
                    taken.append(i)
                    fragment.append(f)
                    out.append(s[cuts[f] : cuts[f + 1]])
        offsets = np.zeros(len(out) + 1, np.int32)
        np.cumsum([len(x) for x in out], out=offsets[1:])
        return np.array(taken, np.int64), [
            pa.array(np.array([names[i] for i in taken], np.int64)),
            pa.array([len(sets[i]) for i in taken], pa.int64()),
            pa.array(fragment, pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(_flat(out))),
        ]

    rows = _each_set(df, id_col, text_col, "s long, n long, f int, seg array<long>", build).drop("id")
    return rows.groupBy("s", "f").agg(F.first("n").alias("n"), F.first("seg").alias("seg"))


def linked(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold: overlaps counted by block and fragment, then summed."""
    sets = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct().count()
    sides = max(1, -(-sets // BLOCK_SETS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(sides)).cast("int")
    dealt = pairs.select("a", "b", block("a").alias("x"), block("b").alias("y"))
    needed = dealt.select("x", "y", F.explode(F.array("a", "b")).alias("s")).distinct()
    fragments = F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        segs, sizes = dict(zip(right["s"], right["seg"])), dict(zip(right["s"], right["n"]))
        rows = [(a, b, sizes[a], sizes[b], len(np.intersect1d(segs[a], segs[b], assume_unique=True))) for a, b in zip(left["a"], left["b"]) if a in segs and b in segs]
        return pd.DataFrame(rows, columns=["a", "b", "na", "nb", "o"])

    sent = needed.join(parts, "s").select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("f").alias("sf"), "s", "n", "seg")
    counted = (
        dealt.withColumn("f", fragments)
        .groupBy("x", "y", "f")
        .cogroup(sent.groupBy("sx", "sy", "sf"))
        .applyInPandas(count, "a long, b long, na long, nb long, o long")
    )
    overlap = counted.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return overlap.where(F.col("o") * DENOMINATOR >= (F.col("na") + F.col("nb") - F.col("o")) * NUMERATOR).select("a", "b")


def overlap_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of left shares with each of right."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    sides = []
    for sets, flat in ((left, a), (right, b)):
        known, at = _found(common, flat)
        order = np.argsort(at[known], kind="stable")
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known][order], at[known][order], len(sets)))
    out = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, len(common), COUNT_COLUMNS):
        width = min(COUNT_COLUMNS, len(common) - begin)
        marked = []
        for row, column, count in sides:
            some = slice(*np.searchsorted(column, [begin, begin + width]))
            marks = np.zeros((count, width), np.float32)
            marks[row[some], column[some] - begin] = 1
            marked.append(marks)
        out += np.rint(marked[0] @ marked[1].T).astype(np.int64)
    return out


def _count_overlaps(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a fragment of two blocks: a row a component with its sets, sizes, weights and matrix of overlaps."""
    p, x, y, f = (int(rows[c].iat[0]) for c in ("p", "x", "y", "f"))
    out = []
    for component, own in rows.groupby("component", sort=False):
        left, right = own[own["block"] == x], own[own["block"] == y]
        if len(left) and len(right):
            overlaps = overlap_matrix(left["seg"].to_list(), right["seg"].to_list())
            sides = [side[c].to_numpy(np.int64) for side in (left, right) for c in ("s", "n", "w")]
            out.append((p, x, y, component, *sides, overlaps.astype(np.min_scalar_type(int(overlaps.max()))).dumps()))
    return pd.DataFrame(out, columns=["p", "x", "y", "component", "a", "na", "wa", "b", "nb", "wb", "o"])


def _count_links(rows: pd.DataFrame) -> pd.DataFrame:
    """(s, k) of two blocks, from the overlaps of all fragments."""
    out = []
    for _, own in rows.groupby("component", sort=False):
        ids, sizes, weights = [], [], []
        for c in "ab":
            name, first = np.unique(np.concatenate(own[c].to_list()), return_index=True)
            ids.append(name)
            sizes.append(np.concatenate(own["n" + c].to_list())[first])
            weights.append(np.concatenate(own["w" + c].to_list())[first])
        total = np.zeros((len(ids[0]), len(ids[1])), np.int64)
        for a, b, o in zip(own["a"], own["b"], own["o"]):
            total[np.ix_(np.searchsorted(ids[0], a), np.searchsorted(ids[1], b))] += np.asarray(pickle.loads(o), np.int64)
        alike = total * DENOMINATOR >= (sizes[0][:, None] + sizes[1][None, :] - total) * NUMERATOR
        if own["x"].iat[0] == own["y"].iat[0]:
            np.fill_diagonal(alike, False)
        else:
            out.append(pd.DataFrame({"s": ids[1], "k": alike.T.astype(np.int64) @ weights[0]}))
        out.append(pd.DataFrame({"s": ids[0], "k": alike.astype(np.int64) @ weights[1]}))
    return pd.concat(out) if out else pd.DataFrame({"s": [], "k": []}).astype("int64")


def link_counts(links: DataFrame, names: DataFrame, weights: DataFrame, parts: DataFrame) -> DataFrame:
    """(s, k) of sets with links: the weights of all other sets that reach the threshold with it.

    ``links`` hold each pair once and span their components, which ``names`` are;
    ``weights`` are (s, n, w), ``parts`` the segments of all sets in links.
    """
    members = written(names.withColumnRenamed("node", "s").join(weights, "s"))
    edges = links.join(members.select(F.col("s").alias("a"), "component", F.col("w").alias("wa")), "a")
    found = edges.groupBy("component").agg(F.count("*").alias("e"))
    groups = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).join(found, "component")
    sides = F.greatest(F.ceil(F.col("m") / COUNT_SETS), F.ceil(F.col("shingles") / COUNT_SHINGLES))
    open_ = written(groups.where("2 * e < m * (m - 1)").withColumn("sides", sides))

    # Every pair was verified.
    known = edges.join(open_.select("component"), "component", "left_anti").join(weights.select(F.col("s").alias("b"), F.col("w").alias("wb")), "b")
    whole = known.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("wb").alias("k")), F.struct(F.col("b").alias("s"), F.col("wa").alias("k")))).alias("x")).select("x.*")

    small = open_.where("sides = 1").agg(F.sum("m").alias("m"), F.sum("shingles").alias("shingles")).first()
    packs = max(1, -(-(small.m or 0) // COUNT_SETS), -(-(small.shingles or 0) // COUNT_SHINGLES))
    pack = F.when(F.col("sides") == 1, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component"))
    dealt = (
        members.join(open_.select("component", "sides"), "component")
        .withColumn("block", F.pmod(F.xxhash64("s"), F.col("sides")))
        .withColumn("other", F.explode(F.expr("sequence(0L, sides - 1)")))
        .select("s", F.col("n").cast("long").alias("n"), "w", "component", "block", pack.alias("p"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    )
    sent = dealt.join(parts.select("s", "f", "seg"), "s")
    side = lambda c: f"{c} array<long>, n{c} array<long>, w{c} array<long>"
    overlaps = sent.groupBy("p", "x", "y", "f").applyInPandas(_count_overlaps, f"p long, x long, y long, component long, {side('a')}, {side('b')}, o binary")
    counted = overlaps.groupBy("p", "x", "y").applyInPandas(_count_links, "s long, k long")
    return written(whole.union(counted).groupBy("s").agg(F.sum("k").alias("k")))


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(id, n_shingles, n_links, component_id) of every row.

    ``n_links`` counts all other rows whose sets reach the threshold with the
    row's, copies among them. Without ``count_links`` it is null, which saves
    comparing sets that are in one component already.
    """
    named = written(named_sets(df, id_col, text_col))
    sizes = named.where("n > 0").groupBy("s").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.count("*").alias("w"))
    last = frequent_shingles(df, id_col, text_col)
    shared = written(shared_prefixes(prefixes(df, id_col, text_col, last)))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ends = pairs.select(F.explode(F.array("a", "b")).alias("s"))
        parts = written(segments(df, id_col, text_col, key_filter(ends, "s")))
        return written(linked(pairs, parts)), parts

    # Every set of a shingle with the shingle's centre: how much of their prefixes is common, then what they share in all.
    own = shared.groupBy("s", "n").agg(F.collect_list("g").alias("prefix"))

    def promising(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(own.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa")), "a")
        joined = joined.join(own.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb")), "b")
        return joined.where(_enough("na", "nb", F.size(F.array_intersect("pa", "pb")))).select("a", "b")

    centres = shared.groupBy("g").agg(F.min(F.struct("i", "s", "n")).alias("c"))
    starred = (
        shared.join(centres, "g")
        .select(F.col("c.s").alias("a"), F.col("c.n").alias("na"), F.col("c.i").alias("ia"), F.col("s").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
        .where((F.col("a") != F.col("b")) & _within("na", "nb") & _reachable("na", "nb", "ia", "ib"))
        .select("a", "b")
        .distinct()
    )
    links, parts = verified(promising(starred))
    names = components(links)

    # Shingles whose sets are still apart: compare the sets of different components.
    placed = shared.join(names.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    apart = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("g")
    open_ = written(placed.join(apart, "g").select("g", "s", "n", "i", "component"))
    x = open_.select("g", F.col("s").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("component").alias("ca"))
    y = open_.select("g", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("component").alias("cb"))
    rest = (
        x.join(y, "g")
        .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _within("na", "nb") & _reachable("na", "nb", "ia", "ib"))
        .select("a", "b")
        .distinct()
    )
    more, more_parts = verified(promising(rest))

    # Rows of one id are one document.
    again = named.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count_distinct("s").alias("k")).where("k > 1")
    repeated = named.where("n > 0").join(again.select("id", "a"), "id").select("a", F.col("s").alias("b"))
    found = links.union(more)
    spanned = components(found)
    whole = spanned if repeated.isEmpty() else components(found.union(repeated))

    placed = sizes.join(whole.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    if count_links:
        both = parts.union(more_parts.join(parts.select("s").distinct(), "s", "left_anti").select(parts.columns))
        placed = placed.join(link_counts(found, spanned, sizes.select("s", "n", "w"), both), "s", "left")
        placed = placed.withColumn("n_links", F.coalesce("k", F.lit(0)) + F.col("w") - 1)
    else:
        placed = placed.withColumn("n_links", F.lit(None).cast("long"))
    final = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = placed.join(final, "component").select("s", "component_id", "n_links")
    return named.join(of_set, "s", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("n_links")).when(F.lit(count_links), 0).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
    )
