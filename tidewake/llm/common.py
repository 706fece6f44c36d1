"""Vectorised text helpers shared by the operators that run in Arrow batches.

Texts arrive as Arrow string arrays. ``slices`` hands them on in pieces of a few
megabytes, as one byte buffer with offsets, so that the memory a task needs
doesn't follow the size of an Arrow batch. ``words`` finds the words of a whole
piece at once and gives each a 64-bit hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.shared import folder

#: Bytes of text that are worked on at once; a longer text is a piece by itself.
PIECE_BYTES = 1 << 21
#: Bytes whose hashes are summed at once.
BLOCK_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo a number; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a table of columns: smaller than a checkpoint, for frames of many rows.

    The table stays in the shared checkpoint folder, as a result may be read later.
    """
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Labels that a sample is drawn for; more are an error.
MOST_GROUPS = 1000


def bounded_sample(df: DataFrame, group: str, key: str, rows: int, *ties: str) -> DataFrame:
    """At most ``rows`` rows of each group, those of lowest hash ``key``, which is uniform over longs.

    Counts of the groups' distinct keys give a bar under which some more than
    ``rows`` of them are expected; only those are ranked, so that a group's rows
    don't meet in one task. ``df`` holds light rows: texts are joined to the sample. Rows of one key count once against the bar, but each
    in the rank. Rows without a group are left out.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_group")).agg(F.approx_count_distinct(key, 0.05).alias("_keys"))
    found = counts.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} values of {group} to sample from")
    counts = F.broadcast(df.sparkSession.createDataFrame(found, counts.schema))  # MOST_GROUPS rows at most
    low = F.pmod(F.col(key), F.lit(1 << 40)) / float(1 << 40) < (2.0 * rows + 100) / F.col("_keys")
    ranked = Window.partitionBy(group).orderBy(key, *ties)
    near = df.join(counts, F.col(group) == F.col("_group")).where(low).drop("_group", "_keys")
    return near.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= rows).drop("_n")


def most_frequent(counts: DataFrame, count: str, limit: int, least: int = 1) -> DataFrame:
    """The rows of the highest counts: at most ``limit`` in all, none under ``least``; rows of one count come or go together.

    A histogram of the counts, of bounded size, gives the lowest count; so no
    task sends its own best ``limit`` rows anywhere.
    """
    step = F.when(F.col(count) < 1024, F.col(count)).otherwise(F.floor(32 * F.log2(F.col(count) / 1024)) + 1024).cast("long")
    rows = counts.where(F.col(count) >= least).groupBy(step.alias("step")).agg(F.min(count).alias("low"), F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    bar, total = None, 0
    for r in rows:
        total += r.n
        if total > limit:
            break
        bar = r.low
    return counts.where(F.col(count) >= bar if bar is not None else F.lit(False))


#: Bytes of text that a sample of labelled rows holds of either label, whatever the texts' lengths.
SAMPLE_BYTES = 1 << 24
#: Longer texts aren't sampled where there are shorter ones, as one of them would take the place of all others.
SAMPLE_TEXT_BYTES = SAMPLE_BYTES >> 4


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` texts of label 0 and of label 1, in order of a hash of the id; at most SAMPLE_BYTES of either.

    The labels are cut to the sample before they meet the texts. An id with
    several labels has the largest, one with several texts the least. Texts of over
    SAMPLE_TEXT_BYTES are left out, and take no room from others; a label of such texts alone
    has its shortest, if SAMPLE_BYTES hold it.
    """
    known = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    picked = bounded_sample(known.withColumn("key", F.xxhash64("id")), "label", "key", rows, "id").select("id", "label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # At most 2 * rows ids with their labels: bounded by the parameter, so it may be broadcast.
    found = written(texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    # At most 2 * rows light rows.
    sizes = found.select("id", "label", F.octet_length("text").cast("long").alias("n"))
    least = F.row_number().over(Window.partitionBy("label").orderBy("n", F.xxhash64("id"), "id")) == 1
    small = sizes.withColumn("fits", (F.col("n") <= SAMPLE_TEXT_BYTES) | least).where("fits")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    short = small.withColumn("total", F.sum("n").over(so_far)).where(F.col("total") <= SAMPLE_BYTES)
    return [(r.text, r.label) for r in found.join(F.broadcast(short.select("id")), "id").orderBy(F.xxhash64("id"), "id").collect()]


#: Bits of a filter for each of its keys, and the least and most bits of one: tasks get it whole.
#: Past the most, more keys only let more rows through, to an exact join.
BITS_A_KEY = 256
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of 64-bit hashes, sized by their number: two bits a key, put together by Spark."""
    size = min(max(LEAST_BITS, 1 << max(1, BITS_A_KEY * keys.count() - 1).bit_length()), MOST_BITS)
    both = F.array(F.expr(f"`{column}` & {size - 1}L"), F.expr(f"shiftrightunsigned(`{column}`, {65 - size.bit_length()})"))
    rows = (
        keys.select(F.explode(both).alias("bit"))
        .select(F.expr("shiftright(bit, 6)").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 AS INT))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
        .toArrow()
    )
    out = np.zeros(size // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among the filter's keys."""
    size = 64 * len(bits)
    out = np.ones(len(hashes), bool)
    for at in (hashes & np.uint64(size - 1), hashes >> np.uint64(65 - size.bit_length())):
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def slices(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of consecutive rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.ones(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = False
    alnum = np.zeros(256, bool)
    alnum[0x30:0x3A] = alnum[0x61:0x7B] = alnum[0x80:] = True
    return lower, space, alnum


LOWER, NOT_SPACE, LETTERS_DIGITS = _tables()


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE):
    """Words of lower-cased texts: (start byte, end byte, hash, first word of each text).

    A-Z are lower-cased; ``is_word`` says which bytes a word is made of. The
    last array has one entry more than there are texts.

    Bytes are hashed in blocks of ``BLOCK_BYTES``, so that beside its results (24
    bytes a word) this takes memory by the block, not by the text. A word that
    goes on in the next block is put together from its parts there.
    """
    starts, ends, hashes = [], [], []
    power, inverse = _powers(BLOCK_BYTES + 1, _BASE), _powers(BLOCK_BYTES + 1, pow(_BASE, -1, 1 << 64))
    opened, sum_ = -1, 0  # start and weighted sum of a word that the last block left open
    for low_at in range(0, len(data), BLOCK_BYTES):
        block = LOWER[data[low_at : low_at + BLOCK_BYTES]]
        n = len(block)
        inside = np.zeros(n + 1, bool)
        inside[:n] = is_word[block]
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, low_at) : np.searchsorted(offsets, low_at + n)] - low_at] = True
        edge[n] = low_at + n == len(data)
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        before[0] = opened >= 0
        begins = np.flatnonzero(inside & (~before | edge))
        stops = np.flatnonzero(before & (~inside | edge))
        if low_at + n < len(data) and len(stops) and stops[-1] == n:
            stops = stops[:-1]  # the next block says whether the word ends here
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        if opened >= 0:
            part = int(total[stops[0]] if len(stops) else total[n])
            sum_ = (sum_ + part * pow(_BASE, low_at - opened, 1 << 64)) & _MASK
            if len(stops):
                starts.append(np.array([opened]))
                ends.append(stops[:1] + low_at)
                hashes.append(np.array([sum_], np.uint64))
                stops, opened = stops[1:], -1
        if len(begins) > len(stops):
            opened, begins = low_at + int(begins[-1]), begins[:-1]
            sum_ = (int(total[n]) - int(total[opened - low_at])) * int(inverse[opened - low_at]) & _MASK
        starts.append(begins + low_at)
        ends.append(stops + low_at)
        hashes.append((total[stops] - total[begins]) * inverse[begins])
    if not starts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(len(offsets), int)
    starts = np.concatenate(starts)
    return starts, np.concatenate(ends), mix(np.concatenate(hashes)), np.searchsorted(starts, offsets)


def hash_words(tokens: list[str]) -> np.ndarray:
    """The hashes that ``words`` gives to these words (already lower-case, without spaces)."""
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = " ".join(tokens).encode()
    return words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[2]


def split_mix(seed: int, n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)
