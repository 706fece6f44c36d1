"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

A line (trimmed, lower-cased) is dropped where an earlier line is equal or
within one edit (a character replaced, put in or taken out); the earliest line
stays. Lines stand in order of document id and line number. Blank lines always
stay. An edit is tolerated for each ``CHARS_AN_EDIT`` characters of the shorter
line, at most ``EDIT_BOUND`` in all, so that "item 1" and "item 2" both stay.

Equal lines meet in one grouped aggregation of their hashes. For the near ones,
lines one edit apart share their first or their last half, so only lines that
share a half with another emit variants: the other half, and it with each
character deleted, hashed with the shared half. Lines differ by one replaced
character where they give the same variant at the same place, by one character
more where one's variant is the other's half. Each variant's earliest line is
found by a window, so a group's lines are never paired with each other, and the
edit distance to it is verified on the lines themselves.

Lines and rows travel as two 64-bit hashes each, and lines with their places; texts
are fetched only for lines that share a half, through a filter that is broadcast: it
has 64 bits for each of its keys, at most ``MOST_BITS``.

Null texts have no lines and stay null; texts of blank lines alone stay as they
are. Rows without an id come first in the order. Rows of one id count as one
document: lines of the same number don't drop each other. Repeated rows lose the
same lines. A text, however long, is split where it is read and put together from
slices of its lines; a row must fit in memory with its lines once. Other columns
are carried along whatever their names are, inside a struct until the end; a
column of the name of one of the two counts is left out (choose other names with
``lines_col`` and ``dropped_col``). An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import checkpoint, quoted, written

#: The only bound above equality that halves find.
EDIT_BOUND = 1
CHARS_AN_EDIT = 24
#: Bits of a filter; past the most, more keys only let more rows through, to an exact join.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 26


def _row_key(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(text, F.lit(1), id_).alias("k2")]


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, at, line) of every line that isn't blank; k1 and k2 are hashes of the row."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).where(F.col("text").isNotNull())
    split = rows.select(*_row_key(F.col("id"), F.col("text")), "id", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    return split.select("k1", "k2", "id", "at", F.lower(F.trim("raw")).alias("line")).where("line != ''")


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]


def shared_halves(every: DataFrame) -> DataFrame:
    """(h1, h2, side, half) of lines that share their first (0) or last (1) half of a length with a different line."""
    long_ = every.where(F.length("line") >= CHARS_AN_EDIT).select(*_hashes(), "line", F.length("line").alias("n"))
    sizes = F.array_distinct(F.array(F.expr("n div 2"), F.expr("(n - 1) div 2")))
    halves = long_.withColumn("half", F.explode(sizes)).select(
        "h1",
        "h2",
        "half",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("left(line, half)").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("right(line, half)").alias("part")))).alias("x"),
    )
    keyed = halves.select("h1", "h2", "half", F.col("x.side").alias("side"), F.xxhash64("half", "x.side", "x.part").alias("key"))
    several = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high").select("key")
    return keyed.join(several, "key").select("h1", "h2", "side", "half", "key").distinct()


def passing(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose hash may be among the keys', by a filter of at most MOST_BITS / 64 words, so it is broadcast."""
    size = min(max(LEAST_BITS, 1 << max(1, 64 * keys.count() - 1).bit_length()), MOST_BITS)
    bit = keys.select(F.expr(f"cast({column} & {size - 1}L AS INT)").alias("bit"))
    bits = bit.select(F.expr("shiftright(bit, 6)").alias("w"), F.expr("shiftleft(1L, bit % 64)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    place = rows.withColumn("w", F.expr(f"cast(shiftright({column} & {size - 1}L, 6) AS INT)"))
    return place.join(F.broadcast(bits), "w").where(F.expr(f"getbit(v, cast({column} & 63L AS INT)) = 1")).drop("w", "v")


def near_lines(every: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines with an earlier line one edit away."""
    halves = checkpoint(shared_halves(every))
    wanted = halves.select("h1", "h2").distinct()
    hashed = every.where(F.length("line") >= CHARS_AN_EDIT).select(*_hashes(), "line")
    texts = passing(hashed, "h1", wanted).groupBy("h1", "h2").agg(F.min("line").alias("line"))
    known = checkpoint(texts.join(wanted, ["h1", "h2"]).join(firsts.select("h1", "h2", "first"), ["h1", "h2"]))

    rest = F.expr("if(side = 0, substring(line, half + 1), left(line, length(line) - half))")
    open_ = halves.join(known, ["h1", "h2"]).select("h1", "h2", "first", "key", rest.alias("rest"))
    whole = open_.select("h1", "h2", "first", F.xxhash64("key", F.lit(-1), "rest").alias("v"), F.lit(2).alias("kind"))
    cut = open_.withColumn("i", F.explode(F.expr("sequence(1, length(rest))"))).withColumn("less", F.expr("concat(left(rest, i - 1), substring(rest, i + 1))"))
    deleted = cut.select(
        "h1",
        "h2",
        "first",
        F.explode(F.array(F.struct(F.xxhash64("key", "i", "less").alias("v"), F.lit(0).alias("kind")), F.struct(F.xxhash64("key", F.lit(-1), "less").alias("v"), F.lit(1).alias("kind")))).alias("x"),
    ).select("h1", "h2", "first", F.col("x.v").alias("v"), F.col("x.kind").alias("kind"))

    same = Window.partitionBy("v")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("first"))).over(same)
    met = (
        deleted.union(whole)
        .withColumn("earlier", F.when(F.col("kind") == 0, of(0)).when(F.col("kind") == 1, of(2)).otherwise(of(1)))
        .where(F.col("earlier") < F.col("first"))
        .select("h1", "h2", "earlier")
        .distinct()
    )
    other = known.select(F.col("first").alias("earlier"), F.col("line").alias("other"))
    verified = met.join(known.select("h1", "h2", "line"), ["h1", "h2"]).join(other, "earlier")
    return verified.where(F.levenshtein("line", "other", EDIT_BOUND) >= 0).select("h1", "h2").distinct()


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, at) of every line that an earlier one makes superfluous."""
    every = lines(df, id_col, text_col)
    place = F.struct(F.col("id"), F.col("at"))
    firsts = checkpoint(every.select("id", "at", *_hashes()).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    near = near_lines(every, firsts).withColumn("near", F.lit(True))
    # Written first, so that the join with all lines reads two plain shuffles and Spark can split a frequent line's rows.
    judged = written(firsts.join(near, ["h1", "h2"], "left").where("n > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    placed = every.select("k1", "k2", "id", "at", *_hashes()).join(judged, ["h1", "h2"])
    return placed.where(F.col("near") | (F.col("first") < place)).select("k1", "k2", "at").distinct()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """The rows with superfluous lines taken out of their texts, and the numbers of lines and of dropped ones of each."""
    drops = dropped_lines(df, id_col, text_col).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("at")).alias("drops"))
    whole = F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")
    text = F.col(f"row.{quoted(text_col)}")
    # Between two dropped lines stands a slice of kept ones, so a text is put together in one pass.
    joined = (
        df.select(whole, *_row_key(F.col(quoted(id_col)), F.col(quoted(text_col))))
        .join(drops, ["k1", "k2"], "left")
        .withColumn("lines", F.split(text, "\n", -1))
        .withColumn("cuts", F.expr("concat(array(-1), drops, array(size(lines)))"))
    )
    kept = F.expr("flatten(transform(sequence(1, size(cuts) - 1), i -> slice(lines, cuts[i - 1] + 2, cuts[i] - cuts[i - 1] - 1)))")
    shorter = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(shorter.alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in df.columns if c not in (lines_col, dropped_col)),
        F.coalesce(F.when(text.isNotNull(), F.size("lines")), F.lit(0)).alias(lines_col),
        F.coalesce(F.when(F.col("drops").isNotNull(), F.size("drops")), F.lit(0)).alias(dropped_col),
    )
