"""Order within a key without one task a key: places, running totals and look-back windows in pieces.

Rows are dealt by ranges of (key, order), so a key of many rows lies in many
ranges. Places are counted in ranges, running totals in pieces of so many places, and
what goes from one to the next is a row a range or piece. Windows look back into a
piece's halo: copies of the last rows of the piece before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewake.shared import folder

#: Rows of a key that one task sorts.
PIECE = 1 << 16


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage."""
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: list[str | Column], place: str = "_i") -> DataFrame:
    """The frame with each row's place within its key, from 0; written."""
    ranges = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that go on in a next range: fewer rows than there are ranges.
    starts = counts.withColumn("_before", F.sum("_n").over(before)).where(F.col("_before") > 0).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    same = (F.col("r._range") == F.col("s._range")) & _equal(keys, "r", "s")
    joined = ranges.withColumn(place, inside.cast("long")).alias("r").join(F.broadcast(starts).alias("s"), same, "left")
    return joined.select(*(F.col(f"r.`{c}`") for c in df.columns), (F.col(f"r.{place}") + F.coalesce("s._before", F.lit(0))).alias(place))


def _equal(keys: list[str], a: str, b: str) -> Column:
    """Keys are equal; null keys are a key like others."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def running(df: DataFrame, keys: list[str], place: str, totals: dict[str, Column], aggregate: Callable = F.sum, add: Callable[[Column, Column], Column] | None = None, piece: int | None = None, pieces: bool = True) -> DataFrame:
    """The frame with totals over the rows before each row of its key, null for none; a piece is one task's, and a row goes on from it.

    Without ``pieces`` no key may have more rows than a piece (see ``longest``), and one sort serves all totals.
    """
    if not pieces:
        before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *(aggregate(c).over(before).alias(n) for n, c in totals.items()))
    add = add or (lambda a, b: a + b)
    parted = df.withColumns({"_piece": F.expr(f"{place} div {piece or PIECE}"), **{f"_x_{n}": c for n, c in totals.items()}})
    inside = Window.partitionBy(*keys, "_piece").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy(*keys, "_piece").agg(*(aggregate(f"_x_{n}").alias(f"_s_{n}") for n in totals))
    starts = sums.withColumns({f"_s_{n}": aggregate(f"_s_{n}").over(earlier) for n in totals}).where("_piece > 0")
    rows = parted.withColumns({f"_t_{n}": aggregate(f"_x_{n}").over(inside) for n in totals}).alias("r")
    joined = rows.join(starts.alias("s"), _equal(keys, "r", "s") & (F.col("r._piece") == F.col("s._piece")), "left")
    both = lambda n: F.when(F.col(f"r._t_{n}").isNull(), F.col(f"s._s_{n}")).when(F.col(f"s._s_{n}").isNull(), F.col(f"r._t_{n}")).otherwise(add(F.col(f"s._s_{n}"), F.col(f"r._t_{n}")))
    return joined.select(*(F.col(f"r.`{c}`") for c in df.columns), *(both(n).alias(n) for n in totals))


def longest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def haloed(df: DataFrame, keys: list[str], order: list[str | Column], back: int, ahead: int = 0, piece: int | None = None) -> tuple[DataFrame, WindowSpec, Column]:
    """(rows with copies, window, own): windows of up to ``back`` rows before and ``ahead`` behind a row, in pieces of a key.

    Window functions over the window see what they would see over the whole key; afterwards only rows where
    ``own`` holds are kept, as the others are copies. Frames that begin at the key's first row aren't for pieces: see ``running``.
    """
    size = max(piece or PIECE, back, ahead, 1)
    rows = placed(df, keys, order)
    here = F.expr(f"_i div {size}")
    at = F.col("_i") % size
    # A row is in its own piece, in the next one's halo if it is among the last, and in the one's before if it is among the first.
    pieces = F.array_compact(F.array(here, F.when(at >= size - back, here + 1) if back else F.lit(None).cast("long"), F.when((at < ahead) & (here > 0), here - 1) if ahead else F.lit(None).cast("long")))
    copied = rows.withColumn("_piece", F.explode(pieces))
    return copied, Window.partitionBy(*keys, "_piece").orderBy("_i"), F.col("_piece") == here
