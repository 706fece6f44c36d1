"""Nearest vectors by stable projections: cells of a kd-tree are read in order of projected distance until a chi-square test stops them.

The largest inner product is the least distance once every candidate gets one
component more, which makes all as long as the longest, and every query is
stretched to that length with 0 there. ``DIMENSIONS`` fixed normal projections of
these vectors keep distances in this sense: the squared projected distance of two,
over their squared distance, has the chi-square distribution of as many degrees of
freedom. So once a query's k-th best distance is d and all that is unread lies
further than r in projection, with chi-square's distribution function of (r / d)**2 at
``CONFIDENCE`` or more, a neighbour nearer than d is among the unread with the rest's
probability only, and reading stops: recall is ``CONFIDENCE`` at least in expectation,
whatever the data.

A kd-tree of the projections cuts candidates into cells; only its planes come from a
sample (``SAMPLE_ROWS`` a length of vector, lowest hashes), every candidate is in a cell.
Rounds read a query's first cell, the next ones, and then all that the test leaves
open, nearest first. A cell holds blocks of bounded bytes; a task has one block
with a small tree of its own, streams the cell's queries past it, and reads leaves
in order of projected distance until the test stops each query. All of a leaf's
rows are verified by their own inner products. A cell with many queries is
dealt out to several tasks.

Rows whose vector is null, empty, zero, or holds a null or non-finite component take no
part, nor do rows without an id. Only vectors of equal length are compared; more than
``MOST_WIDTHS`` lengths are an error. A query's own id is no candidate of it. Equal
candidate vectors are put together first, with the k + 1 least ids that they have, each with
its copies: more can't be among k best. Repeated candidate rows count each; repeated
query rows (same id and vector) count once. Ties go to the smaller id. Empty tables
give no rows; extra columns aren't read. Scores are sums of double products in one
fixed order of addition, so that equal vectors have equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import bounded_sample, written

#: Of the projections; even, so that chi-square's distribution function is a short sum.
DIMENSIONS = 8
CONFIDENCE = 0.95
#: Candidates that a cell should hold, and the most cells of a tree: those of larger tables hold more, in more blocks.
ROWS_A_CELL, MOST_CELLS = 4096, 4096
SAMPLE_ROWS = 1 << 16
MOST_WIDTHS = 64
#: Bytes of a block's vectors.
BLOCK_BYTES = 1 << 23
LEAF_ROWS = 256
#: Cells that a query has met after each round but the last.
FIRST_CELLS = (1, 8)
#: Queries that one task streams past a block.
QUERIES_A_TASK = 1 << 15
#: Candidates over k whose scores are added up again in the fixed order.
SPARE = 4


def chi_square(x: float) -> float:
    """The distribution function of DIMENSIONS degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, DIMENSIONS // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def stop_ratio() -> float:
    """The squared ratio of projected and k-th best distance from which reading stops: where chi_square is CONFIDENCE."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square(middle) >= CONFIDENCE else (middle, high)
    return high


def usable(vector: str) -> Column:
    """The vector as doubles, null where it takes no part."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < math.inf)) & F.exists(v, lambda c: c != 0)
    return F.when(fine & (F.size(v) > 0), F.transform(v, lambda c: c.cast("double")))


@dataclass
class Space:
    """One length's projections and tree: planes of nodes in heap order, and each cell's box of its own rows."""

    longest: float
    directions: np.ndarray
    axis: np.ndarray
    plane: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Projections of candidates."""
        more = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return x @ self.directions[:-1] + more[:, None] * self.directions[-1]

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.longest / np.sqrt((q * q).sum(1)))[:, None]) @ self.directions[:-1]

    def cell(self, p: np.ndarray) -> np.ndarray:
        """The cell of each projection."""
        at = np.zeros(len(p), int)
        while len(p) and at[0] < len(self.axis):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.axis[at]] > self.plane[at])
        return at - len(self.axis)

    def squared(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The squared distance at which a stretched query's candidates have a score; infinite for a score of -inf."""
        return np.maximum(2 * self.longest**2 - 2 * score * self.longest / np.sqrt((q * q).sum(1)), 0)


def box_distances(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(p), len(low)))
    for i in range(p.shape[1]):
        at = p[:, i, None]
        out += np.maximum(np.maximum(low[None, :, i] - at, at - high[None, :, i]), 0) ** 2
    return out


def planes(p: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, plane) of a tree's nodes in heap order: medians along the widest axis."""
    axis, plane, parts = [], [], [p]
    for _ in range(depth):
        halves = []
        for part in parts:
            a = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            at = float(np.median(part[:, a])) if len(part) else 0.0
            axis.append(a)
            plane.append(at)
            halves += [part[part[:, a] <= at], part[part[:, a] > at]]
        parts = halves
    return np.array(axis, int), np.array(plane)


class Block:
    """Some of a cell's candidates in leaves of a small tree."""

    def __init__(self, space: Space, frame: pd.DataFrame):
        self.space = space
        x = np.stack(frame["v"].to_list())
        p = space.project(x)
        parts, self.edges, order = [np.arange(len(x))], [0], []
        while parts:
            part = parts.pop()
            a = int(np.argmax(np.ptp(p[part], axis=0)))
            if len(part) > LEAF_ROWS and np.ptp(p[part, a]) > 0:
                part = part[np.argsort(p[part, a], kind="stable")]
                parts += [part[len(part) // 2 :], part[: len(part) // 2]]
            else:
                order.append(part)
                self.edges.append(self.edges[-1] + len(part))
        order = np.concatenate(order)
        self.x = x[order]
        p = p[order]
        self.low = np.stack([p[a:b].min(0) for a, b in zip(self.edges, self.edges[1:])])
        self.high = np.stack([p[a:b].max(0) for a, b in zip(self.edges, self.edges[1:])])
        members = [frame["members"].iloc[i] for i in order]
        self.sizes = np.array([len(m) for m in members])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([m["id"] for row in members for m in row], np.int64)
        self.copies = np.array([m["copies"] for row in members for m in row], np.int64)
        #: Vectors of one id alone: no candidates of that id's query.
        self.alone = np.where(self.sizes == 1, self.ids[self.starts], -1)
        self.one = np.flatnonzero(self.sizes == 1)
        self.one = self.one[np.argsort(self.alone[self.one], kind="stable")]

    def search(self, ids: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, id, copies, score) of each query's k best here that the test didn't rule out, and how many scores were computed."""
        keep = min(k + SPARE, len(self.x))
        near = box_distances(self.space.project_queries(q), self.low, self.high)
        turn = np.argsort(near, axis=1, kind="stable")
        best, what = np.full((len(q), keep), -np.inf), np.zeros((len(q), keep), int)
        going, verified = np.arange(len(q)), 0
        own = np.sort(self.alone[self.one])
        for step in range(len(self.low)):
            kth = np.maximum(bar[going], np.partition(best[going], keep - k, axis=1)[:, keep - k] if keep >= k else -np.inf)
            leaf = turn[going, step]
            still = near[going, leaf] <= ratio * self.space.squared(q[going], kth)
            going, leaf = going[still], leaf[still]
            if not len(going):
                break
            for at in np.unique(leaf):
                who = going[leaf == at]
                a, b = self.edges[at], self.edges[at + 1]
                score = q[who] @ self.x[a:b].T
                verified += score.size
                # A vector that only the query's own rows have.
                mine = np.flatnonzero(np.isin(ids[who], own))
                if len(mine):
                    score[mine] = np.where(self.alone[None, a:b] == ids[who[mine], None], -np.inf, score[mine])
                both, place = np.concatenate([best[who], score], axis=1), np.concatenate([what[who], np.broadcast_to(np.arange(a, b), score.shape)], axis=1)
                top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
                best[who], what[who] = np.take_along_axis(both, top, 1), np.take_along_axis(place, top, 1)
        at, col = np.nonzero(best > -np.inf)
        rows = what[at, col]
        score = (self.x[rows] * q[at]).sum(1) if len(at) else np.zeros(0)
        n = self.sizes[rows]
        member = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, score = np.repeat(at, n), np.repeat(score, n)
        # What earlier rounds found already rules the rest out.
        other = (self.ids[member] != ids[at]) & (score >= bar[at])
        at, score, member = at[other], score[other], member[other]
        order = np.lexsort((self.ids[member], -score, at))
        at, score, member = at[order], score[order], member[order]
        first = np.searchsorted(at, at)
        good = np.arange(len(at)) - first < k
        return at[good], self.ids[member[good]], self.copies[member[good]], score[good], verified


def spaces(c: DataFrame) -> dict[int, Space]:
    """Projections and planes of each length of candidates (id, v, width)."""
    about = c.groupBy("width").agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))).alias("longest")).limit(MOST_WIDTHS + 1).collect()
    if len(about) > MOST_WIDTHS:
        raise ValueError(f"more than {MOST_WIDTHS} lengths of vectors")
    out = {r.width: Space(r.longest, np.random.default_rng([r.width, DIMENSIONS]).standard_normal((r.width + 1, DIMENSIONS)), np.zeros(0, int), np.zeros(0)) for r in about}

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                yield pd.DataFrame({"width": width, "key": part["key"], "p": list(out[width].project(np.stack(part["v"].to_list())))})

    projected = c.select("width", "v", F.xxhash64("v").alias("key")).mapInPandas(project, "width int, key long, p array<double>")
    sample = bounded_sample(projected, "width", "key", SAMPLE_ROWS, "p").orderBy("width", "key").toPandas()  # 8 numbers a row
    for r in about:
        depth = max(0, math.ceil(math.log2(min(MOST_CELLS, max(1, r.n / ROWS_A_CELL)))))
        out[r.width].axis, out[r.width].plane = planes(np.stack(sample["p"][sample["width"] == r.width].to_list()), depth)
    return out


def dealt(c: DataFrame, found: dict[int, Space]) -> DataFrame:
    """Candidates with their cell; written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                p = found[width].project(np.stack(part["v"].to_list()))
                yield part.assign(cell=found[width].cell(p).astype(np.int32), p=list(p))

    kind = "v array<double>, width int, members array<struct<id:long,copies:long>>, cell int, p array<double>"
    return written(c.select("v", "width", "members").mapInPandas(run, kind))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest candidates found: query_id, rank, vec_id, score."""
    if k < 1:
        raise ValueError("k must be positive")

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), usable(vector_col).alias("v"))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("width", F.size("v"))

    each = clean(candidates).groupBy("v", "width", "id").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    c = written(least.groupBy("v", "width").agg(F.sort_array(F.collect_list(F.struct("id", "copies"))).alias("members")))
    q = written(clean(queries).dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("v")))
    found = spaces(c)
    c = dealt(c, found)
    boxes = c.groupBy("width", "cell").agg(F.count("*").alias("n"), *(f(F.col("p")[i]).alias(f"{name}{i}") for f, name in ((F.min, "low"), (F.max, "high")) for i in range(DIMENSIONS)))
    blocks: dict[int, list[int]] = {}
    for r in boxes.orderBy("width", "cell").collect():  # MOST_CELLS a length at most
        space = found[r.width]
        if space.low is None:
            cells = len(space.axis) + 1
            space.low, space.high, blocks[r.width] = np.full((cells, DIMENSIONS), np.inf), np.full((cells, DIMENSIONS), -np.inf), [0] * cells
        space.low[r.cell], space.high[r.cell] = ([r[f"{s}{i}"] for i in range(DIMENSIONS)] for s in ("low", "high"))
        blocks[r.width][r.cell] = -(-r.n // max(LEAF_ROWS, BLOCK_BYTES // (8 * r.width)))
    ratio = stop_ratio()

    def to_cells(first: int, end: int | None):
        """Rows of queries for each of their cells between two places of the order, as far as the test leaves them open."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for width, part in frame.groupby("width"):
                    space = found.get(width)
                    if space is None:
                        continue
                    v = np.stack(part["v"].to_list())
                    near = box_distances(space.project_queries(v), space.low, space.high)
                    order = np.argsort(near, axis=1, kind="stable")[:, first:end]
                    near = np.take_along_axis(near, order, 1)
                    row, place = np.nonzero(np.isfinite(near) & (near <= ratio * space.squared(v, part["bar"].to_numpy(float))[:, None]))
                    yield part.iloc[row].assign(cell=order[row, place].astype(np.int32))

        return run

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for frame in frames:
            keys = frame[["width", "cell", "block", "chunk", "kind"]].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                part = frame.iloc[a:b]
                if a < b and at != (now := tuple(keys[a, :4])):
                    at, held, block = now, [], None
                if a < b and keys[a, 4] == 0:
                    held.append(part[["v", "members"]])
                elif a < b and held:
                    block = block or Block(found[at[0]], pd.concat(held))
                    ids, of = part["id"].to_numpy(np.int64), part["key"].to_numpy(np.int64)
                    row, vec_id, copies, score, _ = block.search(ids, np.stack(part["v"].to_list()), part["bar"].to_numpy(float), k, ratio)
                    yield pd.DataFrame({"query_id": ids[row], "key": of[row], "vec_id": vec_id, "copies": copies, "score": score})

    spark = c.sparkSession
    widths = [(w, cell, n) for w, cells in blocks.items() for cell, n in enumerate(cells)]
    sizes = F.broadcast(spark.createDataFrame(widths, "width int, cell int, blocks int"))  # MOST_CELLS a length at most
    placed = c.join(sizes, ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")

    def ranked(found_: DataFrame) -> DataFrame:
        """The k best by ``rank``, copies as rows of their own; cut to k before there are copies."""
        few = found_.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
        each = few.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    results, first = None, 0
    most = max((len(b) for b in blocks.values()), default=0)
    for end in (*(e for e in FIRST_CELLS if e < most), None):
        if results is None:
            open_ = q.withColumn("bar", F.lit(-math.inf))
        else:
            open_ = q.join(ranked(results).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "key", F.col("score").alias("bar")), ["id", "key"], "left").withColumn("bar", F.coalesce("bar", F.lit(-math.inf)))
        pairs = written(open_.select("id", "key", "v", "width", "bar").mapInPandas(to_cells(first, end), "id long, key long, v array<double>, width int, bar double, cell int"))
        chunks = F.broadcast(pairs.groupBy("width", "cell").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("chunks")))  # MOST_CELLS a length at most
        there = placed.join(chunks, ["width", "cell"]).select("width", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "v", "members", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("bar"))  # no nulls: pandas would make ids doubles
        asked = pairs.join(chunks, ["width", "cell"]).join(sizes, ["width", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = asked.select("width", "cell", "block", F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"), "v", F.lit(None).cast("array<struct<id:long,copies:long>>").alias("members"), "id", "key", "bar")
        both = there.unionByName(asked).repartition("width", "cell", "block", "chunk").sortWithinPartitions("width", "cell", "block", "chunk", "kind")
        seen = written(both.mapInPandas(verify, "query_id long, key long, vec_id long, copies long, score double"))
        results, first = seen if results is None else results.unionByName(seen), end
    return ranked(results).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
