"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks, queries too; each task gets one block of
either. It keeps, for every dimension, the list of the block's components in
order. A query reads a list from the top where its own component is positive and
from the bottom where it is negative, all lists to the same depth, and adds up
what it reads by candidate. What a candidate's unread components can add is
bounded twice: none is better than the contribution last read from its list, and
by Cauchy's inequality all of them together reach no further than the product of
the lengths of the unread parts of query and candidate; the latter bounds them
from below as well. The k-th lower bound is the bar. When few candidates' upper
bounds reach it, reading stops: all others can't qualify. Only the scores of those
left are then resolved. Blocks' winners, at most k a block and query, meet in a
ranked window with a partial limit before its shuffle.

Rows whose vector is null, empty or holds a null or a non-finite component take
no part, nor do rows without an id. Only vectors of equal length are compared.
A query's own id is no candidate of it. Ties go to the smaller id. Repeated
candidate rows are put together first and count each in the result; repeated query
rows (same id and vector) count once. Empty tables give no rows; extra columns
aren't read. Components are integers as doubles. Bounds are in single precision and
allow for its rounding; resolved scores are exact: in doubles while length * max|q| * max|x| stays under
2**53, past that in Python's integers. A score that is no long is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_A_BLOCK = 8192
QUERIES_A_BLOCK = 2048
#: Queries that read a block's lists side by side.
BATCH = 256
#: Depths, as parts of a list's length, at which bounds are compared.
DEPTHS = (0.75, 0.9, 1.0)
#: A query's reading stops when at most this part of a block, or as many candidates as k, are open.
OPEN_PART = 0.08
#: What rounding in single precision can add, over the product of two vectors' lengths.
SLACK = 1e-5


def scaled(vector: str, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component, null where the vector takes no part."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(math.inf)))
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("double")))


class Lists:
    """A block of candidates and its components in order, a list a dimension; scaled to at most 1, in single precision."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = max(float(np.abs(x).max()), 1e-300) if x.size else 1.0
        self.small = (x.T / self.scale).astype(np.float32)
        self.order = np.argsort(x.T, axis=1, kind="stable")  # from the least component to the greatest
        self.norm = np.einsum("ij,ij->j", self.small, self.small)
        self._read: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

    def read(self, begin: int, end: int) -> tuple[np.ndarray, ...]:
        """The entries between two depths, of lists read from the top and then of lists read from the bottom: whether they
        are read, their components and these squared, by list and candidate; 0 where an entry isn't among them."""
        if (begin, end) not in self._read:
            n = self.order.shape[1]
            taken = np.zeros((2, *self.small.shape), np.float32)
            np.put_along_axis(taken[0], self.order[:, n - end : n - begin], 1, axis=1)
            np.put_along_axis(taken[1], self.order[:, begin:end], 1, axis=1)
            found = taken * self.small
            flat = lambda m: m.reshape(-1, n)
            self._read[begin, end] = flat(taken), flat(found), flat(found * found)
        return self._read[begin, end]

    def last(self, depth: int) -> np.ndarray:
        """The components last read at a depth from the top and from the bottom of each list."""
        at = lambda place: np.take_along_axis(self.small, self.order[:, place, None], axis=1)[:, 0]
        return np.concatenate([at(self.order.shape[1] - depth), at(depth - 1)])


def open_candidates(lists: Lists, q: np.ndarray, own: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(candidates that may be among the k best, part of the lists that was read) of each query; ``own`` are no candidates."""
    n = len(lists.x)
    left, depths = [np.flatnonzero(~o) for o in own], np.zeros(len(q))
    size = np.abs(q).max(1)
    going = np.flatnonzero(size > 0)  # the scores of a query of zeros are known
    v = (q[going] / size[going, None]).astype(np.float32)
    sides = lambda up, down: np.concatenate([np.where(v > 0, up, 0), np.where(v < 0, down, 0)], axis=1).astype(np.float32)
    signed, square, sign = sides(v, v), sides(v * v, v * v), sides(1, 1)
    length = (v * v).sum(1)
    known, read_q, read_x, seen = 0, 0, 0, 0
    depth = 0
    for part in DEPTHS:
        begin, depth = depth, max(depth, min(n, math.ceil(part * n)))
        if depth == begin or not len(going):
            continue
        taken, found, squared = lists.read(begin, depth)
        known = known + signed @ found
        read_q = read_q + square @ taken
        read_x = read_x + sign @ squared
        # What an unread component adds is no better than the contribution last read from its list.
        seen = seen + taken
        front = signed * lists.last(depth)
        behind = front.sum(1)[:, None] - front @ seen
        slack = SLACK * np.sqrt(length[:, None] * lists.norm)
        # Cauchy's inequality over the unread parts; their squares are known up to rounding, too.
        rest = lambda whole, read: np.maximum(whole - read, 0) + SLACK * whole
        reach = np.sqrt(rest(length[:, None], read_q) * rest(lists.norm, read_x)) + slack
        upper = known + np.minimum(behind + slack, reach)
        lower = known - reach
        lower[own[going]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(going), -np.inf)
        open_ = (upper >= bar[:, None]) & ~own[going]
        few = open_.sum(1) <= max(k, OPEN_PART * n)
        for i in np.flatnonzero(few) if depth < n else range(len(going)):
            left[going[i]] = np.flatnonzero(open_[i])
        depths[going] = depth / n
        more = ~few
        going, signed, square, sign, length, known, read_q, read_x = (m[more] for m in (going, signed, square, sign, length, known, read_q, read_x))
    return left, depths


def search_block(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, x: np.ndarray, k: int):
    """(query position, candidate position, score) of each query's k best in one block, how many scores were resolved, and the mean depth."""
    order = np.argsort(vec_ids, kind="stable")
    lists = Lists(x[order])
    ids = vec_ids[order]
    exact = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53
    at, who, what, resolved, depths = [], [], [], 0, 0.0
    for first in range(0, len(q), BATCH):
        batch = q[first : first + BATCH]
        open_, depth = open_candidates(lists, batch, query_ids[first : first + BATCH, None] == ids[None, :], k)
        depths += float(depth.sum())
        for i, left in enumerate(open_):
            resolved += len(left)
            if exact:
                score = np.rint(lists.x[left] @ batch[i]).astype(np.int64)
                best = np.lexsort((ids[left], -score))[:k]
            else:
                own = [int(v) for v in batch[i]]
                score = np.array([sum(a * int(b) for a, b in zip(own, row)) for row in lists.x[left]], object)
                best = np.array(sorted(range(len(left)), key=lambda j: (-score[j], ids[left[j]]))[:k], int)
            at.append(np.full(len(best), first + i))
            who.append(order[left[best]])
            what.append(score[best])
    return np.concatenate(at), np.concatenate(who), np.concatenate(what), resolved, depths / len(q)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score.

    Both frames hold an id and a vector of integers as array<double> (see ``scaled``).
    """
    if k < 1:
        raise ValueError("k must be positive")

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("width", F.size("v"))

    q = clean(queries).dropDuplicates(["id", "v"])
    c = clean(candidates).groupBy("id", "v", "width").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    n_c, n_q = clean(candidates).count(), clean(queries).count()
    blocks_c, blocks_q = max(1, -(-n_c // CANDIDATES_A_BLOCK)), max(1, -(-n_q // QUERIES_A_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("cb", dealt(blocks_c)).withColumn("qb", every(blocks_q))
    q = q.withColumn("qb", dealt(blocks_q)).withColumn("cb", every(blocks_c))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "query_key", "vec_id", "copies", "score")}).astype("int64")
        ids, others = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        at, who, what, *_ = search_block(ids, np.stack(left["v"].to_list()), others, np.stack(right["v"].to_list()), k)
        return pd.DataFrame({"query_id": ids[at], "query_key": left["key"].to_numpy(np.int64)[at], "vec_id": others[who], "copies": right["copies"].to_numpy(np.int64)[who], "score": what})

    found = (
        q.withColumn("key", F.xxhash64("v"))
        .groupBy("qb", "cb", "width")
        .cogroup(c.groupBy("qb", "cb", "width"))
        .applyInPandas(run, "query_id long, query_key long, vec_id long, copies long, score long")
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        each.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
