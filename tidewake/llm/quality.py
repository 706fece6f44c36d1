"""Document quality by hierarchical empirical Bayes.

A logistic classifier gives each text the evidence of its form (letters, signs,
repeats, lengths). Labelled documents also say how good a host is, and a path of
a host: each has a beta posterior whose prior is the level above, a host's the
global rate, a path's its host's posterior. The strength of either prior is
estimated from all labelled sites by analysis of variance (hosts around the global
rate, paths around their own host's), so sparse sites shrink towards their prior and
full ones keep their own rate. A document's
log-odds are its classifier's plus its path's, less the global ones.

The classifier is fitted to at most ``ROWS_A_CLASS`` labelled training rows of
either label; site counts come from all of them, by grouped aggregation. A
document doesn't count for its own site: its label is taken out of the posterior.

Null texts count as empty. Null hosts and paths are sites of their own. Rows
without an id are scored, not learned from, and not held out; repeated rows give
a result each. Without labels of both kinds the classifier says 0.5 for all. A score
of exactly 0.5 is kept. Very long texts are read whole, words hashed in blocks; the
sample holds at most ``common.SAMPLE_BYTES`` of text of either label. Extra columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import labelled_sample, slices, words

ROWS_A_CLASS = 1500
FEATURES = 9
#: Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 10_000.0)
#: Rows of a site are dealt to so many tasks.
SALTS = 16

_KIND = np.zeros((256, 5), np.uint8)
for _i in range(256):
    _KIND[_i, 0] = 97 <= _i <= 122 or _i >= 128  # lower-case and past ASCII
    _KIND[_i, 1] = 65 <= _i <= 90
    _KIND[_i, 2] = 48 <= _i <= 57
    _KIND[_i, 3] = _i in b".,;:'\"-()"
    _KIND[_i, 4] = 33 <= _i < 127 and not (chr(_i).isalnum() or _i in b".,;:'\"-()")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Form of each text: shares of kinds of characters, distinct words and lines, and lengths."""
    starts, ends, hashes, first = words(data, offsets)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, FEATURES))
    some = np.flatnonzero(np.diff(offsets))
    for j in range(5):
        if len(some):
            out[some, j] = np.add.reduceat(_KIND[:, j][data], offsets[:-1][some], dtype=np.int64) / size[some]
    count = np.diff(first)
    long_ = np.concatenate([[0], np.cumsum(ends - starts)])
    out[:, 5] = (long_[first[1:]] - long_[first[:-1]]) / np.maximum(count, 1) / 10
    text = np.repeat(np.arange(n), count)
    # Distinct words and distinct neighbours within each text, by one sort of the piece.
    for j, keys in ((6, hashes), (7, hashes ^ np.roll(hashes, 1) * np.uint64(3))):
        order = np.lexsort((keys, text))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
        out[:, j] = np.bincount(text[order], new, n) / np.maximum(count, 1)
    out[:, 8] = np.log1p(count) / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on x, its squares and a constant; classes weigh alike."""
    z = expand(x)
    w = np.zeros(z.shape[1])
    weight = np.where(y, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(len(w))
        w += np.linalg.solve(h, g)
    return w


def expand(x: np.ndarray) -> np.ndarray:
    """Features scaled by fixed numbers, their squares and a constant."""
    z = x * np.array([1, 4, 10, 4, 10, 1, 1, 1, 1])
    return np.concatenate([z, z * z, np.ones((len(x), 1))], axis=1)


def classify(docs: DataFrame, weights: np.ndarray | None, carried: list[str], text_col: str) -> DataFrame:
    """The carried columns and ``evidence``, the classifier's log-odds of every whole text."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(len(carried))):
                z = expand(features(data, offsets)) @ weights if weights is not None else np.zeros(end - first)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(carried))), pa.array(np.clip(z, -12, 12))], names=[*carried, "evidence"])

    return docs.select(*carried, F.col(text_col)).mapInArrow(run, f"{kinds}, evidence double")


def strength(sites: DataFrame, above: list[str]) -> float:
    """Of the beta prior of sites (n, good) around the rate of the level above them: 1 / intraclass correlation - 1, within STRENGTH.

    ``above`` are the columns of that level, none for the global rate; only the
    spread of sites within it counts.
    """
    square = lambda c: F.sum(F.col(c) * F.col(c))
    level = sites.groupBy(*above).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("good").alias("good"), square("n").alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("between"))
    r = level.agg(
        F.count("*").alias("levels"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("between").alias("between"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("means"), F.sum(F.col("nn") / F.col("n")).alias("sizes"),
    ).first()
    if not r.n or r.k <= r.levels or r.n <= r.k:
        return STRENGTH[1]
    msb = max(0.0, r.between - r.means) / (r.k - r.levels)
    msw = max(1e-12, r.good - r.between) / (r.n - r.k)
    n0 = (r.n - r.sizes) / (r.k - r.levels)
    rho = (msb - msw) / (msb + (n0 - 1) * msw)
    return float(np.clip(1 / rho - 1, *STRENGTH)) if rho > 0 else STRENGTH[1]


def score(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", label_col: str = "quality") -> DataFrame:
    """(id, doc_score, host_rate, path_rate, score, keep) of every whole text; ``keep`` is 1 from 0.5 on."""
    sample = labelled_sample(docs, labels, usable, id_col, text_col, label_col, ROWS_A_CLASS)
    weights = None
    if len({y for _, y in sample}) == 2:
        # Piece by piece, so that the driver needs no more than a task.
        x = np.concatenate([features(data, offsets) for _, _, data, offsets in slices(pa.array([t for t, _ in sample], pa.string()))])
        weights = fit_logistic(x, np.array([float(y) for _, y in sample]))

    known = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    none = F.lit("\0")
    rows = classify(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host).cast("string"), none).alias("host"), F.coalesce(F.col(path).cast("string"), none).alias("path")), weights, ["id", "host", "path"], "text")
    sites = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host).cast("string"), none).alias("host"), F.coalesce(F.col(path).cast("string"), none).alias("path"))
    paths = sites.join(known, "id").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (float(whole.good or 0) + 0.5) / (float(whole.n or 0) + 1.0)
    of_host, of_path = strength(hosts, []), strength(paths, ["host"])

    own_n, own_y = F.when(F.col("y").isNotNull(), 1).otherwise(0), F.coalesce("y", F.lit(0))
    count = lambda c, own: F.coalesce(F.col(c), F.lit(0)) - own
    host_rate = (of_host * rate + count("host_good", own_y)) / (of_host + count("host_n", own_n))
    path_rate = (of_path * F.col("host_rate") + count("path_good", own_y)) / (of_path + count("path_n", own_n))
    logit = lambda p: F.log(p / (1 - p))
    sited = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host").select("host", "path", F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good")
    # A path without labels still has its host's.
    bare = hosts.select("host", F.col("n").alias("bare_n"), F.col("good").alias("bare_good"))
    # A host may hold any share of the rows: they are dealt, and sites go to each part.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "evidence"), F.lit(SALTS)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    joined = rows.join(sited.withColumn("salt", parts), ["host", "path", "salt"], "left").join(bare.withColumn("salt", parts), ["host", "salt"], "left").join(known, "id", "left")
    joined = joined.withColumn("host_n", F.coalesce("host_n", "bare_n")).withColumn("host_good", F.coalesce("host_good", "bare_good"))
    odds = F.col("evidence") + logit(F.col("path_rate")) - float(np.log(rate / (1 - rate)))
    return (
        joined.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.col("evidence")))).alias("doc_score"), "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("score"))
        .withColumn("keep", (F.col("score") >= 0.5).cast("int"))
    )
