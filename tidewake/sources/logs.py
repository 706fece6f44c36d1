"""Event logs, trial logs, result artifacts, manifests and metrics text."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIALS = "name string, returns array<double>, config_hash string, trial_seq long"


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An event log: Parquet, one folder an instrument, rows of a file in order."""
    events.repartition("instrument").sortWithinPartitions("instrument", "exch_us", "tid").write.mode(mode).partitionBy("instrument").parquet(path)


def read_events(spark: SparkSession, path: str, schema, instrument: str | None = None) -> DataFrame:
    """A log, or the part of one instrument, of which only that folder is read; another instrument is an error."""
    events = spark.read.schema(schema).parquet(path)
    if instrument is not None:
        events = events.where(F.col("instrument") == instrument)
        if events.isEmpty():
            raise ValueError(f"the log holds no events of {instrument}")
    return events


def append_trials(trials: DataFrame, path: str) -> None:
    """Append trials as JSON lines."""
    trials.select("name", "returns", "config_hash", "trial_seq").write.mode("append").json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """A trial log; a line that is no trial is an error."""
    return spark.read.schema(TRIALS).option("mode", "FAILFAST").json(path)


def performance_rows(trials: DataFrame) -> DataFrame:
    """(trial_seq, name, t, r) of all trials, whose returns must be equally long."""
    if trials.select(F.size("returns").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("trials differ in length")
    return trials.select("trial_seq", "name", F.posexplode("returns").alias("t", "r"))


def artifact(deterministic: dict, runtime: dict) -> dict:
    """A results document: what must repeat, its hash, and what may differ from run to run."""
    text = json.dumps(deterministic, sort_keys=True, separators=(",", ":"))
    return {"deterministic": deterministic, "hash": hashlib.sha256(text.encode()).hexdigest(), "runtime": runtime}


def artifact_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(text, hash) of results documents: canonical JSON of the columns in order of their names, nulls told, and its SHA-256."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.select(text.alias("text")).withColumn("hash", F.sha2("text", 256))


def write_artifacts(documents: DataFrame, path: str) -> None:
    """Documents in folders by the first two digits of their hash, a line a document; a document that is there already is written again with the same name."""
    documents.dropDuplicates(["hash"]).withColumn("at", F.substring("hash", 1, 2)).write.mode("append").partitionBy("at").json(path)


def read_artifacts(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """(hash, text, fits) of all documents, or of one, of which only its folder is read; whether a text still has its hash."""
    found = spark.read.schema("text string, hash string, at string").option("mode", "FAILFAST").json(path)
    if digest is not None:
        found = found.where((F.col("at") == digest[:2]) & (F.col("hash") == digest))
    return found.dropDuplicates(["hash", "text"]).select("hash", "text", (F.sha2("text", 256) == F.col("hash")).alias("fits"))


def manifest_text(of: dict) -> str:
    """A manifest as JSON, keys in order."""
    return json.dumps(of, sort_keys=True, indent=2)


def read_manifest(text: str) -> dict:
    """A manifest from its JSON; one whose parts don't fit each other is an error."""
    found = json.loads(text)
    again = manifest(found["n_total"], found["holdout_fraction"], found["holdout_sha256"], found["source"])
    if again != found:
        raise ValueError("the manifest's numbers don't fit each other")
    return found


def manifest(n_total: int, fraction: float, holdout_hash: str, source: str) -> dict:
    """A holdout's manifest; the boundary is floor(n * (1 - fraction))."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    cut = int(n_total * (1 - fraction))
    return {"source": source, "n_total": n_total, "n_research": cut, "n_holdout": n_total - cut, "boundary_index": cut, "holdout_fraction": fraction, "holdout_sha256": holdout_hash}


def metrics_text(rows: DataFrame, prefix: str = "tidewake") -> DataFrame:
    """(text) of (name, kind, value) rows in the exposition format of metrics, one row a metric."""
    name = F.concat(F.lit(prefix + "_"), "name")
    return rows.select(F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("kind"), F.lit("\n"), name, F.lit(" "), F.col("value").cast("string")).alias("text"))


def backoff_ms(attempt: Column, base_ms: int = 250, cap_ms: int = 30_000) -> Column:
    """Delay before a reconnection attempt (from 1): doubled each time, at most ten times, and capped; up to half of it is added as jitter."""
    return F.least(F.lit(cap_ms), base_ms * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(attempt - 1, F.lit(10))))).cast("long")


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows behind the log's last key, so that a repeated run adds nothing. Keys only grow; one writer at a time."""
    spark = rows.sparkSession
    if (last := last_key(spark, path, rows.schema, key)) is not None:
        rows = rows.where(F.col(key) > F.lit(last))
    rows.write.mode("append").parquet(path)


def last_key(spark: SparkSession, path: str, schema, key: str):
    """The greatest key of a log; None where there is no log or no row."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path).agg(F.max(key)).first()[0]


def last_row(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """The row of the greatest key."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy().agg(F.max_by(F.struct(*rows.columns), key).alias("x")).select("x.*")


def freeze(params: DataFrame, path: str) -> str:
    """Write fitted parameters, a row a model, and give the hash of their values."""
    params.write.parquet(path)
    return frozen_hash(params.sparkSession.read.schema(params.schema).parquet(path))


def frozen_hash(params: DataFrame) -> str:
    """A hash of rows in any order: the exclusive or of both halves of each row's digest, and their number."""
    digest = rows_hash(*sorted(params.columns))
    half = lambda at: F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("long"))
    r = params.agg(half(1).alias("a"), half(16).alias("b"), F.count("*").alias("n")).first()
    return f"{r.a or 0:015x}{r.b or 0:015x}-{r.n}"


def frozen(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """Frozen parameters; others than those of the hash are an error."""
    params = spark.read.parquet(path)
    if frozen_hash(params) != digest:
        raise ValueError("the parameters have changed since they were frozen")
    return params


def rows_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns, nulls told from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
