"""Logs, artifacts, manifests and configurations."""

import pytest
from pyspark.sql import functions as F

from tidewake.sources import adapters, config, logs
from tidewake.streaming import market

PATH = "/root/testdata/sf0.001"


def test_event_log_round_trip(spark, tmp_path):
    t = adapters.ticks(spark, PATH)
    path = str(tmp_path / "log")
    logs.write_events(t, path)
    back = logs.read_events(spark, path, t.schema)
    assert sorted(map(str, back.select(*t.columns).collect())) == sorted(map(str, t.collect()))
    name = t.first().instrument
    one = logs.read_events(spark, path, t.schema, name)
    assert one.count() == t.where(F.col("instrument") == name).count()
    assert "PartitionFilters: [isnotnull(instrument" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        logs.read_events(spark, path, t.schema, "nothing")


def test_trials_must_be_equally_long(spark, tmp_path):
    path = str(tmp_path / "trials")
    rows = [("a", [0.1, 0.2], "h", 1), ("b", [0.1, 0.3], "g", 2)]
    logs.append_trials(spark.createDataFrame(rows, logs.TRIALS), path)
    assert logs.performance_rows(logs.read_trials(spark, path)).count() == 4
    logs.append_trials(spark.createDataFrame([("c", [0.5], "x", 3)], logs.TRIALS), path)
    with pytest.raises(ValueError):
        logs.performance_rows(logs.read_trials(spark, path))


def test_artifact_hash_ignores_order_and_runtime():
    a, b = logs.artifact({"x": 1, "y": [2]}, {"s": 1}), logs.artifact({"y": [2], "x": 1}, {"s": 9})
    assert a["hash"] == b["hash"] != logs.artifact({"x": 2, "y": [2]}, {})["hash"]


def test_manifest_boundary():
    m = logs.manifest(1260, 0.2, "h", "s")
    assert (m["boundary_index"], m["n_holdout"]) == (1008, 252)
    with pytest.raises(ValueError):
        logs.manifest(10, 1.5, "h", "s")


@pytest.mark.parametrize("text", ["fast = 600", "cash = 0", "latency_ms = -1", "qty = 0", "taker_ppm = 100001", "funding_interval_ms = -1", "surprise = 1"])
def test_bad_engine_configs(text):
    with pytest.raises(ValueError):
        config.engine_config(f'instrument = "x"\n{text}')


def test_good_configs():
    assert config.engine_config('instrument = "x"\nfast = 5').fast == 5
    assert config.study_config({"features": [("sma", {})], "n_splits": 3}).n_splits == 3
    for bad in ({"features": []}, {"features": [("sma", {})], "n_splits": 1}, {"features": [("sma", {})], "scheme": "x"}, {"features": [("sma", {})], "more": 1}):
        with pytest.raises(ValueError):
            config.study_config(bad)


def test_streamed_fills_are_applied_once(spark, tmp_path):
    rows = [(1, 1, 10), (1, 1, 10), (1, 2, 5), (2, 1, 7)]
    df = spark.createDataFrame([(*r, 1_700_000_000 + i) for i, r in enumerate(rows)], "cloid long, fill_id long, qty long, s long").withColumn("at", F.timestamp_seconds("s"))
    path = str(tmp_path / "fills")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = market.drained(market.first_fills(stream)).collect()
    assert sorted((r.cloid, r.fill_id) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_artifacts_and_manifests_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, "é"), (1, 5, 'q"')], "b long, a long, c string")
    documents = logs.artifact_rows(rows, ["b", "a", "c"])
    assert {r.text for r in documents.collect()} == {'{"a":null,"b":2,"c":"é"}', '{"a":5,"b":1,"c":"q\\""}'}
    for _ in range(2):
        logs.write_artifacts(documents, str(tmp_path / "a"))
    found = logs.read_artifacts(spark, str(tmp_path / "a")).collect()
    assert len(found) == 2 and all(r.fits for r in found)
    assert logs.read_artifacts(spark, str(tmp_path / "a"), found[0].hash).collect() == [found[0]]
    m = logs.manifest(1260, 0.2, "h", "s")
    assert logs.read_manifest(logs.manifest_text(m)) == m
    with pytest.raises(ValueError):
        logs.read_manifest(logs.manifest_text(m | {"n_research": 1}))
