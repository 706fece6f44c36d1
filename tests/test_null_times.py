"""Queries over ticks of which some have no time, against their SQL: those come last in their instrument."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import PATH, rows
from tidewake.operators import scan
from tidewake.plans import registry

NAMES = ["p20_warmed", "w07_feature_matrix", "w01_rolling_sum", "w02_log_return", "w05_momentum", "w06_zscore", "w09_sma_cross", "w10_standardised", "w11_next_return", "w12_turnover", "w22_causality"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("times"))
    ts = F.when(F.col("event_id") % 31 != 7, F.col("ts"))
    spark.read.parquet(f"{PATH}/events.parquet").withColumn("ts", ts).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("piece", [64, 1 << 16])
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, monkeypatch, name, piece):
    monkeypatch.setattr(scan, "PIECE", piece)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder)
    cursor = con.execute(registry.oracle_sql()[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert want[1] and rows(df.columns, [tuple(r) for r in df.collect()]) == want
