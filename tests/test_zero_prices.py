"""Queries over ticks whose prices are 0 or near it, against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import PATH, rows
from tidewake.operators import features
from tidewake.plans import registry

NAMES = ["w11_next_return", "e02_walked_backtest", "w07_feature_matrix", "p20_warmed", "w02_log_return", "w05_momentum", "w03_realized_vol", "w10_standardised"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zero"))
    value = F.when(F.col("event_id") % 150 == 7, 0.0).when(F.col("event_id") % 5 == 1, 0.01).otherwise(F.col("value"))
    spark.read.parquet(f"{PATH}/events.parquet").withColumn("value", value).withColumn("props", F.lit('{"k": 0}')).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder)
    cursor = con.execute(registry.oracle_sql()[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    if name == "e02_walked_backtest":
        # Some level below 0 is sold to, or this says nothing.
        fills = registry.oracle_sql()[name].rpartition("SELECT instrument, CAST(sum(fills)")[0] + "SELECT min(volume) FROM d"
        assert con.execute(fills).fetchone()[0] < 0



def test_logarithm_of_a_ratio(spark):
    cases = [(2.0, 1.0, math.log(2)), (0.0, 1.0, -math.inf), (1.0, 0.0, math.inf), (0.0, 0.0, math.nan), (-1.0, 2.0, math.nan), (-2.0, -1.0, math.log(2)), (-1.0, 0.0, math.nan), (None, 0.0, None), (1.0, None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a double, b double")
    got = [r.x for r in df.select("i", features.ln_ratio(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert [repr(x) for x in got] == [repr(x) for *_, x in cases]
