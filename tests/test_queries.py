"""Each query of the inventory against its SQL on the smallest tables."""

import compare
import pytest

from catchment_engine import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, con, name):
    compare.same(queries.queries()[name](spark, SF), con, oracles.oracle_sql()[name])


def test_every_query_has_sql_or_is_known_not_to():
    assert {*queries.queries()} - {*oracles.oracle_sql()} == {"mc_weighted_ci", "mutation_report"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from catchment_engine.streaming import events

    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(f"file://{tmp_path}/events")
    stream = events.windowed_value(events.read_events(spark, f"file://{tmp_path}/events", table))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"file://{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r["window_start"], r["event_type"], r["n"], round(r["value"], 6)) for r in df.collect())
    assert rows(spark.table("windows")) == rows(events.windowed_value(table))
