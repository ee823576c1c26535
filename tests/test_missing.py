"""Rows and values that are missing or odd: no row is lost, and what is missing takes no part."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from txnrisk.functions import cleaning
from txnrisk.operators import clean, metrics, profile, scaling, split
from txnrisk.streaming.jobs import dedup_stream, write_alert_batch

NAN = float("nan")


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (NAN,), (None,)], "x double")


def test_nan_is_missing(numbers):
    assert profile.null_counts(numbers).first()["nulls"] == 2
    bins = profile.histogram(numbers, "x", 3).collect()
    assert [r["count"] for r in bins] == [3, 0, 1] and bins[0]["lower"] == 1.0 and bins[-1]["upper"] == 100.0
    assert [r["x"] for r in clean.outliers(numbers, "x").collect()] == [100.0]
    assert sum(r["x"] is None for r in clean.winsorize(numbers, "x").collect()) == 2
    mean, deviation = scaling.fit_standard(numbers, ["x"])["x"]
    assert mean == 26.5 and math.isclose(deviation, 42.4411, rel_tol=1e-4)


def test_rows_without_a_score_take_no_part(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (None, 1), (NAN, 0), (NAN, 1), (0.1, None)]
    df = spark.createDataFrame(rows, "ml_prob double, is_fraud int")
    known = spark.createDataFrame(rows[:3], "ml_prob double, is_fraud int")
    assert metrics.pr_curve(df).collect() == metrics.pr_curve(known).collect()
    assert metrics.pr_curve(df).agg(F.max("recall")).first()[0] == 1.0
    assert metrics.areas(df).first() == metrics.areas(known).first()


def test_split_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None if i % 3 else i, float(i)) for i in range(300)], "transaction_id long, x double")
    train, test = split.stratified_split(df)
    assert train.count() + test.count() == 300
    assert 10 < test.filter("transaction_id IS NULL").count() < 100


def test_unlabelled_rows_have_no_weight(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,), (None,), (2,)], "is_fraud int")
    assert {r["is_fraud"]: r["weight"] for r in split.class_weights(df).collect()} == {0: 4 / 6, 1: 2.0}
    assert split.with_class_weights(df).count() == 4


@pytest.mark.parametrize("value, verified", [("1.0", 1), ("2", 1), ("0.5", 0), ("-1", 1), ("0", 0), ("nan", 0), (" YES ", 1), ("no", 0), (None, 0)])
def test_kyc_as_a_number(spark, value, verified):
    df = spark.createDataFrame([(value,)], "k string")
    assert df.select(cleaning.kyc_flag(F.col("k"))).first()[0] == verified


@pytest.mark.parametrize("text, when", [
    ("2025/01/02 03:04", (2025, 1, 2, 3, 4)), ("01/02/2025 03:04:00", (2025, 1, 2, 3, 4)), ("Jan 2 2025 03:00", (2025, 1, 2, 3, 0)),
    ("2025-01-01T03:00:00+05:30", (2025, 1, 1, 3, 0)), ("2025-01-01 03:00:00Z", (2025, 1, 1, 3, 0)), ("2025-01-02", (2025, 1, 2, 0, 0)), ("then", None), (None, None),
])
def test_spellings_of_a_time(spark, text, when):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cleaning.to_timestamp(F.col("t"))).first()[0] == (when and datetime.datetime(*when))


def test_a_typed_time_is_not_parsed(spark):
    df = spark.range(1).select(F.current_timestamp().alias("t")).select(cleaning.to_timestamp(F.col("t")).alias("t"))
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_alerts_without_an_id_are_all_stored(spark, tmp_path):
    rows = [(1, 0.5), (1, 0.5), (None, 0.7), (None, 0.7), (None, 0.9)]
    alerts = spark.createDataFrame(rows, "transaction_id long, risk_score double").withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))
    for _ in range(2):  # a retried batch replaces itself
        write_alert_batch(alerts, 3, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4


def test_stream_without_ids_loses_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (None,), (None,)], "transaction_id long").withColumn("timestamp", F.lit("2025-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = dedup_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("without_ids").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("without_ids").count() == 3
