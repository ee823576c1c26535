"""Quantiles of a growing history: equal to those over all rows, from summaries and the values near the ranks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import clean, features, history, scaling
from txnrisk.operators.ranks import fit_quantiles

PROBS = [0.0, 0.25, 0.95, 1.0]


def days(spark, n=4000, seed=1):
    """Days of different size and spread; one with a value that a third of it holds, one with nothing but nulls."""
    rng = np.random.default_rng(seed)
    parts = []
    for day in range(6):
        amount = rng.lognormal(day / 2, 1.5, n * (1 + day % 3))
        if day == 2:
            amount[: len(amount) // 3] = 5.0
        if day == 4:
            amount[:] = np.nan
        parts.append(pd.DataFrame({"day": f"2025-01-0{day + 1}", "amount": amount, "age": rng.integers(0, 50, len(amount)).astype(float)}))
    return spark.createDataFrame(pd.concat(parts)).repartition(4).withColumn("amount", F.when(F.rand(3) > 0.01, F.col("amount")))


def test_summary_counts_every_value(spark):
    df = days(spark).persist()
    rows = history.summarize(df, ["amount", "age"], "day").collect()
    assert len(rows) == 11 and all(sum(r["counts"]) == r["n"] and len(r["cuts"]) == 255 for r in rows)
    for r in rows[:3]:
        values = [x[0] for x in df.filter(F.col("day") == r["day"]).select(r["column"]).collect() if x[0] is not None]
        assert r["counts"] == np.bincount(np.searchsorted(r["cuts"], values, side="right"), minlength=256).tolist()


@pytest.mark.parametrize("margin", [None, 1e-6])
def test_refit_equals_a_fit_over_all(spark, tmp_path, monkeypatch, margin):
    """Days are appended one after another, one of them twice; with a margin that is too small the cuts are widened, and many
    values are summed up piece by piece."""
    if margin:
        monkeypatch.setattr(history, "BROADCAST_ROWS", 500)
        monkeypatch.setattr(history, "_MARGIN", margin)
        monkeypatch.setattr(history, "_SKETCH", 64)
    df, path = days(spark).persist(), str(tmp_path / "summaries")
    for day in (["2025-01-01", "2025-01-02", "2025-01-03"], ["2025-01-04"], ["2025-01-04"], ["2025-01-05", "2025-01-06"]):
        history.write_summary(df.filter(F.col("day").isin(day)), ["amount", "age"], "day", path)
    summaries = spark.read.schema(history.summarize(df, ["amount", "age"], "day").schema).parquet(path)
    got = history.refit(df, summaries, ["amount", "age"], PROBS, "day")
    for c in ("amount", "age"):
        values = np.array([r[0] for r in df.select(c).collect() if r[0] is not None and not math.isnan(r[0])])
        assert got[c][0] == len(values) and np.allclose(got[c][1], np.quantile(values, PROBS), rtol=1e-12)
    assert np.allclose(history.iqr_bounds(df, summaries, "amount", "day"), clean.iqr_bounds(df, "amount"))
    if margin is None:
        assert np.isclose(history.high_amount_cut(df, summaries, "amount", "day"), features.high_amount_cut(df))
        assert history.fit_robust(df, summaries, ["age"], "day") == scaling.fit_robust(df, ["age"])


def test_only_values_near_the_cuts_are_read(spark, tmp_path):
    """The bounds of what is read reach the scan, and hold a small part of the history."""
    path = str(tmp_path / "history")
    days(spark).filter("day <> '2025-01-05'").write.partitionBy("day").parquet(path)
    df = spark.read.schema("amount double, age double, day string").parquet(path)
    summaries = history.summarize(df, ["amount"], "day").persist()
    seen, real = [], history.near_values

    def watched(*given):
        near = real(*given)
        seen.append((near._jdf.queryExecution().executedPlan().toString(), near.agg(F.sum("size")).first()[0]))
        return near

    history.near_values = watched
    try:
        got = history.refit(df, summaries, ["amount"], [0.75], "day")["amount"]
    finally:
        history.near_values = real
    assert np.isclose(got[1][0], fit_quantiles(df, "amount", [0.75])[0], rtol=1e-12)
    assert len(seen) == 1 and "GreaterThanOrEqual(amount," in seen[0][0] and "LessThanOrEqual(amount," in seen[0][0]
    assert seen[0][1] < 0.05 * got[0]


def test_no_values_no_quantiles(spark):
    empty = spark.createDataFrame([], "day string, amount double")
    nulls = spark.createDataFrame([("a", None), (None, float("nan"))], empty.schema)
    for df in (empty, nulls):
        summaries = history.summarize(df, ["amount"], "day")
        assert summaries.count() == 0 and history.refit(df, summaries, ["amount"], [0.5], "day") == {}
        assert history.iqr_bounds(df, summaries, "amount", "day") == (None, None) and history.high_amount_cut(df, summaries, "amount", "day") == math.inf
    one = spark.createDataFrame([(None, 3.0), (None, 3.0), ("a", 9.0)], empty.schema)
    assert history.refit(one, history.summarize(one, ["amount"], "day"), ["amount"], [0.5, 1.0], "day") == {"amount": (3, [3.0, 9.0])}
