"""Operators built for skew and size, against brute force on small fixtures with hot keys."""

from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import features, neighbours, profile
from txnrisk.operators.joins import hot_keys, skew_join
from txnrisk.operators.ranks import exact_quantiles, running_sums
from txnrisk.operators.smote import smote, synthetic_rows

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def numbers(kind, n, rng):
    return {"hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)), "constant": np.full(n, 5.0),
            "heavy": np.exp(rng.normal(size=n) * 4), "ties": rng.integers(0, 5, n).astype(float)}[kind]


@pytest.mark.parametrize("kind", ["hot", "constant", "heavy", "ties"])
@pytest.mark.parametrize("n", [1, 2, 4, 19, 3000])
def test_exact_quantiles(spark, kind, n):
    values = numbers(kind, n, np.random.default_rng(n))
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    row = exact_quantiles(df, ["x"], PROBS).first()
    assert row["n"] == n and np.allclose(row["quantiles"], np.quantile(values, PROBS), rtol=1e-12)


def test_quantiles_stay_exact_with_bad_cuts(spark, monkeypatch):
    """A sketch that is far off only unbalances the work."""
    from txnrisk.operators import ranks

    monkeypatch.setattr(ranks, "_ACCURACY", 3)
    monkeypatch.setattr(ranks, "_MARGIN", 0.0)
    values = np.random.default_rng(1).normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    assert np.allclose(exact_quantiles(df, ["x"], PROBS).first()["quantiles"], np.quantile(values, PROBS))


def test_quantiles_by_group_skip_null_and_nan(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "x": rng.normal(size=500), "y": rng.integers(0, 9, 500).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("y") == 3, None).when(F.col("y") == 4, float("nan")).otherwise(F.col("x")))
    got = {(r["g"], r["column"]): r["quantiles"] for r in exact_quantiles(df, ["x", "y"], [0.25, 0.5], ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g, "y"], np.quantile(part["y"], [0.25, 0.5]))
        assert np.allclose(got[g, "x"], np.quantile(part["x"][~part["y"].isin([3, 4])], [0.25, 0.5]))


def test_unbounded_groups_take_the_shuffle_path(spark, monkeypatch):
    from txnrisk.operators import ranks

    monkeypatch.setattr(ranks, "broadcast_if_few", lambda df, by: lambda rows: rows)
    pdf = pd.DataFrame({"g": np.arange(600) % 50, "x": np.arange(600.0)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["x"], [0.5], ["g"]).collect()
    assert {r["g"]: r["quantiles"][0] for r in got} == pdf.groupby("g")["x"].median().to_dict()


def test_no_values_no_quantiles(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).collect() == []
    assert profile.describe(df).first()["q50"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.permutation(9000) - 4500.0, "v": rng.integers(0, 9, 9000)})
    got = running_sums(spark.createDataFrame(pdf), "k", {"v": "upto"}, descending).toPandas().sort_values("k", ascending=not descending)
    assert (got["upto"].to_numpy() == got["v"].cumsum().to_numpy()).all() and len(got) == 9000


def test_skew_join_keeps_every_row(spark):
    keys = [1] * 4000 + [None] * 50 + list(range(2, 3000)) + [-5]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 2500)], "k int, v int")
    got = {r["i"]: r["v"] for r in skew_join(left, right, ["k"]).collect()}
    assert got == {i: (k * 10 if k is not None and 1 <= k < 2500 else None) for i, k in enumerate(keys)}


def test_only_hot_keys_are_broadcast(spark):
    keys = [1] * 4000 + list(range(2, 3000))
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    assert [r["k"] for r in hot_keys(counts, ["k"]).collect()] == [1]
    assert hot_keys(counts.filter("k > 1"), ["k"]) is None


def test_velocity_with_hot_customer(spark):
    rng = np.random.default_rng(4)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        customer = None if i % 500 == 7 else int(rng.integers(1, 20)) if rng.random() < 0.5 else 0
        at = start + timedelta(seconds=int(rng.integers(0, 5 * 86400)), microseconds=int(rng.integers(0, 3)))
        if rng.random() < 0.2:
            at = at.replace(minute=0, second=0, microsecond=0)
        rows.append((i, customer, None if i % 700 == 3 else at))
    df = spark.createDataFrame(rows, "transaction_id int, customer_id int, timestamp timestamp")
    got = {r["transaction_id"]: r["txn_last_24h"] for r in features.velocity_24h(df).collect()}
    times = defaultdict(list)
    for _, customer, at in rows:
        times[customer].append(at)
    day = timedelta(days=1)
    for i, customer, at in rows:
        want = 0 if customer is None or at is None else sum(t is not None and at - day < t <= at for t in times[customer])
        assert got[i] == want
    assert len(got) == len(rows)


def test_daily_runs_equal_one(spark):
    """Six runs of a day each, with what the run before carried over, against one run; customers that pause for days too."""
    rng = np.random.default_rng(6)
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 90 == 1 else int(rng.integers(0, 9)), start + timedelta(seconds=int(rng.integers(0, 72)) * 7200)) for i in range(400)]
    df = spark.createDataFrame(rows, "transaction_id int, customer_id int, timestamp timestamp").cache()
    want = {r["transaction_id"]: r["txn_last_24h"] for r in features.velocity_24h(df).collect()}
    got, carried = {}, None
    for day in range(6):
        at, end = start + timedelta(days=day), start + timedelta(days=day + 1)
        run = df.filter((F.col("timestamp") >= F.lit(at)) & (F.col("timestamp") < F.lit(end)))
        got |= {r["transaction_id"]: r["txn_last_24h"] for r in features.velocity_24h(run, carried).collect()}
        carried = features.velocity_boundary(run, F.lit(end), carried).checkpoint()
        assert carried.filter(F.col("timestamp") <= F.lit(at)).isEmpty()
    assert got == want and max(want.values()) > 5


def brute(points, copies, k):
    out = []
    for i, p in enumerate(points):
        gap = np.sqrt(((points - p) ** 2).sum(axis=1))
        spelled = np.repeat(gap, copies)
        out.append(np.sort(spelled)[1:k + 1])
    return out


@pytest.mark.parametrize("box_rows", [10, 100, 100000])
def test_nearest_vectors(spark, monkeypatch, box_rows):
    monkeypatch.setattr(neighbours, "BOX_ROWS", box_rows)
    rng = np.random.default_rng(box_rows)
    points = np.unique(np.round(np.concatenate([rng.normal(size=(250, 3)), rng.normal(size=(50, 3)) * 9, rng.integers(0, 3, (50, 3))]), 3), axis=0)
    copies = np.where(rng.random(len(points)) < 0.2, rng.integers(2, 12, len(points)), 1)
    df = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, copies))],
                               "key long, vec array<double>, copies long").repartition(4)
    got = {r["key"]: np.array(r["near"]) for r in neighbours.nearest_vectors(df, 5).collect()}
    assert len(got) == len(points)
    for i, want in enumerate(brute(points, copies, 5)):
        mine = np.sqrt(((got[i] - points[i]) ** 2).sum(axis=1))
        assert len(mine) == 5 and np.allclose(mine, want)


def test_fewer_neighbours_than_asked(spark):
    df = spark.createDataFrame([(0, [0.0], 1), (1, [1.0], 2)], "key long, vec array<double>, copies long")
    got = {r["key"]: r["near"] for r in neighbours.nearest_vectors(df, 5).collect()}
    assert got == {0: [[1.0], [1.0]], 1: [[1.0], [0.0]]}


def test_smote_balances_inside_the_hull(spark):
    rng = np.random.default_rng(5)
    minority = np.concatenate([rng.normal(size=(40, 2)), np.zeros((60, 2))])
    rows = [(*map(float, p), 1) for p in minority] + [(*map(float, p), 0) for p in rng.normal(size=(1037, 2)) + 50]
    df = spark.createDataFrame(rows, "a double, b double, is_fraud int")
    got = smote(df, ["a", "b"]).toPandas()
    assert got.groupby("is_fraud").size().to_dict() == {0: 1037, 1: 1037}
    made = got[got["synthetic"]]
    assert (made["is_fraud"] == 1).all() and len(made) == 937
    assert made["a"].between(minority[:, 0].min(), minority[:, 0].max()).all()
    # Of the copies of one vector, all have their nearest five among themselves.
    assert ((made["a"] == 0) & (made["b"] == 0)).sum() >= 60 * 9
    again = smote(df.repartition(3), ["a", "b"]).toPandas()
    key = ["a", "b", "is_fraud", "synthetic"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_smote_points_lie_on_segments(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "a double, b double")
    made = synthetic_rows(df, ["a", "b"], 50, k=5).toPandas()
    on = (made["a"].abs() < 1e-12) | (made["b"].abs() < 1e-12) | ((made["a"] + made["b"] - 1).abs() < 1e-12)
    assert len(made) == 50 and on.all()


def test_smote_needs_two(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 0), (2.0, 0)], "a double, is_fraud int")
    with pytest.raises(ValueError):
        smote(df, ["a"])


@pytest.mark.parametrize("few", [10_000, 0])
def test_boxes_stay_bounded(spark, monkeypatch, few):
    """Large boxes are cut until none is, whatever their shape; the neighbours stay exact, with tables of boxes too large to
    broadcast as with small ones."""
    monkeypatch.setattr(neighbours, "BOX_ROWS", 10)
    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(8)
    steep = np.column_stack((np.where(rng.random(300) < 0.01, -9.0, 9.0), rng.normal(size=300)))
    points = np.unique(np.concatenate([rng.normal(size=(900, 2)), rng.normal(size=(300, 2)) * 0.01 + 3, steep]).round(6), axis=0)
    df = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "key long, vec array<double>, copies long")
    placed, nodes, depth = neighbours.box_tree(df)
    sizes = [r["count"] for r in placed.groupBy("box").count().collect()]
    assert max(sizes) <= 2 * 10 and len(sizes) > 50 and sum(sizes) == len(points) and depth > 1
    own = neighbours.reached_boxes(placed.withColumnRenamed("box", "own").withColumn("reach", F.lit(0.0)), nodes, depth)
    assert own.filter("box = own").count() == len(points)
    got = {r["key"]: np.array(r["near"]) for r in neighbours.nearest_vectors(df, 3).collect()}
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gap, np.inf)
    for i, near in got.items():
        assert np.allclose(np.sort(gap[i])[:3], np.sqrt(((near - points[i]) ** 2).sum(axis=1)))
