"""Hand-computed metrics, ties, one-class input, empty input."""

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import metrics
from txnrisk.plans import labels

BASIC = [(0.8, 1), (0.4, 0), (0.35, 1), (0.1, 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ml_prob double, is_fraud int")


def test_basic(spark):
    df = frame(spark, BASIC)
    got = metrics.areas(df).first()
    assert got["average_precision"] == pytest.approx(5 / 6) and got["roc_auc"] == pytest.approx(0.75)
    curve = {r["threshold"]: (r["precision"], r["recall"]) for r in metrics.pr_curve(df).collect()}
    assert curve == {0.8: (1.0, 0.5), 0.4: (0.5, 0.5), 0.35: (pytest.approx(2 / 3), 1.0), 0.1: (0.5, 1.0)}
    assert metrics.best_threshold(df).first()["threshold"] == 0.35
    assert metrics.best_threshold(df, 1.01).first()["threshold"] == 0.35


def test_lowest_threshold_wins_ties(spark):
    df = frame(spark, [(0.9, 1), (0.7, 1), (0.2, 0)])
    assert metrics.best_threshold(df, 0.5).first()["threshold"] == 0.7


def test_ties(spark):
    df = frame(spark, [(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)])
    assert metrics.roc_auc(df).first()[0] == 0.5 and metrics.pr_curve(df).count() == 1


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    df = frame(spark, [(0.1, label), (0.9, label)])
    assert metrics.roc_auc(df).first()[0] == 0.0
    assert metrics.average_precision(df).first()[0] == float(label)
    df = df.withColumn("predicted", metrics.apply_threshold(F.col("ml_prob")))
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["accuracy"]["support"] == 2 and report[str(1 - label)]["f1_score"] == 0.0


def test_no_rows(spark):
    df = frame(spark, []).withColumn("predicted", F.lit(1))
    assert metrics.roc_auc(df).first()[0] == 0.0 and metrics.best_threshold(df).count() == 0
    assert tuple(metrics.confusion(df).first()) == (0, 0, 0, 0)


def test_pick_capped(spark):
    rows = [(0, "a", 0.9), (1, "b", 0.8), (2, "c", 0.8), (3, "d", 0.81)]
    df = spark.createDataFrame(rows, "ordinal int, model string, accuracy double")
    assert metrics.pick_capped(df).first()["model"] == "b"
    assert metrics.pick_capped(df.filter("accuracy >= 0.81")).first()["model"] == "a"
    assert [r["model"] for r in metrics.compare_models(df, "accuracy").collect()] == ["a", "d", "b", "c"]


def test_metrics_without_transactions(spark):
    df = spark.createDataFrame([], "user_id int, predicted int, probability double, actual_label int")
    got = labels.labelled_metrics(df, 1).first()
    assert got["metrics_type"] == "none" and got["accuracy"] == 0.0 and got["auc"] == 0.0


def test_label_order_and_owner(spark):
    txns = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "transaction_id long, user_id long")
    events = spark.createDataFrame([(1, 7, 0, 1), (1, 7, 1, 2), (1, 8, 0, 3), (2, 7, 2, 4), (9, 7, 1, 5), (3, 8, None, 6)],
                                   "transaction_id long, user_id long, label int, seq int")
    status = {r["seq"]: r["status"] for r in labels.label_status(txns, events).collect()}
    assert status == {1: 200, 2: 200, 3: 403, 4: 400, 5: 404, 6: 400}
    got = {r["transaction_id"]: r["actual_label"] for r in labels.apply_labels(txns, events).collect()}
    assert got == {1: 1, 2: None, 3: None}
