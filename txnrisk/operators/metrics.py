"""Threshold curves, areas, confusion counts and reports for 0/1 labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions.cleaning import known
from txnrisk.operators.ranks import running_sums

_EPS = 1e-8


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def judged(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, y) of the rows that have a label and a score; null and NaN are no score."""
    return (df.select(known(F.col(score)).alias("threshold"), (F.col(label) == 1).cast("long").alias("y"))
            .filter(F.col("threshold").isNotNull() & F.col("y").isNotNull()))


def _cumulated(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, highest first: its positives and negatives, and the totals down to it."""
    per_score = (judged(df, score, label).groupBy("threshold")
                 .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    return running_sums(per_score, "threshold", {"pos": "tp", "neg": "fp"}, descending=True)


def pr_curve(df: DataFrame, score: str = "ml_prob", label: str = "is_fraud") -> DataFrame:
    """(threshold, precision, recall, tp, fp) per distinct score; recall is 1 where there is no positive."""
    positives = judged(df, score, label).agg(F.sum("y")).scalar()
    recall = F.when(positives > 0, F.col("tp") / positives).otherwise(1.0)
    return _cumulated(df, score, label).select(
        "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"), "tp", "fp")


def auc(pos: Column, neg: Column, upto: Column) -> Column:
    """The area under the ROC curve, as an aggregate over scores, highest first: their positives and negatives and the positives
    up to them. Ties count half; 0 where only one class occurs."""
    return ratio(F.sum(neg * (upto - pos / F.lit(2.0))), F.sum(pos).cast("double") * F.sum(neg))


def areas(df: DataFrame, score: str = "ml_prob", label: str = "is_fraud") -> DataFrame:
    """One row, from one pass down the scores. ``average_precision``: the sum of precision times recall step,
    0 without positives. ``roc_auc``: ties count half; 0 where only one class occurs."""
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return _cumulated(df, score, label).agg(
        ratio(F.sum(step), F.sum("pos")).alias("average_precision"),
        auc(F.col("pos"), F.col("neg"), F.col("tp")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "ml_prob", label: str = "is_fraud") -> DataFrame:
    return areas(df, score, label).select("average_precision")


def roc_auc(df: DataFrame, score: str = "ml_prob", label: str = "is_fraud") -> DataFrame:
    return areas(df, score, label).select("roc_auc")


def best_threshold(df: DataFrame, target_recall: float = 0.8, score: str = "ml_prob", label: str = "is_fraud") -> DataFrame:
    """One row: the threshold of highest precision among those that reach the target recall, the lowest on ties;
    where none reaches it, the threshold of highest F1."""
    precision, recall = F.col("precision"), F.col("recall")
    f1 = 2 * (precision * recall) / (precision + recall + _EPS)
    reached = recall >= target_recall
    return (pr_curve(df, score, label)
            .orderBy(F.desc(reached), F.desc(F.when(reached, precision).otherwise(f1)), F.asc("threshold"))
            .limit(1).select("threshold", "precision", "recall"))


def apply_threshold(prob: Column, threshold: Column | float = 0.5) -> Column:
    return (prob >= threshold).cast("int")


def confusion(df: DataFrame, pred: str = "predicted", label: str = "is_fraud") -> DataFrame:
    """One row: tn, fp, fn, tp (all 0 on no rows)."""
    hit, true = F.col(pred) == 1, F.col(label) == 1
    return df.agg(F.count_if(~hit & ~true).alias("tn"), F.count_if(hit & ~true).alias("fp"),
                  F.count_if(~hit & true).alias("fn"), F.count_if(hit & true).alias("tp"))


def binary_scores(df: DataFrame, pred: str = "predicted", label: str = "is_fraud") -> DataFrame:
    """One row: n, the confusion counts, accuracy, and precision, recall and F1 of class 1."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, pred, label).select(
        (tn + fp + fn + tp).alias("n"), "tn", "fp", "fn", "tp", ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(df: DataFrame, pred: str = "predicted", label: str = "is_fraud") -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` with precision, recall, f1_score, support."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1_score"), support.cast("long").alias("support"))

    zero = [ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp)]
    one = [ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)]
    accuracy = ratio(tp + tn, n)
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [ratio(a * (tn + fp) + b * (tp + fn), n) for a, b in zip(zero, one)]
    rows = [row("0", *zero, tn + fp), row("1", *one, tp + fn), row("accuracy", accuracy, accuracy, accuracy, n),
            row("macro avg", *macro, n), row("weighted avg", *weighted, n)]
    return confusion(df, pred, label).select(F.inline(F.array(*rows)))


def business_impact(df: DataFrame, pred: str = "predicted", label: str = "is_fraud") -> DataFrame:
    """One row: share of frauds caught and of legitimate transactions flagged, in percent."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, pred, label).select(
        (tp / (tp + fn + _EPS) * 100).alias("fraud_caught_pct"), (fp / (fp + tn + _EPS) * 100).alias("false_alarm_pct"))


def compare_models(results: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Model results (with an ``ordinal``) best first; the earlier model wins a tie."""
    return results.orderBy(F.desc(metric), "ordinal")


def pick_capped(results: DataFrame, cap: float = 0.81, metric: str = "accuracy") -> DataFrame:
    """The best result below ``cap``; the first model where none is below."""
    value = F.col(metric)
    return results.orderBy(F.desc(F.when(value < cap, value).otherwise(-1.0)), "ordinal").limit(1)
