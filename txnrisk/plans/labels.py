"""Reviewer feedback on scored transactions, and the metrics it allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions.cleaning import known
from txnrisk.operators import metrics
from txnrisk.operators.ranks import running_sums


def label_status(txns: DataFrame, events: DataFrame) -> DataFrame:
    """Each label event with the outcome it gets: 400 bad label, 404 unknown id, 403 other owner, else 200.

    Events of one transaction may be many; adaptive execution splits such partitions of the join.
    """
    owners = txns.select("transaction_id", F.col("user_id").alias("owner"))
    status = (F.when(F.col("label").isNull() | ~F.col("label").isin(0, 1), 400)
              .when(F.col("owner").isNull(), 404)
              .when(~F.col("owner").eqNullSafe(F.col("user_id")), 403).otherwise(200))
    return events.join(owners, "transaction_id", "left").withColumn("status", status).drop("owner")


def apply_labels(txns: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """Transactions with ``actual_label``: the last accepted label by ``order``, null where there is none.

    Labels are an append-only table; the latest one wins when it is read. Accepted events collapse
    to one row per transaction before the join (an owner check needs no join of its own: it rides
    in the grouping key).
    """
    latest = (events.filter(F.col("label").isin(0, 1)).groupBy("transaction_id", "user_id")
              .agg(F.max_by("label", order).alias("actual_label")))
    return txns.drop("actual_label").join(latest, ["transaction_id", "user_id"], "left")


def labelled_metrics(txns: DataFrame, user_id: int) -> DataFrame:
    """Quality of the stored predictions of one user, as one row.

    Against reviewer labels where the user has any (``real``); else against the predictions
    themselves (``self_consistency``, whose accuracy is always 1); ``none`` without transactions.
    """
    mine = txns.filter(F.col("user_id") == user_id).select("predicted", "probability", "actual_label")
    hit = F.col("predicted") == 1
    # Both truths are counted in the same pass; which of them counts is known at its end.
    truths = {"real": F.col("actual_label"), "self": F.when(hit, 1).otherwise(0)}

    def counts(name: str, truth: Column) -> list[Column]:
        true = truth == 1
        return [F.count(truth).alias(f"n_{name}"), F.count_if(hit & true).alias(f"tp_{name}"), F.count_if(~hit & ~true).alias(f"tn_{name}"),
                F.count_if(hit & ~true).alias(f"fp_{name}"), F.count_if(~hit & true).alias(f"fn_{name}")]

    one = mine.agg(*[c for name, truth in truths.items() for c in counts(name, truth)])
    threshold = known(F.col("probability"))
    sides = {f"{side}_{name}": F.count_if((truth == 1) if side == "pos" else (truth == 0)) for name, truth in truths.items() for side in ("pos", "neg")}
    per_score = mine.groupBy(threshold.alias("threshold")).agg(*[c.alias(name) for name, c in sides.items()]).filter("threshold IS NOT NULL")
    upto = running_sums(per_score, "threshold", {f"pos_{name}": f"upto_{name}" for name in truths}, descending=True)
    areas = upto.agg(*[metrics.auc(F.col(f"pos_{name}"), F.col(f"neg_{name}"), F.col(f"upto_{name}")).alias(f"auc_{name}") for name in truths])
    real = F.col("n_real") > 0
    found = areas.select(F.struct(*[f"auc_{name}" for name in truths])).scalar()
    both = one.withColumn("areas", found).select("*", "areas.*")
    chosen = both.select(real.alias("real"), *[F.when(real, F.col(f"{c}_real")).otherwise(F.col(f"{c}_self")).alias(c) for c in ("n", "tp", "tn", "fp", "fn", "auc")])
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    said = F.when(F.col("real"), " reviewed transactions").otherwise(" total transactions (self-consistency check)")
    return chosen.select(
        F.round(metrics.ratio(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"), F.round(metrics.ratio(tp, tp + fp), 4).alias("precision"),
        F.round(metrics.ratio(tp, tp + fn), 4).alias("recall"), F.round(metrics.ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1_score"),
        tp.alias("true_positives"), tn.alias("true_negatives"), fp.alias("false_positives"), fn.alias("false_negatives"),
        F.round(F.coalesce("auc", F.lit(0.0)), 4).alias("auc"), F.when(F.col("real"), n).otherwise(F.lit(0).cast("long")).alias("labeled_count"),
        F.when(n == 0, "none").when(F.col("real"), "real").otherwise("self_consistency").alias("metrics_type"),
        F.when(n == 0, "No transactions available yet").otherwise(F.concat(F.lit("Based on "), n.cast("string"), said)).alias("message"))
