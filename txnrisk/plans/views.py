"""Two transaction views derived from the given tables, and what scoring makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk.functions import cleaning, fusion, rules
from txnrisk.session import use_utc

RAW_FIELDS = ["transaction_id", "customer_id", "transaction_amount", "account_age_days", "channel",
              "kyc_verified", "timestamp", "transaction_type", "location", "currency"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _transactions(df: DataFrame, key: str, customer: str, amount: Column, when: Column) -> DataFrame:
    tid = F.col(key)
    prob = ((tid * 7919) % 10007) / F.lit(10007.0)
    luck = ((tid * 104729) % 1000) / F.lit(1000.0)
    return df.select(
        tid.alias("transaction_id"), F.col(customer).alias("customer_id"),
        # Cents, rounded half up in plain double arithmetic, which every engine computes alike.
        (F.floor(amount * 100 + F.lit(0.5)) / 100).alias("transaction_amount"),
        ((tid * 11) % 397).cast("int").alias("account_age_days"),
        (tid % 4).cast("int").alias("channel"),
        F.when(tid % 5 < 3, "Yes").otherwise("No").alias("kyc_verified"),
        when.cast("timestamp").alias("timestamp"),
        (tid % 4).cast("int").alias("transaction_type"),
        (F.floor(tid / 4) % 5).cast("int").alias("location"),
        (tid % 3).cast("int").alias("currency"),
        prob.alias("ml_prob"),
        (luck < F.lit(0.4) * prob * prob).cast("int").alias("is_fraud"),
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    shifted = F.col("o_orderdate") + F.make_dt_interval(hours=((F.col("o_orderkey") * 7) % 24).cast("int"))
    return _transactions(orders, "o_orderkey", "o_custkey", F.col("o_totalprice") * F.lit(1.5), shifted)


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return _transactions(events, "event_id", "user_id", F.col("value") * F.lit(4000.0), F.col("ts"))


def scored(txns: DataFrame, threshold: float = fusion.THRESHOLD) -> DataFrame:
    """Transactions with rules, decision and the stored-record columns."""
    decided = fusion.with_decision(rules.apply_rules(txns), threshold)
    record = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in RAW_FIELDS]))
    return decided.withColumns({
        "data": record,
        "probability": F.round("ml_prob", 6),
        "user_id": F.col("customer_id") % 7,
        "created_at": F.col("timestamp"),
    })


def label_events(txns: DataFrame) -> DataFrame:
    """Reviewer feedback on every tenth transaction, with a bad label, an unknown id and a wrong owner mixed in."""
    tid, label = F.col("transaction_id"), F.col("is_fraud")
    user = F.col("customer_id") % 7

    def event(seq: int, when: Column, transaction: Column = tid, owner: Column = user, given: Column = label) -> Column:
        return F.when(when, F.struct(transaction.alias("transaction_id"), owner.alias("user_id"), given.alias("label"), F.lit(seq).alias("seq")))

    fiftieth = tid % 50 == 0
    events = F.array(event(1, F.lit(True)), event(2, fiftieth, given=F.lit(2)), event(3, fiftieth, transaction=-1 - tid),
                     event(4, fiftieth, owner=user + 1), event(5, tid % 30 == 0, given=1 - label))
    # One scan, whatever the number of events a transaction gets.
    return txns.filter(tid % 10 == 0).select(F.inline(F.array_compact(events)))
