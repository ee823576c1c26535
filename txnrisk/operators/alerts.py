"""Alert rows from scored transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.functions import fusion


def build_alerts(scored: DataFrame) -> DataFrame:
    """One alert per transaction labelled Fraud; alert_id is the transaction's own key. Where the scored rows have a
    ``stored_id``, the alert carries it: a transaction may be scored more than once."""
    stored = ["stored_id"] if "stored_id" in scored.columns else []
    return scored.filter(F.col("final_label") == "Fraud").select(
        F.col("transaction_id").alias("alert_id"), "transaction_id", "customer_id", "risk_score",
        fusion.alert_reason(F.col("reasons")).alias("reason"), "ml_prob", "rule_score", "created_at", *stored)
