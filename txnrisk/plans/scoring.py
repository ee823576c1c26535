"""Score raw transactions with a fitted bundle: the same plan for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from txnrisk.functions import fusion, rules
from txnrisk.sources.bundle import Bundle


def score(df: DataFrame, bundle: Bundle, strict: bool = False, alert: float = fusion.ALERT_RISK,
          weight: float = fusion.MODEL_WEIGHT) -> DataFrame:
    """Raw transactions with model probability, rules and decision. All stateless column expressions."""
    ruled = rules.apply_rules(bundle.transform(df), strict)
    return fusion.with_decision(ruled, bundle.threshold, alert, weight)
