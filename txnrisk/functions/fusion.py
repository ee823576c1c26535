"""Combine model probability and rule score into one explained decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.session import computed_once

# Model weight, alert cut-off, default decision threshold, rule cut-off.
MODEL_WEIGHT = 0.6
ALERT_RISK = 0.45
THRESHOLD = 0.5
RULE_FRAUD = 0.6

# Message, explanation and alert texts.
MSG_FRAUD = "🚨 High risk detected: "
MSG_FRAUD_MODEL = "🤖 ML model detected high fraud probability"
MSG_FRAUD_PLAIN = "⚠️ Suspicious activity detected"
MSG_SUSPICIOUS = "⚠️ Suspicious - requires review: "
MSG_NO_REASON = "Pattern anomaly detected"
MSG_SAFE = "✅ Transaction appears safe"
MSG_LEGIT = "✓ Transaction appears legitimate"
MSG_LOW = "ℹ️ Low risk - monitor if unusual"
SEVERITY = ["very high risk", "high risk", "moderate risk"]
ACTION = [
    "Immediate verification required. Block transaction and contact customer.",
    "Manual review recommended. Verify with customer before processing.",
    "Additional verification recommended before approval.",
]
EXPLAIN_SUSPICIOUS = (
    "This transaction shows mixed signals (Risk Score: ",
    "%). Some risk indicators present but not conclusive. Recommend monitoring customer activity and "
    "consider additional verification for high-value transactions.",
)
EXPLAIN_SAFE = (
    "This transaction appears safe with very low risk indicators (Risk Score: ",
    "%). Customer profile and transaction pattern are normal. Proceed with standard processing.",
)
EXPLAIN_MINOR = (
    "This transaction is classified as legitimate but shows some minor risk indicators (Risk Score: ",
    "%). Continue monitoring but no immediate action required.",
)
ALERT_WITHOUT_REASON = "ML Model Detection"


def extreme(ml: Column) -> Column:
    """True where the model is so sure that it gets weight 0.8."""
    return (ml > 0.8) | (ml < 0.2)


def fuse_risk(ml: Column, rule: Column, weight: float = MODEL_WEIGHT) -> Column:
    sure = F.lit(0.8) * ml + F.lit(0.2) * rule
    mixed = F.lit(weight) * ml + F.lit(1.0 - weight) * rule
    return F.round(F.when(extreme(ml), sure).otherwise(mixed), 4)


def final_label(ml: Column, rule: Column, risk: Column,
                threshold: float = THRESHOLD, alert: float = ALERT_RISK) -> Column:
    by_model, by_rule = ml >= threshold, rule >= RULE_FRAUD
    return (F.when((risk >= alert) | (by_model & by_rule), "Fraud")
            .when(by_model | by_rule, "Suspicious").otherwise("Legit"))


def confidence(label: Column) -> Column:
    return F.when(label == "Fraud", "High").when(label == "Suspicious", "Medium").otherwise("Low")


def confidence_level(risk: Column) -> Column:
    return F.when(risk >= 0.8, "Very High").when(risk >= 0.6, "High").when(risk >= 0.4, "Medium").otherwise("Low")


def category(ml: Column, rule: Column, reasons: Column) -> Column:
    def mentions(*words: str) -> Column:
        return F.exists(reasons, lambda r: F.lower(r).rlike("|".join(words)))

    return (F.when((rule > 0.7) & (ml < 0.3), "Rule-Based Fraud")
            .when((ml > 0.7) & (rule < 0.3), "ML-Detected Anomaly")
            .when((ml > 0.5) & (rule > 0.5), "High-Confidence Fraud")
            .when(mentions("amount"), "Amount-Related Suspicion")
            .when(mentions("kyc"), "Verification Issue")
            .when(mentions("hour", "weekend"), "Timing Anomaly")
            .when(mentions("account"), "New Account Risk")
            .otherwise("General Suspicion"))


def message(label: Column, ml: Column, rule: Column, reasons: Column) -> Column:
    some, joined = F.size(reasons) > 0, F.array_join(reasons, "; ")
    fraud = (F.when(some, F.concat(F.lit(MSG_FRAUD), joined))
             .when(ml >= 0.75, MSG_FRAUD_MODEL).otherwise(MSG_FRAUD_PLAIN))
    review = F.concat(F.lit(MSG_SUSPICIOUS), F.when(some, joined).otherwise(MSG_NO_REASON))
    legit = (F.when((ml < 0.1) & (rule < 0.1), MSG_SAFE).when(ml < 0.3, MSG_LEGIT).otherwise(MSG_LOW))
    return F.when(label == "Fraud", fraud).when(label == "Suspicious", review).otherwise(legit)


def explain(label: Column, risk: Column, reasons: Column) -> Column:
    """One paragraph per decision: severity, the first two reasons, the action to take."""
    percent = F.format_number(risk * 100, 0)

    def by_risk(texts: list[str]) -> Column:
        return F.when(risk >= 0.8, texts[0]).when(risk >= 0.6, texts[1]).otherwise(texts[2])

    def around(texts: tuple[str, str]) -> Column:
        return F.concat(F.lit(texts[0]), percent, F.lit(texts[1]))

    concerns = F.when(F.size(reasons) > 0,
                      F.concat(F.lit(" Key concerns: "), F.array_join(F.slice(reasons, 1, 2), "; "))).otherwise("")
    fraud = F.concat(F.lit("This transaction shows "), by_risk(SEVERITY), F.lit(" of fraud (Risk Score: "),
                     percent, F.lit("%)."), concerns, F.lit(" Action: "), by_risk(ACTION))
    return (F.when(label == "Fraud", fraud)
            .when(label == "Suspicious", around(EXPLAIN_SUSPICIOUS))
            .when(risk < 0.2, around(EXPLAIN_SAFE)).otherwise(around(EXPLAIN_MINOR)))


def breakdown(ml: Column, rule: Column, weight: float = MODEL_WEIGHT) -> Column:
    """Nominal contributions; they ignore the 0.8 / 0.2 weights an extreme probability gets."""
    return F.struct(F.round(F.lit(weight) * ml, 4).alias("ml_contribution"),
                    F.round(F.lit(1.0 - weight) * rule, 4).alias("rules_contribution"))


def effective_breakdown(ml: Column, rule: Column, weight: float = MODEL_WEIGHT) -> Column:
    """Contributions with the weights that were really used."""
    model_weight = F.when(extreme(ml), 0.8).otherwise(weight)
    rule_weight = F.when(extreme(ml), 0.2).otherwise(1.0 - weight)
    return F.struct(F.round(model_weight * ml, 4).alias("ml_contribution"),
                    F.round(rule_weight * rule, 4).alias("rules_contribution"))


def alert_reason(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(ALERT_WITHOUT_REASON)


def with_decision(df: DataFrame, threshold: float = THRESHOLD, alert: float = ALERT_RISK,
                  weight: float = MODEL_WEIGHT) -> DataFrame:
    """Add ``risk_score``, ``predicted``, ``final_label`` and ``confidence`` to a frame that has
    ``ml_prob``, ``rule_score`` and ``reasons``."""
    ml, rule, risk, label = F.col("ml_prob"), F.col("rule_score"), F.col("risk_score"), F.col("final_label")
    fused = df.withColumn("risk_score", fuse_risk(ml, rule, weight))
    decided = computed_once(fused, {"predicted": (ml >= threshold).cast("int"),
                                    "final_label": final_label(ml, rule, risk, threshold, alert)})
    return decided.withColumn("confidence", confidence(label))


def score_result(df: DataFrame, weight: float = MODEL_WEIGHT, digits: int | None = None) -> DataFrame:
    """The full nested answer per transaction, from a frame that went through ``with_decision``."""
    ml, rule, risk = F.col("ml_prob"), F.col("rule_score"), F.col("risk_score")
    label, reasons = F.col("final_label"), F.col("reasons")
    stored_id = F.col("db_transaction_id") if "db_transaction_id" in df.columns else F.col("transaction_id")
    shown_id = F.coalesce(F.col("transaction_id").cast("string"), F.concat(F.lit("tx_"), stored_id.cast("string")))
    return df.select(
        shown_id.alias("transaction_id"), stored_id.alias("db_transaction_id"), label.alias("prediction"),
        risk, (ml if digits is None else F.round(ml, digits)).alias("ml_probability"), rule,
        confidence(label).alias("confidence"), confidence_level(risk).alias("confidence_level"),
        category(ml, rule, reasons).alias("category"), reasons,
        message(label, ml, rule, reasons).alias("message"), explain(label, risk, reasons).alias("explanation"),
        breakdown(ml, rule, weight).alias("breakdown"),
    )


def simple_result(df: DataFrame, digits: int = 4) -> DataFrame:
    """The short answer: 0/1 prediction and rounded probability."""
    return df.select("transaction_id", F.col("predicted").alias("prediction"),
                     F.round("ml_prob", digits).alias("probability"))
