"""Rule boundaries, coercion of dirty records, decision texts."""

import pytest
from pyspark.sql import functions as F

from txnrisk.functions import fusion, reasons, rules

# amount, age, kyc, hour, weekend, score, rules hit, label at ml .05 / .50 / .85
CASES = [
    (332994.59, 2479, 0, 0, False, 0.60, ["high_amount_no_kyc", "multi_factor"], "Suspicious Fraud Fraud"),
    (500000.0, 400, 1, 12, False, 0.0, [], "Legit Suspicious Fraud"),
    (500000.01, 400, 1, 12, False, 0.45, ["very_high_amount"], "Legit Fraud Fraud"),
    (100000.0, 5, 0, 12, False, 0.30, ["very_new_account"], "Legit Suspicious Fraud"),
    (60000.0, 6, 1, 12, False, 0.30, ["very_new_account"], "Legit Suspicious Fraud"),
    (60000.0, 7, 1, 12, False, 0.0, [], "Legit Suspicious Fraud"),
    (250000.0, 29, 0, 3, True, 1.0, ["high_amount_no_kyc", "odd_hour", "new_account_high", "weekend_high", "multi_factor"], "Suspicious Fraud Fraud"),
    (600000.0, 3, 0, 3, True, 1.0, ["very_high_amount", "odd_hour", "new_account_high", "weekend_high", "multi_factor"], "Suspicious Fraud Fraud"),
    (0.0, 0, 0, None, False, 0.0, [], "Legit Suspicious Fraud"),
    (25000.0, 400, 1, 2, False, 0.0, [], "Legit Suspicious Fraud"),
    (25000.5, 400, 1, 5, False, 0.30, ["odd_hour"], "Legit Suspicious Fraud"),
    (50000.0, 1, 0, 23, False, 0.25, ["multi_factor"], "Legit Suspicious Fraud"),
]


def record(amount, age, kyc, hour, weekend):
    when = None if hour is None else f"2025-01-{4 if weekend else 1:02d} {hour:02d}:00:00"
    return (str(amount), str(age), "1", str(kyc), when)


SCHEMA = "transaction_amount string, account_age_days string, channel string, kyc_verified string, timestamp string"


def test_rule_boundaries(spark):
    df = spark.createDataFrame([(i, *record(*c[:5])) for i, c in enumerate(CASES)], f"i int, {SCHEMA}")
    got = (rules.apply_rules(df).withColumn("hit", rules.rules_hit())
           .withColumn("ml_prob", F.explode(F.array(F.lit(0.05), F.lit(0.5), F.lit(0.85)))))
    rows = fusion.with_decision(got).orderBy("i", "ml_prob").collect()
    for i, case in enumerate(CASES):
        mine = rows[3 * i:3 * i + 3]
        assert mine[0]["rule_score"] == pytest.approx(case[5], abs=1e-12), case
        assert mine[0]["hit"] == case[6]
        assert len(mine[0]["reasons"]) == len(case[6])
        assert [r["final_label"] for r in mine] == case[7].split()


def test_score_adds_in_rule_order(spark):
    df = spark.createDataFrame([record(250000.0, 400, 0, 3, False)], SCHEMA)
    assert rules.apply_rules(df).first()["rule_score"] == 0.35 + 0.30 + 0.25


def test_reason_texts(spark):
    df = spark.createDataFrame([record(250000.5, 29, 0, 3, True)], SCHEMA)
    assert rules.apply_rules(df).first()["reasons"] == [
        "High-value transaction (₹250,000) without KYC verification",
        "Large transaction (₹250,000) during suspicious hours (3:00)",
        "Very new account (29 days old) with high transaction (₹250,000)",
        "Weekend transaction with high amount (₹250,000)",
        "Multiple risk factors present (4 indicators)",
    ]


DIRTY = [("1,000", "5", "1", "Yes", "2025-01-01"), ("abc", "5", "1", "1", None), ("600000", "12.5", "9", " yes ", "garbage"),
         ("nan", None, None, None, "2025-13-01"), ("", "3", "1", "true", ""), ("7e5", "3", "1", "1.7", "2025-01-04 03:00")]


def test_dirty_records_read_as_zero(spark):
    df = spark.createDataFrame(DIRTY, SCHEMA)
    got = rules.with_rule_inputs(df).select("rule_amount", "rule_age", "rule_channel", "rule_kyc", "rule_hour", "rule_weekend").collect()
    assert [tuple(r) for r in got] == [
        (0.0, 5, 1, 1, 0, False), (0.0, 5, 1, 1, None, False), (600000.0, 0, 9, 1, None, False),
        (0.0, 0, 0, 0, None, False), (0.0, 3, 1, 1, None, False), (700000.0, 3, 1, 1, 3, True)]


def test_strict_fails_the_record(spark):
    got = rules.apply_rules(spark.createDataFrame(DIRTY, SCHEMA), strict=True).collect()
    failed = [r["reasons"] == [rules.RULES_FAILED] and r["rule_score"] == 0.0 for r in got]
    assert failed == [True, True, True, False, False, True]


def test_missing_fields_count_as_zero(spark):
    got = rules.apply_rules(spark.createDataFrame([("600000",)], "transaction_amount string"), strict=True).first()
    assert got["rule_score"] == 1.0 and len(got["reasons"]) == 3


def test_explanations(spark):
    df = spark.createDataFrame([
        ("Fraud", 0.85, 0.9, 0.8, ["a", "b", "c"]), ("Fraud", 0.5, 0.8, 0.1, []), ("Suspicious", 0.285, 0.5, 0.1, ["x"]),
        ("Legit", 0.1, 0.05, 0.05, []), ("Legit", 0.3, 0.4, 0.0, [])],
        "l string, risk double, ml double, rule double, reasons array<string>")
    got = df.select(fusion.explain(F.col("l"), F.col("risk"), F.col("reasons")).alias("e"),
                    fusion.message(F.col("l"), F.col("ml"), F.col("rule"), F.col("reasons")).alias("m"),
                    fusion.alert_reason(F.col("reasons")).alias("a")).collect()
    assert got[0]["e"] == ("This transaction shows very high risk of fraud (Risk Score: 85%). Key concerns: a; b Action: "
                           "Immediate verification required. Block transaction and contact customer.")
    assert got[1]["e"] == ("This transaction shows moderate risk of fraud (Risk Score: 50%). Action: "
                           "Additional verification recommended before approval.")
    assert got[2]["e"].startswith("This transaction shows mixed signals (Risk Score: 28%).")
    assert got[3]["e"].startswith("This transaction appears safe with very low risk indicators (Risk Score: 10%).")
    assert got[4]["e"].startswith("This transaction is classified as legitimate")
    assert [r["m"] for r in got] == [fusion.MSG_FRAUD + "a; b; c", fusion.MSG_FRAUD_MODEL, fusion.MSG_SUSPICIOUS + "x",
                                    fusion.MSG_SAFE, fusion.MSG_LOW]
    assert [r["a"] for r in got] == ["a; b; c", "ML Model Detection", "x", "ML Model Detection", "ML Model Detection"]


def test_long_alert_reason_is_whole(spark):
    df = spark.createDataFrame([(["y" * 400, "z" * 400],)], "reasons array<string>")
    assert df.select(fusion.alert_reason(F.col("reasons"))).first()[0] == "y" * 400 + "; " + "z" * 400


def test_low_tuned_threshold_gives_low_alert(spark):
    df = spark.createDataFrame([(0.10, 0.60, ["r"])], "ml_prob double, rule_score double, reasons array<string>")
    row = fusion.with_decision(df, threshold=0.05).first()
    assert (row["risk_score"], row["final_label"]) == (0.20, "Fraud")


def test_facts_from_reasons(spark):
    texts = [["Large transaction (₹30,001) during suspicious hours (3:00)", "Weekend transaction with high amount (₹250,000)"],
             ["Very new account (12 days old) with high transaction (₹1,234.50)"], ["no kyc here"], [], ["₹,"]]
    df = spark.createDataFrame([(t,) for t in texts], "r array<string>")
    r = F.col("r")
    got = df.select(reasons.amount_from_reasons(r, 7.0), reasons.age_from_reasons(r, 9), reasons.kyc_from_reasons(r),
                    reasons.when_from_reasons(r)).collect()
    assert [tuple(g) for g in got] == [
        (30001.0, 9, "Yes", "During the weekend, around 3:00"), (1234.5, 12, "Yes", "N/A"),
        (7.0, 9, "No", "N/A"), (7.0, 9, "Yes", "N/A"), (7.0, 9, "Yes", "N/A")]


def test_prompt_falls_back_to_reasons(spark):
    df = spark.createDataFrame([("0", None, "9", "1", "", ["Very new account (12 days old) with high transaction (₹123,456)"]),
                                ("bad", "x", None, "No", "soon", [])],
                               "a string, age string, c string, k string, t string, r array<string>")
    prompt = reasons.explanation_prompt(F.col("a"), F.col("age"), F.col("c"), F.col("k"), F.col("t"), F.lit("Fraud"), F.lit(0.5),
                                        F.lit(0.25), F.lit(0.4), F.lit("General Suspicion"), F.col("r"))
    first, second = [r[0] for r in df.select(prompt).collect()]
    for piece in ("Amount: ₹123,456.00\n", "Account Age: 12 days", "Channel: Mobile", "KYC Verified: Yes", "Timestamp: N/A",
                  "Risk Score: 50.0%", "ML Confidence: 25.0%", "Rule Engine Score: 40.0%"):
        assert piece in first
    for piece in ("Amount: ₹0.00\n", "Account Age: 0 days", "KYC Verified: No", "Timestamp: soon", "Risk Factors: None detected"):
        assert piece in second
