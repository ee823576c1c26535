"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk.functions import cleaning, fusion, reasons, rules
from txnrisk.operators import alerts, clean, encode, features, metrics, models, profile, scaling, split
from txnrisk.operators.history import refit, summarize
from txnrisk.operators.smote import smote
from txnrisk.plans import analytics, labels, training, views
from txnrisk.plans.scoring import score
from txnrisk.plans.views import read_table, txn_events, txn_orders
from txnrisk.session import cut_lineage
from txnrisk.sources.records import parse_record
from txnrisk.sources.sinks import transaction_rows
from txnrisk.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(col: str | Column, digits: int = 6, name: str | None = None) -> Column:
    return F.round(col, digits).alias(name or col)


# Spellings of a time other than the usual one.
OTHER_TIMES = ["2025/01/02 03:04", "01/02/2025 03:04:00", "Jan 2 2025 03:00", "2025-01-01T03:00:00+05:30"]


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders view as text, with unusable values mixed in."""
    t, tid = txn_orders(spark, sf_dir), F.col("transaction_id")

    def mixed(column: str | Column, modulus: int, bad: list[str | None]) -> Column:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        out = F.when(tid % modulus == 0, F.lit(bad[0]))
        for i, value in enumerate(bad[1:], 1):
            out = out.when(tid % modulus == i, F.lit(value).cast("string"))
        return out.otherwise(text)

    return t.select(
        "transaction_id", "customer_id", "ml_prob", "is_fraud",
        mixed("transaction_amount", 11, ["1,000", "abc", "", "nan", None]).alias("transaction_amount"),
        mixed("account_age_days", 13, ["12.5", None, "old", "3000000000"]).alias("account_age_days"),
        mixed("channel", 7, ["9", None, "web"]).alias("channel"),
        mixed("kyc_verified", 11, [" yes ", "1", "true", "1.7", "N", None, "1.0", "2"]).alias("kyc_verified"),
        mixed(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), 17, ["garbage", "2025-13-01", None, *OTHER_TIMES]).alias("timestamp"))


def skewed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders view with every fortieth amount ten times as large, so that there are outliers."""
    amount = F.col("transaction_amount")
    return txn_orders(spark, sf_dir).withColumn(
        "transaction_amount", F.when(F.col("transaction_id") % 40 == 0, amount * 10).otherwise(amount))


def with_repeats(df: DataFrame) -> DataFrame:
    return df.unionByName(df.filter(F.col("transaction_id") % 10 == 0))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(txn_orders(spark, sf_dir))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(txn_events(spark, sf_dir))


def alerts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.build_alerts(scored_orders(spark, sf_dir))


def alerts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.build_alerts(scored_events(spark, sf_dir))


def predicted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_orders(spark, sf_dir).withColumn("predicted", metrics.apply_threshold(F.col("ml_prob")))


# ---- Profiles

@query
def shape_and_columns(spark, sf):
    return profile.shape_and_columns(txn_orders(spark, sf))


@query
def head_rows(spark, sf):
    return profile.head(txn_orders(spark, sf).select(
        "transaction_id", "customer_id", "transaction_amount", "kyc_verified"), "transaction_id")


@query
def describe(spark, sf):
    got = profile.describe(txn_orders(spark, sf), ["transaction_amount", "account_age_days", "channel", "ml_prob"])
    return got.select("column", "count", r("mean"), r("std"), "min", r("q25"), r("q50"), r("q75"), "max")


@query
def null_counts(spark, sf):
    return profile.null_counts(dirty_orders(spark, sf).select(
        "transaction_id", "transaction_amount", "account_age_days", "channel", "kyc_verified", "timestamp"))


@query
def duplicate_count(spark, sf):
    return profile.duplicate_count(with_repeats(txn_orders(spark, sf)))


@query
def class_balance(spark, sf):
    return profile.class_balance(txn_orders(spark, sf), normalize=True).select("is_fraud", "count", r("ratio"))


@query
def count_by_category(spark, sf):
    return profile.count_by_columns(txn_orders(spark, sf), ["channel", "kyc_verified", "transaction_type", "location", "currency"])


@query
def count_by_hour(spark, sf):
    return profile.count_by_hour(txn_orders(spark, sf))


@query
def box_stats(spark, sf):
    got = profile.box_stats(txn_orders(spark, sf), ["transaction_amount", "account_age_days"])
    return got.select("column", "is_fraud", r("q1"), r("median"), r("q3"), "whisker_low", "whisker_high", "outliers")


@query
def histogram(spark, sf):
    return profile.histogram(txn_orders(spark, sf), "transaction_amount").select("bin", r("lower", 4), r("upper", 4), "count")


@query
def correlation(spark, sf):
    got = profile.correlation(txn_orders(spark, sf), ["transaction_amount", "account_age_days", "ml_prob", "is_fraud"])
    return got.select("a", "b", r("corr"))


# ---- Cleaning

@query
def rename_amount(spark, sf):
    return clean.rename_amount(dirty_orders(spark, sf)).select("transaction_id", "amount")


@query
def drop_ids(spark, sf):
    kept = clean.drop_ids(txn_orders(spark, sf).drop("ml_prob", "transaction_type", "location", "currency"))
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


@query
def drop_duplicates(spark, sf):
    return clean.drop_duplicates(with_repeats(txn_orders(spark, sf)).select(
        "transaction_id", "customer_id", "transaction_amount", "kyc_verified", "is_fraud"))


@query
def outlier_bounds(spark, sf):
    return clean.outlier_bounds(skewed_orders(spark, sf), "transaction_amount").select(r("lower"), r("upper"), "outliers")


@query
def refit_quantiles(spark, sf):
    """Each year of the skewed orders is summarized on its own, the last one later than the others; the quantiles of all years are
    found from the summaries and the values near the wanted ranks."""
    t = skewed_orders(spark, sf).withColumn("year", F.year("timestamp"))
    columns, probs = ["transaction_amount", "account_age_days", "ml_prob"], [0.25, 0.5, 0.75, features.HIGH_QUANTILE]
    last = t.agg(F.max("year")).first()[0]
    before = summarize(t.filter(F.col("year") < last), columns, "year")
    summaries = cut_lineage(before.unionByName(summarize(t.filter(F.col("year") == last), columns, "year")))
    rows = [(c, n, *q) for c, (n, q) in refit(t, summaries, columns, probs, "year").items()]
    names = ["q25", "q50", "q75", "q95"]
    found = spark.createDataFrame(rows, "column string, n long, " + ", ".join(f"{q} double" for q in names))
    return found.select("column", "n", *[r(q) for q in names])


@query
def outliers(spark, sf):
    return clean.outliers(skewed_orders(spark, sf), "transaction_amount").select("transaction_id", "transaction_amount")


@query
def winsorize(spark, sf):
    return clean.winsorize(skewed_orders(spark, sf), "transaction_amount").select("transaction_id", r("transaction_amount"))


@query
def parse_timestamp(spark, sf):
    return clean.parse_timestamp(dirty_orders(spark, sf)).select(
        "transaction_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query
def kyc_flag(spark, sf):
    kyc = F.col("kyc_verified")
    return dirty_orders(spark, sf).select(
        "transaction_id", cleaning.kyc_flag(kyc).alias("any_case"), cleaning.kyc_flag(kyc, "title").alias("title"),
        cleaning.kyc_flag(kyc, "lower").alias("lower"), cleaning.kyc_flag(kyc, "numeric").alias("numeric"))


@query
def fill_missing(spark, sf):
    numbers = dirty_orders(spark, sf).select(
        "transaction_id", cleaning.to_double(F.col("transaction_amount")).alias("amount"),
        F.col("account_age_days").try_cast("long").alias("account_age_days"))
    return clean.fill_missing(numbers)


@query
def align_features(spark, sf):
    return clean.align_features(txn_orders(spark, sf), ["ml_prob", "velocity_check", "channel", "transaction_amount"], ["transaction_id"])


@query
def channel_name(spark, sf):
    code = F.col("channel")
    return dirty_orders(spark, sf).select("transaction_id", cleaning.channel_name(code).alias("scoring_name"),
                                          cleaning.channel_name(code, "Unknown").alias("analytics_name"))


# ---- Features

@query
def time_features(spark, sf):
    return features.time_features(dirty_orders(spark, sf)).select(
        "transaction_id", "hour", "day", "day_of_week", "month", "is_weekend", "is_night")


@query
def log_amount(spark, sf):
    amount = cleaning.number_or_zero(F.col("transaction_amount"))
    return dirty_orders(spark, sf).select("transaction_id", r(features.log_amount(amount), 6, "log_amount"))


@query
def high_amount(spark, sf):
    t = features.time_features(txn_orders(spark, sf))
    flagged = features.high_amount_night(features.high_amount(t, "transaction_amount"))
    return flagged.select("transaction_id", "high_amount", "high_amount_night")


@query
def customer_stats(spark, sf):
    return features.customer_stats(txn_orders(spark, sf)).withColumn("cust_avg_amount", r("cust_avg_amount"))


@query
def join_customer_stats(spark, sf):
    t = txn_orders(spark, sf)
    return features.join_customer_stats(t.select("transaction_id", "customer_id"), features.customer_stats(t).drop("cust_avg_amount"))


@query
def velocity_24h(spark, sf):
    t = txn_events(spark, sf).select("transaction_id", "customer_id", "timestamp")
    return features.velocity_24h(t).select("transaction_id", "txn_last_24h")


@query
def velocity_carried(spark, sf):
    """The same in runs of ten days, each of which reads its own events and the boundary of the run before."""
    t = txn_events(spark, sf).select("transaction_id", "customer_id", "timestamp")
    first, last = t.agg(F.min("timestamp"), F.max("timestamp")).first()
    start, parts, carried = first, [], None
    while start <= last:
        end = start + datetime.timedelta(days=10)
        run = t.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))
        parts.append(features.velocity_24h(run, carried).select("transaction_id", "txn_last_24h"))
        carried, start = cut_lineage(features.velocity_boundary(run, F.lit(end), carried)), end
    return reduce(DataFrame.unionByName, parts)


@query
def sparse_one_hot(spark, sf):
    """Places of the dummies of a category with a level per customer and of one with few, and the length of the whole vector."""
    t = txn_orders(spark, sf).select("transaction_id", "customer_id", "channel")
    table = encode.level_table(t, ["customer_id", "channel"])
    counts = encode.level_counts(table)
    made = encode.encode_levels(t, table, counts)
    return made.withColumn("size", F.lit(encode.vector_size([], counts)))


@query
def one_hot(spark, sf):
    return features.one_hot(txn_orders(spark, sf).select("transaction_id", "kyc_verified", "channel"), ["kyc_verified", "channel"])


@query
def chi2_scores(spark, sf):
    return features.chi2_scores(txn_orders(spark, sf), ["kyc_verified", "channel"]).select("feature", r("score"))


_SCALE = ["transaction_amount", "account_age_days", "channel"]


@query
def robust_scale(spark, sf):
    t = txn_orders(spark, sf).select("transaction_id", *_SCALE)
    return scaling.robust_scale(t, _SCALE).select("transaction_id", *[r(c) for c in _SCALE])


@query
def standard_scale(spark, sf):
    t = txn_orders(spark, sf).select("transaction_id", *_SCALE)
    return scaling.standard_scale(t, _SCALE).select("transaction_id", *[r(c) for c in _SCALE])


# ---- Split and metrics

@query
def stratified_split(spark, sf):
    train, test = split.stratified_split(txn_orders(spark, sf).select("transaction_id", "is_fraud"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def split_shares(spark, sf):
    chosen = split.is_test(F.col("transaction_id"), 0.2)
    return txn_orders(spark, sf).groupBy("is_fraud").agg(F.count("*").alias("n"), F.count_if(chosen).alias("test_rows"))


@query
def class_weights(spark, sf):
    return split.class_weights(txn_orders(spark, sf)).withColumn("weight", r("weight"))


@query
def pr_curve(spark, sf):
    return metrics.pr_curve(txn_orders(spark, sf)).select(r("threshold", 9), r("precision"), r("recall"), "tp", "fp")


@query
def average_precision(spark, sf):
    return metrics.average_precision(txn_orders(spark, sf)).select(r("average_precision"))


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(txn_orders(spark, sf)).select(r("roc_auc"))


@query
def best_threshold(spark, sf):
    return metrics.best_threshold(txn_orders(spark, sf)).select(r("threshold", 9), r("precision"), r("recall"))


@query
def confusion(spark, sf):
    return metrics.confusion(predicted_orders(spark, sf))


@query
def classification_report(spark, sf):
    return metrics.classification_report(predicted_orders(spark, sf)).select(
        "class", r("precision"), r("recall"), r("f1_score"), "support")


@query
def business_impact(spark, sf):
    return metrics.business_impact(predicted_orders(spark, sf)).select(r("fraud_caught_pct"), r("false_alarm_pct"))


@query
def apply_threshold(spark, sf):
    prob = F.col("ml_prob")
    return txn_orders(spark, sf).select("transaction_id", metrics.apply_threshold(prob).alias("at_half"),
                                        metrics.apply_threshold(prob, 0.35).alias("at_tuned"))


@query
def threshold_choice(spark, sf):
    """The capped choice among four cut-offs: the best accuracy that stays below 0.81."""
    t = txn_orders(spark, sf)
    cuts = [0.3, 0.5, 0.7, 0.9]
    right = [F.avg((metrics.apply_threshold(F.col("ml_prob"), c) == F.col("is_fraud")).cast("int")).alias(f"a{i}")
             for i, c in enumerate(cuts)]
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(f"cut {c}").alias("model"), F.col(f"a{i}").alias("accuracy"))
            for i, c in enumerate(cuts)]
    return metrics.pick_capped(t.agg(*right).select(F.inline(F.array(*rows)))).withColumn("accuracy", r("accuracy"))


# ---- Rules, fusion, explanation, alerts

@query
def rule_inputs(spark, sf):
    return rules.with_rule_inputs(dirty_orders(spark, sf)).select(
        "transaction_id", "rule_amount", "rule_age", "rule_channel", "rule_kyc", "rule_hour", "rule_weekend", "rule_inputs_ok")


@query
def rule_hits(spark, sf):
    ready = rules.with_rule_inputs(txn_orders(spark, sf))
    return ready.select("transaction_id", *[hit.cast("int").alias(name) for name, hit in rules.rule_hits().items()],
                        rules.risk_factor_count().alias("factors"))


@query
def rule_score(spark, sf):
    return rules.apply_rules(txn_orders(spark, sf)).select("transaction_id", "rule_score")


def _joined_reasons() -> Column:
    return F.array_join("reasons", " | ").alias("reasons")


@query
def rule_reasons(spark, sf):
    return rules.apply_rules(txn_orders(spark, sf)).select("transaction_id", _joined_reasons())


@query
def rule_summary(spark, sf):
    ready = rules.with_rule_inputs(txn_orders(spark, sf))
    return ready.select(F.explode(rules.rules_hit()).alias("rule")).groupBy("rule").agg(F.count("*").alias("hits"))


@query
def tolerant_rules(spark, sf):
    return rules.apply_rules(dirty_orders(spark, sf)).select("transaction_id", "rule_score", _joined_reasons())


@query
def strict_rules(spark, sf):
    return rules.apply_rules(dirty_orders(spark, sf), strict=True).select("transaction_id", "rule_score", _joined_reasons())


@query
def fuse_risk(spark, sf):
    return scored_orders(spark, sf).select("transaction_id", "risk_score")


@query
def final_label(spark, sf):
    return scored_orders(spark, sf).select("transaction_id", "final_label", "confidence")


@query
def confidence_level(spark, sf):
    return scored_orders(spark, sf).select("transaction_id", fusion.confidence_level(F.col("risk_score")).alias("confidence_level"))


@query
def risk_category(spark, sf):
    category = fusion.category(F.col("ml_prob"), F.col("rule_score"), F.col("reasons"))
    return scored_orders(spark, sf).select("transaction_id", category.alias("category"))


@query
def risk_message(spark, sf):
    text = fusion.message(F.col("final_label"), F.col("ml_prob"), F.col("rule_score"), F.col("reasons"))
    return scored_orders(spark, sf).select("transaction_id", text.alias("message"))


@query
def risk_explanation(spark, sf):
    text = fusion.explain(F.col("final_label"), F.col("risk_score"), F.col("reasons"))
    return scored_orders(spark, sf).select("transaction_id", text.alias("explanation"))


@query
def risk_breakdown(spark, sf):
    ml, rule = F.col("ml_prob"), F.col("rule_score")
    return (scored_orders(spark, sf)
            .select("transaction_id", fusion.breakdown(ml, rule).alias("b"), fusion.effective_breakdown(ml, rule).alias("e"))
            .select("transaction_id", "b.ml_contribution", "b.rules_contribution",
                    F.col("e.ml_contribution").alias("ml_effective"), F.col("e.rules_contribution").alias("rules_effective")))


@query
def score_result(spark, sf):
    got = fusion.score_result(scored_orders(spark, sf), digits=6)
    return got.withColumn("reasons", F.array_join("reasons", "; ")).select("*", "breakdown.*").drop("breakdown")


@query
def simple_result(spark, sf):
    return fusion.simple_result(predicted_orders(spark, sf))


@query
def build_alerts(spark, sf):
    return alerts_orders(spark, sf).drop("created_at").withColumn("ml_prob", r("ml_prob", 9))


@query
def facts_from_reasons(spark, sf):
    texts = F.col("reasons")
    return scored_orders(spark, sf).select(
        "transaction_id", reasons.amount_from_reasons(texts).alias("amount"), reasons.age_from_reasons(texts).alias("age"),
        reasons.kyc_from_reasons(texts).alias("kyc"), reasons.when_from_reasons(texts).alias("happened"))


@query
def explanation_prompt(spark, sf):
    """Every third record goes without its timestamp, to take it from the reasons."""
    c = {name: F.col(name) for name in ("ml_prob", "rule_score", "risk_score", "final_label", "reasons")}
    known_time = F.when(F.col("transaction_id") % 3 != 0, F.col("timestamp"))
    prompt = reasons.explanation_prompt(
        F.col("transaction_amount"), F.col("account_age_days"), F.col("channel"), F.col("kyc_verified"), known_time,
        c["final_label"], c["risk_score"], c["ml_prob"], c["rule_score"],
        fusion.category(c["ml_prob"], c["rule_score"], c["reasons"]), c["reasons"])
    return scored_orders(spark, sf).select("transaction_id", prompt.alias("prompt"))


# ---- Analytics

@query
def top_users(spark, sf):
    a = alerts_events(spark, sf)
    return analytics.top_users(a, analytics.newest(a)).withColumn("avg_risk", r("avg_risk"))


@query
def top_users_month(spark, sf):
    a = alerts_orders(spark, sf)
    return analytics.top_users(a, analytics.newest(a), 30).withColumn("avg_risk", r("avg_risk"))


@query
def fraud_trends(spark, sf):
    a = alerts_events(spark, sf)
    return analytics.fraud_trends(a, analytics.newest(a)).select(F.col("date").cast("string").alias("date"), "count", r("avg_risk"))


@query
def trend_totals(spark, sf):
    a = alerts_events(spark, sf)
    return analytics.trend_totals(analytics.fraud_trends(a, analytics.newest(a))).withColumn("daily_mean", r("daily_mean"))


@query
def risk_distribution(spark, sf):
    return analytics.risk_distribution(alerts_orders(spark, sf))


@query
def system_overview(spark, sf):
    s = scored_orders(spark, sf)
    return analytics.system_overview(s, alerts.build_alerts(s)).withColumn("value", r("value"))


def _rounded_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_risk", r("avg_risk"))


@query
def fraud_by_channel(spark, sf):
    s = scored_orders(spark, sf)
    return _rounded_risk(analytics.fraud_by_channel(alerts.build_alerts(s), s))


@query
def fraud_by_channel_twice(spark, sf):
    """A tenth of the transactions is scored twice; each alert counts for the row that it was raised on."""
    s = scored_orders(spark, sf).withColumn("stored_id", F.col("transaction_id") * 2)
    again = s.filter(F.col("transaction_id") % 10 == 0).withColumn("stored_id", F.col("stored_id") + 1)
    both = s.unionByName(again)
    return _rounded_risk(analytics.fraud_by_channel(alerts.build_alerts(both), both))


@query
def split_null_ids(spark, sf):
    """Rows whose id is missing are split like all others: none is lost."""
    t = txn_orders(spark, sf).withColumn("transaction_id", F.when(F.col("transaction_id") % 3 > 0, F.col("transaction_id")))
    train, test = split.stratified_split(t)
    return train.unionByName(test).groupBy("is_fraud").agg(F.count("*").alias("n"), F.count_if(F.col("transaction_id").isNull()).alias("without_id"))


@query
def class_weights_unlabelled(spark, sf):
    """Weights of the two classes where a fifth of the rows has no label."""
    t = txn_orders(spark, sf).withColumn("is_fraud", F.when(F.col("transaction_id") % 5 > 0, F.col("is_fraud")))
    return split.class_weights(t).withColumn("weight", r("weight"))


@query
def fraud_by_account_age(spark, sf):
    s = scored_orders(spark, sf)
    return _rounded_risk(analytics.fraud_by_account_age(alerts.build_alerts(s), s))


@query
def fraud_by_kyc(spark, sf):
    s = scored_orders(spark, sf)
    return _rounded_risk(analytics.fraud_by_kyc(alerts.build_alerts(s), s))


@query
def fraud_by_customer_segment(spark, sf):
    """Alerts collapse to one row per customer before they meet the customer table."""
    per_customer = alerts_orders(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk"))
    segments = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return (per_customer.join(segments, "customer_id").groupBy("segment")
            .agg(F.sum("n").alias("fraud_count"), (F.sum("risk") / F.sum("n")).alias("avg_risk"))
            .withColumn("avg_risk", r("avg_risk")))


@query
def route_query(spark, sf):
    asked = read_table(spark, sf, "conversations").withColumn("route", analytics.route_query(F.col("text")))
    return asked.select("conv_id", "turn", "route", analytics.route_days(F.col("route"), F.col("text")).alias("days"))


@query
def route_summary(spark, sf):
    route = analytics.route_query(F.col("text")).alias("route")
    return read_table(spark, sf, "documents").groupBy(route).agg(F.count("*").alias("texts"))


@query
def answer_top_users(spark, sf):
    a = alerts_events(spark, sf)
    return analytics.answer_top_users(analytics.top_users(a, analytics.newest(a)), 7)


@query
def answer_trends(spark, sf):
    a = alerts_events(spark, sf)
    return analytics.answer_trends(analytics.fraud_trends(a, analytics.newest(a)), 30)


@query
def answer_risk(spark, sf):
    return analytics.answer_risk(analytics.risk_distribution(alerts_orders(spark, sf)))


@query
def answer_channels(spark, sf):
    s = scored_orders(spark, sf)
    return analytics.answer_channels(analytics.fraud_by_channel(alerts.build_alerts(s), s))


@query
def answer_overview(spark, sf):
    s = scored_orders(spark, sf)
    return analytics.answer_overview(analytics.overview_counts(s, alerts.build_alerts(s)))


@query
def list_alerts(spark, sf):
    return analytics.list_alerts(alerts_orders(spark, sf)).select(
        "alert_id", "transaction_id", "customer_id", "risk_score", "reason", "rule_score",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query
def history(spark, sf):
    record = F.col("data")
    return analytics.history(scored_orders(spark, sf), 3).select(
        "transaction_id", record["transaction_amount"].cast("double").alias("transaction_amount"),
        record["kyc_verified"].alias("kyc_verified"), "predicted", "probability")


@query
def label_status(spark, sf):
    s = scored_orders(spark, sf)
    return labels.label_status(s, views.label_events(s))


@query
def apply_labels(spark, sf):
    s = scored_orders(spark, sf)
    return labels.apply_labels(s, views.label_events(s)).select("transaction_id", "actual_label")


@query
def labelled_metrics(spark, sf):
    s = scored_orders(spark, sf)
    return labels.labelled_metrics(labels.apply_labels(s, views.label_events(s)), 3)


@query
def self_consistency_metrics(spark, sf):
    unlabelled = scored_events(spark, sf).withColumn("actual_label", F.lit(None).cast("int"))
    return labels.labelled_metrics(unlabelled, 5)


# ---- Stored records

@query
def stored_transactions(spark, sf):
    """The rows the transaction sink appends, with the record as JSON text."""
    fields = ["transaction_id", "customer_id", "account_age_days", "channel", "kyc_verified"]
    text = scored_orders(spark, sf).withColumns({c: F.col(c).cast("string") for c in fields})
    return transaction_rows(text, fields).drop("created_at", "kyc_document_path", "actual_label")


@query
def parsed_records(spark, sf):
    """Records stored as JSON, as a Python-literal dict, and as junk, by turns."""
    tid, channel, kyc = F.col("transaction_id"), F.col("channel").cast("string"), F.col("kyc_verified")
    as_json = F.to_json(F.struct("channel", "kyc_verified"))
    as_literal = F.concat(F.lit("{'channel': "), channel, F.lit(", 'kyc_verified': '"), kyc,
                          F.lit("', 'note': 'it is None, True', 'path': None, 'checked': True}"))
    junk = F.concat(F.lit("<row "), tid.cast("string"), F.lit(">"))
    text = F.when(tid % 3 == 0, as_json).when(tid % 3 == 1, as_literal).otherwise(junk)
    record = txn_orders(spark, sf).select("transaction_id", parse_record(text).alias("record"))
    names = ("channel", "kyc_verified", "note", "path", "checked", "raw_data", "parse_error")
    return record.select("transaction_id", *[F.col("record")[n].alias(n) for n in names])


@query
def normalize_columns(spark, sf):
    t = txn_orders(spark, sf).select("transaction_id", "transaction_amount", "kyc_verified").toDF(" Transaction ID", "Amount  Paid ", "KYC\tVerified")
    return clean.normalize_columns(t)


@query
def named_query_kyc(spark, sf):
    s = scored_orders(spark, sf)
    found = alerts.build_alerts(s)
    return _rounded_risk(analytics.run_named_query("kyc_status", s, found, analytics.newest(found))[0])


@query
def sql_by_channel(spark, sf):
    text = "SELECT channel, count(*) AS n, max(transaction_amount) AS most FROM transactions GROUP BY channel;"
    return analytics.run_sql(spark, text, {"transactions": txn_orders(spark, sf)})


@query
def trend_windows(spark, sf):
    """The stream's daily trend over a table."""
    found = jobs.trend_stream(alerts_events(spark, sf), None)
    return found.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "count", r("avg_risk"))


@query
def velocity_windows(spark, sf):
    """The stream's 24-hour windows over a table, one starting every six hours."""
    found = jobs.velocity_stream(txn_events(spark, sf), None, "6 hours")
    return found.select("customer_id", F.date_format("from", "yyyy-MM-dd HH:mm:ss").alias("from"), "txn_count")


@query
def feature_list(spark, sf):
    return training.fit_bundle(txn_orders(spark, sf)).feature_list(spark)


# ---- Resampling and models (fitted models have no SQL twin)

_MODEL_FEATURES = ["transaction_amount", "account_age_days", "channel", "ml_prob"]


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.robust_scale(txn_orders(spark, sf_dir).select("transaction_id", "is_fraud", *_MODEL_FEATURES), _MODEL_FEATURES)


@query
def smote_counts(spark, sf):
    """Rows per class and origin after balancing; the real rows all stay."""
    return smote(_model_rows(spark, sf), _MODEL_FEATURES).groupBy("is_fraud", F.col("synthetic").cast("int").alias("synthetic")).agg(F.count("*").alias("n"))


@query
def feature_importance(spark, sf):
    return models.feature_importance(_model_rows(spark, sf), _MODEL_FEATURES)


# The hidden probability behind the views' labels, offered to the models as one more field.
_SIGNAL = [*training.NUMERIC, "signal"]


def _with_signal(t: DataFrame) -> DataFrame:
    return t.withColumnRenamed("ml_prob", "signal")


@query
def model_comparison(spark, sf):
    return training.train(_with_signal(txn_orders(spark, sf)), numeric=_SIGNAL).results


@query
def wide_model_comparison(spark, sf):
    """The five-model comparison, ranked by F1."""
    got = training.train(_with_signal(txn_orders(spark, sf)), test_fraction=0.2, balance="none", candidates=training.comparison_models, numeric=_SIGNAL)
    return metrics.compare_models(got.results, "f1")


@query
def trained_scores(spark, sf):
    """Events scored by a model trained on them: probability, rules, decision."""
    t = _with_signal(txn_events(spark, sf))
    only = lambda rows: {"LogisticRegression": models.logistic(rows)}
    fitted = training.train(t, candidates=only, numeric=_SIGNAL).bundle
    return score(t, fitted).select("transaction_id", "ml_prob", "rule_score", "risk_score", "final_label")
