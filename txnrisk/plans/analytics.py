"""Analytics over scored transactions and alerts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk.functions import cleaning
from txnrisk.sources.records import parse_record

# Routing words, in order of precedence, and the route each group leads to.
ROUTES = {
    "top_users": ("top", "user", "customer"),
    "channel_analysis": ("channel", "pos", "mobile", "atm", "web"),
    "fraud_trends": ("trend", "time", "week", "month"),
    "risk_distribution": ("risk", "score"),
    "system_overview": ("overview", "summary", "stat"),
}
HELP_TEXT = ("I can help you analyze: top users, fraud trends, risk scores, transaction channels, "
             "or system overview.")
NO_DATA_TEXT = "No transaction data available yet. Submit some transactions to see analytics."
CHART = {"top_users": "bar", "channel_analysis": "pie", "fraud_trends": "line", "risk_distribution": "pie",
         "system_overview": "bar", "account_age": "bar", "kyc_status": "pie"}


def newest(alerts: DataFrame) -> Column:
    """The latest alert time, usable as ``as_of`` where the caller has no clock of their own."""
    return alerts.agg(F.max("created_at")).scalar()


def _since(alerts: DataFrame, as_of: Column | datetime, days: int) -> DataFrame:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return alerts.filter(F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days)))


def top_users(alerts: DataFrame, as_of: Column | datetime, days: int = 7, n: int = 10) -> DataFrame:
    return (_since(alerts, as_of, days).groupBy("customer_id")
            .agg(F.count("*").alias("fraud_count"), F.avg("risk_score").alias("avg_risk"))
            .orderBy(F.desc("fraud_count"), "customer_id").limit(n))


def fraud_trends(alerts: DataFrame, as_of: Column | datetime, days: int = 30) -> DataFrame:
    return (_since(alerts, as_of, days).groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count("*").alias("count"), F.avg("risk_score").alias("avg_risk")).orderBy("date"))


def trend_totals(trends: DataFrame) -> DataFrame:
    """Total alerts and mean per day that has alerts."""
    total = F.coalesce(F.sum("count"), F.lit(0))
    return trends.agg(total.alias("total"), (total / F.greatest(F.count("*"), F.lit(1))).alias("daily_mean"))


def risk_band(risk: Column) -> Column:
    return F.when(risk < 0.3, "Low").when(risk < 0.6, "Medium").when(risk < 0.8, "High").otherwise("Critical")


def risk_distribution(alerts: DataFrame) -> DataFrame:
    return (alerts.groupBy(risk_band(F.col("risk_score")).alias("risk_level"))
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "risk_level"))


def overview_counts(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: transactions, predicted frauds, alerts, fraud rate in percent."""
    one = scored.agg(F.count("*").alias("total"), F.count_if(F.col("predicted") == 1).alias("frauds"))
    rate = F.when(F.col("total") > 0, F.col("frauds") / F.col("total") * 100).otherwise(0.0)
    return one.withColumns({"alerts": alerts.agg(F.count("*")).scalar(), "fraud_rate": rate})


def system_overview(scored: DataFrame, alerts: DataFrame) -> DataFrame:
    """The same numbers as metric/value rows."""
    shown = {"Total Transactions": "total", "Fraud Detected": "frauds", "Fraud Alerts": "alerts", "Fraud Rate": "fraud_rate"}
    rows = [F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for name, c in shown.items()]
    return overview_counts(scored, alerts).select(F.inline(F.array(*rows)))


def _by(alerts: DataFrame, txns: DataFrame, name: str, bucket: Column) -> DataFrame:
    """Alert count and mean risk per bucket of the alert's transaction.

    The bucket is read from the record before the join, so that no record text is shuffled. Both sides meet on the id of the
    stored row, which is unique however often a transaction was scored; tables without one meet on the transaction's id.
    """
    key = "stored_id" if "stored_id" in alerts.columns and "stored_id" in txns.columns else "transaction_id"
    return (alerts.select(key, "risk_score").join(txns.select(key, bucket.alias(name)), key)
            .groupBy(name).agg(F.count("*").alias("fraud_count"), F.avg("risk_score").alias("avg_risk"))
            .orderBy(F.desc("fraud_count"), name))


def fraud_by_channel(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    return _by(alerts, txns, "channel", cleaning.channel_name(F.get_json_object("data", "$.channel"), "Unknown"))


def account_age_group(age: Column) -> Column:
    """Buckets at the ages the rules use."""
    return (F.when(age < 7, "under 7 days").when(age < 30, "7-29 days").when(age < 60, "30-59 days")
            .when(age < 365, "60-364 days").when(age >= 365, "365 days or more").otherwise("unknown"))


def fraud_by_account_age(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    return _by(alerts, txns, "age_group", account_age_group(F.get_json_object("data", "$.account_age_days").try_cast("int")))


def fraud_by_kyc(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    flag = cleaning.kyc_flag(F.get_json_object("data", "$.kyc_verified"))
    return _by(alerts, txns, "kyc", F.when(flag == 1, "Yes").otherwise("No"))


def route_query(text: Column) -> Column:
    """The route of a question: the first group with a word in the text; ``empty`` or ``help`` otherwise."""
    words = F.lower(F.trim(text))
    routes = [F.when(reduce(lambda a, b: a | b, [words.contains(w) for w in group]), name) for name, group in ROUTES.items()]
    blank = F.when(words.isNull() | (words == ""), "empty")
    return F.coalesce(blank, *routes, F.lit("help"))


def route_days(route: Column, text: Column) -> Column:
    """The look-back a routed question asks for; null where the route has none."""
    words = F.lower(text)
    return (F.when(route == "top_users", F.when(words.contains("month"), 30).otherwise(7))
            .when(route == "fraud_trends", F.when(words.contains("week"), 7).otherwise(30)))


def _percent(col: Column) -> Column:
    return F.concat(F.format_number(col * 100, 1), F.lit("%"))


def _lines(rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """One row: how many lines there are and the lines joined in order. For reports of a few rows."""
    key = F.struct(*order, line.alias("line"))
    return rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("items")).select(
        "n", F.array_join(F.transform("items", lambda r: r["line"]), "").alias("body"))


def answer_top_users(rows: DataFrame, days: int) -> DataFrame:
    """``rows`` is a top-k, so the list that is joined holds k lines."""
    ranked = F.struct((-F.col("fraud_count")).alias("a"), F.col("customer_id").alias("b"),
                      F.concat(F.col("customer_id").cast("string"), F.lit(": "), F.col("fraud_count").cast("string"),
                               F.lit(" alerts, avg risk: "), _percent(F.col("avg_risk")), F.lit("\n")).alias("line"))
    numbered = F.transform("items", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["line"]))
    return rows.agg(F.array_sort(F.collect_list(ranked)).alias("items")).select(F.concat(
        F.lit("Top "), F.size("items").cast("string"), F.lit(f" fraud-prone users (last {days} days):\n\n"),
        F.array_join(numbered, "")).alias("answer"))


def answer_trends(rows: DataFrame, days: int) -> DataFrame:
    return trend_totals(rows).select(F.concat(
        F.lit(f"Fraud trends (last {days} days): "), F.col("total").cast("string"),
        F.lit(" total alerts\nAverage daily: "), F.replace(F.format_number("daily_mean", 1), F.lit(","), F.lit("")), F.lit(" alerts")).alias("answer"))


def answer_risk(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("• "), "risk_level", F.lit(": "), F.col("count").cast("string"), F.lit(" alerts\n"))
    return _lines(rows, [(-F.col("count")).alias("a"), F.col("risk_level").alias("b")], line).select(
        F.concat(F.lit("Risk score distribution:\n"), "body").alias("answer"))


def answer_channels(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("• "), "channel", F.lit(": "), F.col("fraud_count").cast("string"),
                    F.lit(" alerts, avg risk: "), _percent(F.col("avg_risk")), F.lit("\n"))
    return _lines(rows, [(-F.col("fraud_count")).alias("a"), F.col("channel").alias("b")], line).select(
        F.concat(F.lit("Fraud by transaction channel:\n"), "body").alias("answer"))


def answer_overview(counts: DataFrame) -> DataFrame:
    return counts.select(F.concat(
        F.lit("System Overview:\n• Transactions: "), F.col("total").cast("string"), F.lit("\n• Fraud Rate: "),
        F.format_number("fraud_rate", 1), F.lit("%\n• Alerts: "), F.col("alerts").cast("string")).alias("answer"))


def list_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(limit)


def history(scored: DataFrame, user_id: int) -> DataFrame:
    """A user's transactions, newest id first, with the stored record parsed."""
    return (scored.filter(F.col("user_id") == user_id)
            .select("transaction_id", parse_record(F.col("data")).alias("data"), "predicted", "probability", "created_at")
            .orderBy(F.desc("transaction_id")))


def named_queries(days: int | None = None) -> dict[str, Callable[[DataFrame, DataFrame, Column | datetime], DataFrame]]:
    """Query name to a function of (scored, alerts, as_of)."""
    return {
        "top_users": lambda s, a, t: top_users(a, t, days or 7),
        "fraud_trends": lambda s, a, t: fraud_trends(a, t, days or 30),
        "risk_distribution": lambda s, a, t: risk_distribution(a),
        "system_overview": lambda s, a, t: system_overview(s, a),
        "channel_analysis": lambda s, a, t: fraud_by_channel(a, s),
        "account_age": lambda s, a, t: fraud_by_account_age(a, s),
        "kyc_status": lambda s, a, t: fraud_by_kyc(a, s),
    }


def run_named_query(name: str, scored: DataFrame, alerts: DataFrame, as_of: Column | datetime,
                    days: int | None = None) -> tuple[DataFrame, str, str]:
    """(rows, chart type, explanation) of a named query."""
    known = named_queries(days)
    if name not in known:
        raise ValueError(f"unknown query {name!r}; known: {', '.join(known)}")
    return known[name](scored, alerts, as_of), CHART[name], f"Result of {name.replace('_', ' ')}"


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run a caller's SELECT over temporary views.

    The text stands in a subquery, where the SQL grammar admits queries only, so it cannot change anything. The views are there
    only while the text is analyzed; views of the same names that the caller has come back afterwards.
    """
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in temporary}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)")
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def answer(question: str, scored: DataFrame, alerts: DataFrame, as_of: Column | datetime) -> tuple[str, DataFrame]:
    """(route, one-row answer) for one question; the question is routed by the same expression as a table of them."""
    spark = scored.sparkSession
    asked = spark.range(1).select(route_query(F.lit(question)).alias("route"))
    route, days = asked.select("route", route_days(F.col("route"), F.lit(question))).first()
    if route == "empty":
        raise ValueError("Query is required")

    def text(line: str) -> DataFrame:
        return spark.range(1).select(F.lit(line).alias("answer"))

    if scored.isEmpty() and alerts.isEmpty():
        return route, text(NO_DATA_TEXT)
    if route == "top_users":
        return route, answer_top_users(top_users(alerts, as_of, days), days)
    if route == "fraud_trends":
        return route, answer_trends(fraud_trends(alerts, as_of, days), days)
    if route == "risk_distribution":
        return route, answer_risk(risk_distribution(alerts))
    if route == "channel_analysis":
        return route, answer_channels(fraud_by_channel(alerts, scored))
    if route == "system_overview":
        return route, answer_overview(overview_counts(scored, alerts))
    return route, text(HELP_TEXT)
