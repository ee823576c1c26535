"""Plans: filters and columns reach the scan, a top-k is no global sort."""

from pyspark.sql import functions as F

from txnrisk.operators import clean
from txnrisk.plans import analytics
from txnrisk.plans.queries import alerts_orders, scored_orders
from txnrisk.plans.views import read_table

def scan_of(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]


def test_only_needed_columns_are_read(spark, sf):
    scans = scan_of(analytics.risk_distribution(alerts_orders(spark, sf)))
    assert scans and all("o_orderstatus" not in s and "o_custkey" not in s for s in scans)
    plan = analytics.risk_distribution(alerts_orders(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "High-value" not in plan and "to_json" not in plan
    overview = analytics.overview_counts(scored_orders(spark, sf), alerts_orders(spark, sf))
    assert all("o_custkey" not in s for s in scan_of(overview))


def test_outlier_filter_reaches_the_scan(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_totalprice"))
    scan = scan_of(clean.outliers(orders, "o_totalprice"))[0]
    assert "LessThan(o_totalprice" in scan and "GreaterThan(o_totalprice" in scan


def test_top_users_takes_ordered(spark, sf):
    plan = analytics.top_users(alerts_orders(spark, sf), F.lit("1998-08-01").cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("Exchange") == 1
