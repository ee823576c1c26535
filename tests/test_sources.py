"""Readers, record parsing and sinks on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import clean
from txnrisk.operators.alerts import build_alerts
from txnrisk.plans import analytics, views
from txnrisk.sources import readers, sinks
from txnrisk.sources.records import parse_record

HEADER = " Transaction ID ,customer_id,KYC_verified,account_age_days,transaction_amount,channel,timestamp,is_fraud,note\n"


def test_csv_by_name_with_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADER + "TXN_1,CUST_1,Yes,10,99.5,0,2025-01-01 03:00:00,0,x\n"
                                    "TXN_2,CUST_2,NA,12.5,None,null,garbage,1,nan\nTXN_3,CUST_3,No,,nan,2,,0,\n")
    got = readers.read_transactions(spark, str(tmp_path / "t.csv")).orderBy("transaction_id").collect()
    assert got[0]["transaction_amount"] == 99.5 and got[0]["timestamp"].hour == 3 and got[0]["note"] == "x"
    assert [got[1][c] for c in ("kyc_verified", "account_age_days", "transaction_amount", "channel", "timestamp", "note")] == [None] * 6
    assert got[2]["transaction_amount"] is None and got[2]["channel"] == 2 and got[2]["is_high_value"] is None


def test_first_existing_source(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "TXN_1,CUST_1,Yes,10,99.5,0,2025-01-01,0,x\n")
    assert readers.read_first(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).count() == 1
    empty = readers.read_first(spark, [str(tmp_path / "a.csv")])
    assert empty.count() == 0 and empty.schema == readers.TRANSACTION


def test_requests(spark, tmp_path):
    one, many, bad = tmp_path / "one.json", tmp_path / "many.json", tmp_path / "bad.json"
    one.write_text(json.dumps({"transaction_id": "a", "transaction_amount": 12.5, "channel": 1}, indent=1))
    many.write_text(json.dumps([{"transaction_id": "b", "kyc_verified": True}, {"transaction_id": "c", "kyc_document_path": "p"}]))
    bad.write_text("\"just text\"")
    got = {r["transaction_id"]: r for r in readers.accepted_requests(readers.read_requests(spark, [str(one), str(many)], whole_files=True)).collect()}
    assert got["a"]["transaction_amount"] == "12.5" and got["a"]["channel"] == "1" and got["b"]["kyc_verified"] == "true"
    assert len(got) == 3
    assert readers.read_requests(spark, str(bad), whole_files=True).first()[readers.CORRUPT] is not None
    with pytest.raises(ValueError):
        readers.accepted_requests(readers.read_requests(spark, str(bad), whole_files=True))
    kyc = readers.kyc_from_document(readers.read_requests(spark, str(many), whole_files=True))
    assert {r["transaction_id"]: r["kyc_verified"] for r in kyc.collect()} == {"b": "0", "c": "1"}


def test_line_delimited_requests(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"transaction_id": "a"}\n{"transaction_id": "b"}\n[broken\n')
    got = readers.read_requests(spark, str(tmp_path / "lines.json"))
    assert readers.accepted_requests(got).count() == 2


RECORDS = {
    '{"a": 1, "b": "None, True", "c": null, "d": true}': {"a": "1", "b": "None, True", "c": None, "d": "true"},
    "{'a': 1, 'b': 'None, True', 'c': None, 'd': True, 'e': False}": {"a": "1", "b": "None, True", "c": None, "d": "true", "e": "false"},
    "{'q': \"it's None\", 'w': 'say \\'True\\'', 'n': None}": {"q": "it's None", "w": "say 'True'", "n": None},
    "{'x': 'caf\\xe9 \\\\', 'n': None}": {"x": "café \\", "n": None},
    "junk": {"raw_data": "junk", "parse_error": "true"},
    "{'a': Nonesuch}": {"raw_data": "{'a': Nonesuch}", "parse_error": "true"},
    "": {"raw_data": "", "parse_error": "true"},
}


def test_parse_record(spark):
    df = spark.createDataFrame([(t,) for t in [*RECORDS, None]], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", parse_record(F.col("t")).alias("p")).collect()}
    assert got == {**RECORDS, None: {"raw_data": "None", "parse_error": "true"}}


def test_parse_long_record(spark):
    long = "{" + ", ".join(f"'k{i}': {'None' if i % 2 else repr('v' * 30)}" for i in range(300)) + "}"
    got = spark.createDataFrame([(long,)], "t string").select(parse_record(F.col("t"))).first()[0]
    assert len(got) == 300 and got["k1"] is None and got["k2"] == "v" * 30
    text = """it's "so" """ * 5000
    long = "{'a': 'x', 'b': " + repr(text) + ", 'c': None}"
    got = spark.createDataFrame([(long,)], "t string").select(parse_record(F.col("t"))).first()[0]
    assert got == {"a": "x", "b": text, "c": None}


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["  Transaction  Amount ", "KYC"])
    assert clean.normalize_columns(df).columns == ["transaction_amount", "kyc"]
    with pytest.raises(ValueError):
        clean.normalize_columns(spark.createDataFrame([(1, 2)], ["A b", "a  B"]))


def test_winsorize_keeps_null(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(None,), (1000.0,)], "x double")
    got = sorted((r["x"] for r in clean.winsorize(df, "x").collect()), key=lambda v: (v is None, v))
    # The quartiles of 0..9 and 1000 are 2.5 and 7.5.
    assert got == [float(v) for v in range(10)] + [15.0, None]


def test_sinks_round_trip(spark, sf, tmp_path):
    scored = views.scored(views.txn_orders(spark, sf))
    path = str(tmp_path / "transactions")
    sinks.write_scored(scored, path, views.RAW_FIELDS)
    back = spark.read.parquet(path)
    assert back.count() == scored.count() and back.select("id").distinct().count() == scored.count()
    assert back.select(F.count_if(parse_record(F.col("data"))["kyc_verified"].isin("Yes", "No"))).first()[0] == scored.count()
    alerts = build_alerts(scored)
    sinks.write_alerts(alerts, str(tmp_path / "alerts"))
    sinks.write_alerts(alerts.limit(0), str(tmp_path / "alerts"))
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    assert stored.count() == alerts.count() and "alert_date" in stored.columns
    pruned = stored.filter(F.col("alert_date") == "1998-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(alert_date" in pruned
    sinks.write_features(scored.select("transaction_id", "ml_prob"), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == scored.count()


def test_text_ids_get_a_stable_number(spark):
    df = spark.createDataFrame([("TXN_1",), ("12",)], "transaction_id string").selectExpr(
        "*", "7 AS user_id", "0 AS predicted", "0.5D AS ml_prob")
    ids = [r["id"] for r in sinks.transaction_rows(df, ["transaction_id"]).collect()]
    assert ids[1] == 12 and ids[0] == df.limit(1).select(F.xxhash64("transaction_id")).first()[0]


def test_named_queries_and_sql(spark, sf):
    scored = views.scored(views.txn_orders(spark, sf))
    alerts = build_alerts(scored)
    as_of = analytics.newest(alerts)
    for name in analytics.named_queries():
        rows, chart, text = analytics.run_named_query(name, scored, alerts, as_of)
        assert chart in ("bar", "line", "pie") and text
        assert rows.columns
    with pytest.raises(ValueError):
        analytics.run_named_query("nothing", scored, alerts, as_of)
    tables = {"transactions": scored, "fraud_alerts": alerts}
    n = analytics.run_sql(spark, "SELECT count(*) AS n FROM fraud_alerts;", tables).first()["n"]
    assert n == alerts.count()
    for text in ("DROP VIEW fraud_alerts", "CREATE TABLE x AS SELECT 1", "SELECT 1) ; DROP VIEW fraud_alerts; SELECT (1"):
        with pytest.raises(Exception):
            analytics.run_sql(spark, text, tables)
    assert analytics.run_sql(spark, "SELECT 1 AS one FROM fraud_alerts", tables).count() == n


def test_answers(spark, sf):
    scored = views.scored(views.txn_orders(spark, sf))
    alerts = build_alerts(scored)
    routes = {}
    for question in ("Top customers this month", "Which channel?", "weekly trend", "risk scores", "overview", "hello"):
        routes[question], text = analytics.answer(question, scored, alerts, analytics.newest(alerts))
        assert text.first()["answer"]
    assert list(routes.values()) == ["top_users", "channel_analysis", "fraud_trends", "risk_distribution", "system_overview", "help"]
    none = scored.limit(0)
    assert analytics.answer("overview", none, build_alerts(none), analytics.newest(alerts))[1].first()["answer"] == analytics.NO_DATA_TEXT
    with pytest.raises(ValueError):
        analytics.answer("  ", scored, alerts, analytics.newest(alerts))
