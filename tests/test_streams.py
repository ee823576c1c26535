"""Streams with state of their own: the exact 24-hour count, and the ledger of stored alerts."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import features
from txnrisk.streaming import jobs

COLUMNS = "transaction_id long, customer_id long, timestamp timestamp"


def files(folder):
    return [f for f in glob.glob(f"{folder}/**/*.parquet", recursive=True) if "/_copies/" not in f]


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Five days of transactions in files that overlap by half an hour, equal times, a hot customer, rows without customer or
    time, and rows that come two days late."""
    folder = tmp_path_factory.mktemp("replay")
    rng = np.random.default_rng(3)
    start = 1_700_000_000_000_000
    rows = []
    for i in range(1200):
        us = start + int(rng.integers(0, 5 * 86_400)) * 1_000_000 + int(rng.integers(0, 3))
        if rng.random() < 0.3:
            us = us // 600_000_000 * 600_000_000
        rows.append((i, int(rng.integers(1, 12)) if rng.random() < 0.6 else 0, us))
    order = sorted(rows, key=lambda r: r[2] + rng.integers(0, 1800) * 1_000_000)
    parts = [order[i : i + 300] for i in range(0, 1200, 300)]
    late = [(10_000 + i, 0, start + 86_400_000_000 + i) for i in range(5)]
    odd = [(20_000, None, start), (20_001, 3, None)]
    parts.append(late + odd)
    # The last rows push the watermark beyond all others.
    parts.append([(30_000, 99, start + 9 * 86_400_000_000)])
    for n, part in enumerate(parts):
        frame = spark.createDataFrame([(i, c, t) for i, c, t in part], "transaction_id long, customer_id long, us long")
        frame.select("transaction_id", "customer_id", F.timestamp_micros("us").alias("timestamp")).coalesce(1).write.parquet(f"{folder}/part={n:02d}")
    return folder, rows, late


def test_exact_velocity_equals_batch(spark, replay, tmp_path):
    folder, rows, late = replay
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/part=*")
    query = jobs.exact_velocity(stream, "1 hour").writeStream.format("memory").queryName("exact").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(400)
    got = {r["transaction_id"]: r["txn_last_24h"] for r in spark.table("exact").collect()}
    table = spark.createDataFrame([(i, c, t) for i, c, t in rows], "transaction_id long, customer_id long, us long").withColumn("timestamp", F.timestamp_micros("us"))
    want = {r["transaction_id"]: r["txn_last_24h"] for r in features.velocity_24h(table).collect()}
    assert not any(i in got for i, _, _ in late) and got.pop(20_000) == got.pop(20_001) == 0
    got.pop(30_000, None)
    assert got == want and spark.table("exact").filter("transaction_id < 10000").count() == len(rows)


def alerts(spark, first, n, day):
    rows = [(i, 0.5) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "transaction_id long, risk_score double").withColumn("created_at", F.lit(f"{day} 10:00:00").cast("timestamp"))


def test_a_killed_and_repeated_batch_is_stored_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "alerts")
    jobs.write_alert_batch(alerts(spark, 0, 10, "2025-01-01"), 0, path)
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "_append_ledger", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            jobs.write_alert_batch(alerts(spark, 10, 10, "2025-01-01"), 1, path)
    assert spark.read.parquet(path).count() == 20 and jobs.read_alerts(spark, path).count() == 10
    for _ in range(2):
        jobs.write_alert_batch(alerts(spark, 10, 10, "2025-01-01"), 1, path)
    assert sorted(r["transaction_id"] for r in jobs.read_alerts(spark, path).collect()) == list(range(20))


def test_files_follow_days_not_batches(spark, tmp_path, monkeypatch):
    """Two dates of batches, an attempt without an entry, then the first batch of a third date."""
    path = str(tmp_path / "alerts")
    for b in range(6):
        rows = alerts(spark, 10 * b, 5, "2025-01-01").unionByName(alerts(spark, 10 * b + 5, 5, "2025-01-02"))
        jobs.write_alert_batch(rows, b, path, on="2025-02-01" if b < 3 else "2025-02-02")
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "_append_ledger", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            jobs.write_alert_batch(alerts(spark, 900, 5, "2025-01-02"), 6, path, on="2025-02-02")
    jobs.write_alert_batch(alerts(spark, 60, 1, "2025-01-03").withColumn("created_at", F.lit(None).cast("timestamp")), 7, path, on="2025-02-03")
    data, ledger = [f for f in files(path) if "_ledger" not in f], files(f"{path}/_ledger")
    assert len(data) == 3 and len(ledger) == 3  # two days and the row without a time; three dates
    assert sorted(r["transaction_id"] for r in jobs.read_alerts(spark, path).collect()) == list(range(61))
    # A repeated batch is known from the packed ledger too.
    jobs.write_alert_batch(alerts(spark, 0, 5, "2025-01-01"), 2, path, on="2025-02-03")
    assert jobs.read_alerts(spark, path).count() == 61


def test_an_interrupted_rewrite_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "alerts")
    for b in range(3):
        jobs.write_alert_batch(alerts(spark, 10 * b, 10, "2025-01-01"), b, path, on="2025-02-01")
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "_replace_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            jobs.pack_alerts(spark, path, "2025-02-02")
    jobs.write_alert_batch(alerts(spark, 30, 1, "2025-01-01"), 3, path, on="2025-02-02")
    assert sorted(r["transaction_id"] for r in jobs.read_alerts(spark, path).collect()) == list(range(31))
    assert not glob.glob(f"{path}/_copies/*")
