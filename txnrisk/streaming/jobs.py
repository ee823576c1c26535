"""Streaming versions of scoring, alerting, the daily trend, velocity and de-duplication."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampType

from txnrisk.functions import cleaning
from txnrisk.operators.alerts import build_alerts
from txnrisk.plans.scoring import score
from txnrisk.sources.bundle import Bundle
from txnrisk.sources.readers import path_exists
from txnrisk.streaming.velocity import exact_velocity

__all__ = ["alert_stream", "dedup_stream", "exact_velocity", "pack_alerts", "read_alerts", "score_stream", "trend_stream", "velocity_stream", "write_alert_batch"]

# Rows of a rewritten day that share a file.
ROWS_PER_FILE = 2_000_000


def score_stream(stream: DataFrame, bundle: Bundle) -> DataFrame:
    """Scored transactions; ``created_at`` is the transaction's own time (and keeps its watermark), null in data without one."""
    if "timestamp" not in stream.columns:
        return score(stream, bundle).withColumn("created_at", F.lit(None).cast("timestamp"))
    when = F.col("timestamp")
    if stream.schema["timestamp"].dataType != TimestampType():
        when = cleaning.to_timestamp(when)
    return score(stream, bundle).withColumn("created_at", when)


def write_alert_batch(alerts: DataFrame, batch_id: int, path: str, on: str | None = None) -> None:
    """Store one micro-batch: rows in folders by day, then an entry in the ledger. Alerts without an id can't be told apart and
    are all stored.

    A batch that is in the ledger is stored already, so a repeated one does nothing. Rows of an attempt that was killed before its
    entry was made are in no entry, and ``read_alerts`` leaves them out. With the first batch of a new date (``on``, today by
    default) the days that earlier batches wrote are rewritten into few files.
    """
    spark = alerts.sparkSession
    on = on or datetime.date.today().isoformat()
    ledger = read_ledger(spark, path)
    if not ledger.filter(F.col("batch_id") == batch_id).isEmpty():
        return
    if not ledger.filter((F.col("made_on") < on) & ~F.col("packed")).isEmpty():
        pack_alerts(spark, path, on)
    has_id, attempt = F.col("transaction_id").isNotNull(), uuid.uuid4().hex
    stored = alerts.filter(has_id).dropDuplicates(["transaction_id"]).unionByName(alerts.filter(~has_id))
    (stored.withColumns({"alert_date": F.to_date("created_at"), "batch_id": F.lit(batch_id).cast("long"), "attempt": F.lit(attempt)})
     .write.mode("append").partitionBy("alert_date").parquet(path))
    _append_ledger(spark, path, [(int(batch_id), attempt, False)], on)


_LEDGER = "batch_id long, attempt string, packed boolean"


def _append_ledger(spark: SparkSession, path: str, rows: list[tuple], on: str) -> None:
    (spark.createDataFrame(rows, _LEDGER).coalesce(1).withColumn("made_on", F.lit(on))
     .write.mode("append").partitionBy("made_on").parquet(f"{path}/_ledger"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, attempt, packed, made_on): the batches that are stored, ``packed`` if ``pack_alerts`` has rewritten them."""
    if not path_exists(spark, f"{path}/_ledger"):
        return spark.createDataFrame([], f"{_LEDGER}, made_on string")
    return spark.read.schema(f"{_LEDGER}, made_on string").parquet(f"{path}/_ledger")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The stored alerts: rows whose attempt is in the ledger, which has a row for each batch."""
    return spark.read.parquet(path).join(read_ledger(spark, path).select("attempt"), "attempt", "left_semi")


def pack_alerts(spark: SparkSession, path: str, on: str) -> None:
    """Rewrite the days that batches entered before the date ``on`` have written, and the ledger of these dates, into few files.

    Only the stream that writes may do this, between its batches. Each folder is first copied aside, and the copy is kept until
    the folder is replaced; a complete copy that is found belongs to a rewrite that was interrupted, and is put in place first.
    """
    for name in _complete_copies(spark, path):
        _replace_folder(spark, path, name)
    entries = read_ledger(spark, path)
    new = entries.filter((F.col("made_on") < on) & ~F.col("packed"))
    rows = spark.read.parquet(path).withColumn("alert_date", F.col("alert_date").cast("date"))
    touched = rows.join(new.select("attempt"), "attempt", "left_semi").select(F.col("alert_date").cast("string")).distinct()
    for (day,) in touched.collect():  # the days of a few dates' batches
        here = rows.filter(F.col("alert_date").eqNullSafe(F.lit(day).cast("date")))
        _copy_aside(here.join(entries.select("attempt"), "attempt", "left_semi"), path, f"alert_date={day}")
        _replace_folder(spark, path, f"alert_date={day}")
    for (date,) in new.select("made_on").distinct().collect():
        _copy_aside(entries.filter(F.col("made_on") == date).withColumn("packed", F.lit(True)), path, f"made_on={date}")
        _replace_folder(spark, path, f"made_on={date}")


def _copy_aside(rows: DataFrame, path: str, name: str) -> None:
    files = max(1, -(-rows.count() // ROWS_PER_FILE))
    rows.repartition(files).write.mode("overwrite").parquet(f"{path}/_copies/{name}")


def _complete_copies(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_copies")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return [name for name in found if path_exists(spark, f"{path}/_copies/{name}/_SUCCESS")]


def _replace_folder(spark: SparkSession, path: str, name: str) -> None:
    copy, column = f"{path}/_copies/{name}", name.split("=")[0]
    target = path if column == "alert_date" else f"{path}/_ledger"
    # The copy is named like a partition, but holds the column itself.
    rows = spark.read.option("basePath", copy).parquet(copy)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(target)
    _delete(spark, copy)


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def alert_stream(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store the alerts of a scored stream, for ``read_alerts``; ``checkpoint`` must be a shared folder on a cluster."""
    return (build_alerts(scored).writeStream.foreachBatch(lambda df, batch_id: write_alert_batch(df, batch_id, path))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _late(stream: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream has one watermark: pass None where it was set before, as by ``dedup_stream``."""
    return stream.withWatermark(time, late) if late else stream


def trend_stream(alerts: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Alerts and mean risk per day; rows later than the watermark are dropped."""
    return (_late(alerts, "created_at", late).groupBy(F.window("created_at", "1 day").alias("day"))
            .agg(F.count("*").alias("count"), F.avg("risk_score").alias("avg_risk"))
            .select(F.col("day.start").alias("day_start"), "count", "avg_risk"))


def velocity_stream(transactions: DataFrame, late: str | None = "1 hour", step: str = "1 hour") -> DataFrame:
    """Transactions per customer in 24-hour windows that start every ``step``; ``exact_velocity`` has the count per transaction."""
    return (_late(transactions, "timestamp", late)
            .groupBy(F.window("timestamp", "24 hours", step).alias("span"), "customer_id").agg(F.count("*").alias("txn_count"))
            .select("customer_id", F.col("span.start").alias("from"), F.col("span.end").alias("to"), "txn_count"))


def dedup_stream(transactions: DataFrame, late: str = "1 day", time: str = "timestamp") -> DataFrame:
    """One row per transaction id among those that arrive within the watermark; rows without an id all pass."""
    marked, has_id = transactions.withWatermark(time, late), F.col("transaction_id").isNotNull()
    return marked.filter(has_id).dropDuplicatesWithinWatermark(["transaction_id"]).unionByName(marked.filter(~has_id))
