"""Append-only sinks: Parquet partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.sources.records import to_record


def write_features(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """The processed data set; ``csv`` gets a header line."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if file_format == "csv" else writer.format(file_format).save(path)


def transaction_rows(scored: DataFrame, record_columns: list[str]) -> DataFrame:
    """Rows of the transactions table. The id is the transaction's own number, else a hash of its id or record."""
    record = to_record(scored, *record_columns)
    given = F.col("transaction_id")
    key = F.coalesce(given.try_cast("long"), F.xxhash64(F.coalesce(given.cast("string"), record)))
    path = F.col("kyc_document_path") if "kyc_document_path" in scored.columns else F.lit(None).cast("string")
    made = F.col("created_at") if "created_at" in scored.columns else F.current_timestamp()
    return scored.select(
        key.alias("id"), F.col("user_id").cast("long").alias("user_id"), record.alias("data"), "predicted",
        F.round("ml_prob", 6).alias("probability"), F.lit(None).cast("int").alias("actual_label"),
        made.alias("created_at"), path.alias("kyc_document_path"),
        *(["stored_id"] if "stored_id" in scored.columns else []))


def with_stored_id(scored: DataFrame) -> DataFrame:
    """Add an id of its own for each row, however often a transaction is scored and whether it has an id."""
    return scored if "stored_id" in scored.columns else scored.withColumn("stored_id", F.expr("uuid()"))


def write_scored(scored: DataFrame, path: str, record_columns: list[str]) -> None:
    """Append the transactions. To let alerts refer to stored rows, write ``with_stored_id`` rows and alerts built from what
    was written: an id is drawn anew each time the rows are computed."""
    _append_by_day(transaction_rows(scored, record_columns), path, "created_date")


def write_alerts(alerts: DataFrame, path: str) -> None:
    _append_by_day(alerts, path, "alert_date")


def _append_by_day(df: DataFrame, path: str, day: str) -> None:
    df.withColumn(day, F.to_date("created_at")).write.mode("append").partitionBy(day).parquet(path)
