"""Cleaning: names, casts, duplicates, outliers, missing values, feature alignment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.functions import cleaning
from txnrisk.operators.profile import numeric_columns
from txnrisk.operators.ranks import fit_quantiles

ID_COLUMNS = ["transaction_id", "customer_id", "timestamp"]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case the names and turn blanks into underscores."""
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def rename_amount(df: DataFrame) -> DataFrame:
    """transaction_amount becomes the number ``amount``; unparsable values become 0."""
    if "transaction_amount" not in df.columns:
        return df
    return df.withColumn("amount", cleaning.number_or_zero(F.col("transaction_amount"))).drop("transaction_amount")


def drop_ids(df: DataFrame) -> DataFrame:
    return df.drop(*ID_COLUMNS)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5, approx: bool = False) -> tuple[float | None, float | None]:
    """(lower, upper): the quartiles moved out by k times their distance; (None, None) without values."""
    quartiles = fit_quantiles(df, column, [0.25, 0.75], approx)
    if quartiles is None:
        return None, None
    reach = (quartiles[1] - quartiles[0]) * k
    return quartiles[0] - reach, quartiles[1] + reach


def _outside(column: str, bounds: tuple[float | None, float | None]) -> Column:
    """Plain comparisons, which reach the scan; NaN, which Spark counts as greater than all numbers, is no outlier."""
    value = F.col(column)
    return ((value < F.lit(bounds[0])) | (value > F.lit(bounds[1]))) & ~F.isnan(value)


def outlier_bounds(df: DataFrame, column: str, k: float = 1.5, approx: bool = False) -> DataFrame:
    """One row: lower and upper bound and the number of rows strictly outside."""
    bounds = iqr_bounds(df, column, k, approx)
    return df.agg(F.lit(bounds[0]).cast("double").alias("lower"), F.lit(bounds[1]).cast("double").alias("upper"),
                  F.count_if(_outside(column, bounds)).alias("outliers"))


Bounds = tuple[float | None, float | None]


def outliers(df: DataFrame, column: str, k: float = 1.5, approx: bool = False, bounds: Bounds | None = None) -> DataFrame:
    """The rows strictly outside the bounds: fitted ones (of ``history.iqr_bounds``, say) where given, else the batch's own."""
    return df.filter(_outside(column, bounds or iqr_bounds(df, column, k, approx)))


def winsorize(df: DataFrame, column: str, k: float = 1.5, approx: bool = False, bounds: Bounds | None = None) -> DataFrame:
    """Clip to the outlier bounds, given or the batch's own; null stays null, and NaN becomes null."""
    (lower, upper), value = bounds or iqr_bounds(df, column, k, approx), cleaning.known(F.col(column))
    clipped = F.least(F.greatest(value, F.lit(lower)), F.lit(upper))
    return df.withColumn(column, F.when(value.isNotNull(), clipped))


def parse_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn(column, cleaning.to_timestamp(F.col(column)))


def fill_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.fill(0, columns or numeric_columns(df))


def align_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly the named columns in order, a missing one as 0, after the ``keep`` columns."""
    have = set(df.columns)
    return df.select(*(keep or []), *[F.col(f"`{n}`") if n in have else F.lit(0).alias(n) for n in names])
