"""Time, amount, customer, velocity and category features."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from txnrisk.functions import cleaning
from txnrisk.operators.joins import skew_join
from txnrisk.operators.ranks import fit_quantiles

HIGH_QUANTILE = 0.95
# Levels of a category that become columns of their own.
MOST_DUMMIES = 1000

# In microseconds.
_MINUTE = 60 * 1_000_000
_DAY = 24 * 60 * _MINUTE
_MINUTES = 24 * 60


def time_features(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """hour, day, day_of_week (0 is Monday), month, is_weekend, is_night; an unknown time gives hour 0 and flags 0."""
    when = cleaning.to_timestamp(F.col(column))
    hour, weekday = F.hour(when), F.weekday(when)
    return df.withColumns({
        "hour": F.coalesce(hour, F.lit(0)), "day": F.dayofmonth(when), "day_of_week": weekday, "month": F.month(when),
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
        "is_night": F.when((hour >= 22) | (hour <= 6), 1).otherwise(0),
    })


def log_amount(col: Column) -> Column:
    """ln(1 + x); 0 where x is null or at most -1."""
    return F.coalesce(F.log1p(F.when(col > -1, col)), F.lit(0.0))


def high_amount_cut(df: DataFrame, column: str = "amount", q: float = HIGH_QUANTILE,
                    approx: bool = False) -> float:
    """The quantile of the known amounts; infinite, which flags nothing, without any."""
    quantile = fit_quantiles(df, column, [q], approx)
    return quantile[0] if quantile else math.inf


def high_amount(df: DataFrame, column: str = "amount", cut: float | None = None, approx: bool = False) -> DataFrame:
    """Flag amounts strictly above the cut: a fitted one where given, else the batch's own."""
    cut = high_amount_cut(df, column, approx=approx) if cut is None else cut
    return df.withColumn("high_amount", F.when(cleaning.known(F.col(column)) > cut, 1).otherwise(0))


def high_amount_night(df: DataFrame) -> DataFrame:
    night = F.col("is_night") if "is_night" in df.columns else F.lit(0)
    return df.withColumn("high_amount_night", F.col("high_amount") * night)


def customer_stats(df: DataFrame, column: str = "transaction_amount") -> DataFrame:
    """Per customer: transaction count, mean, max and min amount."""
    return df.groupBy("customer_id").agg(
        F.count(column).alias("cust_txn_count"), F.avg(column).alias("cust_avg_amount"),
        F.max(column).alias("cust_max_amount"), F.min(column).alias("cust_min_amount"))


def join_customer_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every transaction with its customer's statistics; the counts in them show which customers are hot."""
    counts = stats.select("customer_id", F.col("cust_txn_count").alias("n"))
    return skew_join(df, stats, ["customer_id"], counts)


def velocity_boundary(df: DataFrame, end: Column, carried: DataFrame | None = None) -> DataFrame:
    """What the next run needs of all transactions before ``end``: customer_id, timestamp and number ``n`` for the last 24 hours.

    ``df`` has the transactions of this run, ``carried`` what the run before left.
    """
    known = F.col("customer_id").isNotNull() & F.col("timestamp").isNotNull()
    counted = df.filter(known).groupBy("customer_id", F.col("timestamp").cast("timestamp").alias("timestamp")).agg(F.count("*").alias("n"))
    both = counted.unionByName(carried) if carried is not None else counted
    recent = F.col("timestamp") > end - F.expr("INTERVAL 24 HOURS")
    return both.filter(recent).groupBy("customer_id", "timestamp").agg(F.sum("n").alias("n"))


def velocity_24h(df: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Add ``txn_last_24h``: the customer's transactions in (t - 24 h, t], same-time ones included.

    That is C(t) - C(t - 24 h), with C(x) the customer's transactions up to x. Every distinct time goes
    in twice, as itself and as a probe 24 hours earlier. A customer with a large share of the rows must
    not become one window partition, and a sliding frame would look at all of the 24 hours for each
    row, so C is put together from running sums over the customer's days, the minutes of each day and
    the times of each minute. Rows without a customer or time get 0.

    A daily run reads its own transactions and, as ``carried``, the ``velocity_boundary`` of the run before.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    minute = F.floor(F.col("_us") / _MINUTE)
    known = F.col("customer_id").isNotNull() & F.col("timestamp").isNotNull()
    per_time = df.filter(known).groupBy("customer_id", micros.alias("_us")).agg(F.count("*").alias("n"))
    if carried is not None:
        per_time = per_time.unionByName(carried.select("customer_id", micros.alias("_us"), "n")).groupBy("customer_id", "_us").agg(F.sum("n").alias("n"))

    def rows(us: Column, n: Column, at: Column, sign: int, of: DataFrame) -> DataFrame:
        return of.select("customer_id", us.alias("_us"), n.cast("long").alias("n"), at.cast("long").alias("_at"), F.lit(sign).alias("_sign"))

    us = F.col("_us")
    both = rows(us, F.col("n"), us, 1, per_time).unionByName(rows(us - _DAY, F.lit(0), us, -1, per_time))
    minutes = both.groupBy("customer_id", minute.alias("_minute")).agg(F.sum("n").alias("n"))
    day = F.floor(F.col("_minute") / _MINUTES)
    # One row per customer and day; what came before a day goes along as a mark at its start, so no window holds more
    # than the days of a customer or the minutes of a day.
    days = minutes.groupBy("customer_id", day.alias("_day")).agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("customer_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("customer_id", (F.col("_day") * _MINUTES).alias("_minute"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.lit(0).alias("_real"))
    sooner = Window.partitionBy("customer_id", day).orderBy("_minute", "_real").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(sooner), F.lit(0))
    minutes = minutes.withColumn("_real", F.lit(1)).unionByName(starts).withColumn("before", before).filter("_real = 1")
    # What came before the minute goes along as a mark at its start, so the sum inside the minute needs no join.
    marks = rows(F.col("_minute") * _MINUTE, F.col("before"), F.lit(None), 0, minutes)
    inside = Window.partitionBy("customer_id", minute).orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    counted = (both.unionByName(marks).select("customer_id", "_at", (F.sum("n").over(inside) * F.col("_sign")).alias("c"))
               .filter(F.col("_at").isNotNull()).groupBy("customer_id", F.col("_at").alias("_us"))
               .agg(F.sum("c").alias("txn_last_24h")))
    joined = skew_join(df.withColumn("_us", micros), counted, ["customer_id", "_us"], per_time)
    return joined.withColumn("txn_last_24h", F.coalesce("txn_last_24h", F.lit(0))).drop("_us")


def few_levels(df: DataFrame, columns: list[str], most: int = MOST_DUMMIES) -> dict[str, list]:
    """The sorted levels of those columns that have at most ``most``; no more than that and one are ever read out."""
    found = {c: [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).collect()] for c in columns}
    return {c: sorted(levels) for c, levels in found.items() if len(levels) <= most}


def fit_levels(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """The sorted levels of each column. Each becomes a column of its own, so only categories belong here: columns with more than
    ``MOST_DUMMIES`` levels are an error. ``operators.encode`` has no such bound."""
    found = few_levels(df, columns)
    if len(found) < len(columns):
        raise ValueError(f"too many levels for a column each, use operators.encode: {[c for c in columns if c not in found]}")
    return found


def dummy_name(column: str, level: object) -> str:
    """``<column>_<level>``; a dot, which would name a field of a column, becomes an underscore."""
    return f"{column}_{level}".replace(".", "_")


def dummy_columns(levels: dict[str, list], drop_first: bool = True) -> dict[str, Column]:
    """A 0/1 expression ``<column>_<level>`` per level; the first level and null are all zeros."""
    pairs = [(c, level) for c, found in levels.items() for level in found[int(drop_first):]]
    made = {dummy_name(c, level): F.when(F.col(c) == F.lit(level), 1).otherwise(0) for c, level in pairs}
    if len(made) < len(pairs):
        raise ValueError("two levels give the same column name")
    return made


def one_hot(df: DataFrame, columns: list[str], levels: dict[str, list] | None = None, drop_first: bool = True) -> DataFrame:
    """Replace the columns by their dummies; a column with fitted levels that the data lacks gives none."""
    levels = levels or fit_levels(df, columns)
    levels = {c: found for c, found in levels.items() if c in df.columns}
    return df.withColumns(dummy_columns(levels, drop_first)).drop(*columns)


def chi2_scores(df: DataFrame, columns: list[str], label: str = "is_fraud") -> DataFrame:
    """Score of each dummy against the label: over the classes, (observed - expected)^2 / expected of its sum."""
    classes = df.groupBy(label).agg(F.count("*").alias("class_n"))
    share = classes.withColumn("share", F.col("class_n") / df.agg(F.count("*")).scalar()).select(F.col(label).alias("class"), "share")
    scores = []
    # The loop runs over the few columns; levels stay in Spark, however many there are.
    for c in columns:
        cells = df.filter(F.col(c) > df.agg(F.min(c)).scalar()).groupBy(F.col(c).alias("level"), F.col(label).alias("class")).agg(F.count("*").alias("observed"))
        total = F.sum("observed")
        # The squares of all classes, those without a row of the level included, sum up to this.
        score = F.sum(F.col("observed") * F.col("observed") / F.col("share")) / total - total
        feature = F.translate(F.concat(F.lit(f"{c}_"), F.col("level").cast("string")), ".", "_")
        scores.append(cells.alias("x").join(share.alias("s"), F.col("x.class").eqNullSafe(F.col("s.class")))
                      .groupBy(feature.alias("feature")).agg(score.alias("score")))
    return reduce(DataFrame.unionByName, scores).orderBy(F.desc("score"), "feature")


def risk_features(df: DataFrame, cut: float) -> DataFrame:
    """The model's features from raw transaction fields, the same in training, batch and stream.

    ``cut`` is the fitted amount above which ``high_amount`` is set. Features of a field that the data lacks are not made.
    """
    made = {"transaction_amount": ("amount", cleaning.number_or_zero), "account_age_days": ("account_age_days", cleaning.number_or_zero),
            "kyc_verified": ("kyc_verified", cleaning.kyc_flag), "channel": ("channel", cleaning.channel_name)}
    ready = df.withColumns({name: of(F.col(field)) for field, (name, of) in made.items() if field in df.columns})
    if "timestamp" in df.columns:
        ready = time_features(ready)
    if "amount" in ready.columns:
        ready = high_amount_night(high_amount(ready.withColumn("log_amount", log_amount(F.col("amount"))), cut=cut))
    return ready


