"""Column profiles: the numbers behind an exploratory look at the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from txnrisk.functions.cleaning import known
from txnrisk.operators.ranks import exact_quantiles, long_values
from txnrisk.session import broadcast_if_few

FIRST_ROWS = 5


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def shape_and_columns(df: DataFrame) -> DataFrame:
    """(position, column, type, rows, columns), one row per column."""
    names = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"))
             for i, (name, kind) in enumerate(df.dtypes)]
    return df.agg(F.count("*").alias("rows")).select(
        F.inline(F.array(*names)), "rows", F.lit(len(names)).alias("columns"))


def head(df: DataFrame, order: str, n: int = FIRST_ROWS) -> DataFrame:
    return df.orderBy(order).limit(n)


def _unpivot(one: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """A one-row aggregate with columns ``<field>_<column>`` as one row per column."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{c}").cast(t).alias(f) for f, t in fields.items()])
            for c in columns]
    return one.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per numeric column: count, mean, sample standard deviation, min, quartiles, max."""
    columns = columns or numeric_columns(df)
    aggs = []
    for c in columns:
        value = known(F.col(c))
        aggs += [F.count(value).alias(f"count_{c}"), F.avg(value).alias(f"mean_{c}"),
                 F.stddev_samp(value).alias(f"std_{c}"), F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
    moments = _unpivot(df.agg(*aggs), columns, {"count": "long", "mean": "double", "std": "double",
                                                "min": "double", "max": "double"})
    # One row per column on both sides.
    quartiles = F.broadcast(exact_quantiles(df, columns, [0.25, 0.5, 0.75], approx=approx))
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", F.get("quantiles", F.lit(0)).alias("q25"),
        F.get("quantiles", F.lit(1)).alias("q50"), F.get("quantiles", F.lit(2)).alias("q75"), "max")


def null_counts(df: DataFrame) -> DataFrame:
    """Per column the rows without a value; NaN is none."""
    floating = {c for c, kind in df.dtypes if kind in ("double", "float")}
    missing = {c: F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull() for c in df.columns}
    one = df.agg(*[F.count_if(m).alias(f"nulls_{c}") for c, m in missing.items()])
    return _unpivot(one, df.columns, {"nulls": "long"})


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def class_balance(df: DataFrame, label: str = "is_fraud", normalize: bool = False) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    return counts.withColumn("ratio", F.col("count") / df.agg(F.count("*")).scalar()) if normalize else counts


def count_by(df: DataFrame, column: Column | str, label: str = "is_fraud", name: str = "level") -> DataFrame:
    """Counts per (level, label) with the level's total; most frequent level first."""
    level = F.col(column) if isinstance(column, str) else column
    pairs = df.groupBy(level.alias(name), label).agg(F.count("*").alias("count"))
    # A window partition holds one row per label of its level.
    total = F.sum("count").over(Window.partitionBy(name))
    return pairs.withColumn("level_total", total).orderBy(F.desc("level_total"), name, label)


def count_by_columns(df: DataFrame, columns: list[str], label: str = "is_fraud") -> DataFrame:
    """``count_by`` for several columns in one scan: (field, level as text, label, count, level_total)."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("level")) for c in columns]
    counts = (df.select(F.inline(F.array(*pairs)), label).groupBy("field", "level", label).agg(F.count("*").alias("count")))
    total = F.sum("count").over(Window.partitionBy("field", "level"))
    return counts.withColumn("level_total", total).orderBy("field", F.desc("level_total"), "level", label)


def count_by_hour(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    return df.groupBy(F.hour("timestamp").alias("hour"), label).agg(F.count("*").alias("count"))


def box_stats(df: DataFrame, columns: list[str], by: str = "is_fraud", k: float = 1.5) -> DataFrame:
    """Per column and group: quartiles, the last values inside k times the quartile distance, and how many lie outside."""
    keys, side = ["column", by], broadcast_if_few(df, [by])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], [by], side=side).select(
        *keys, *[F.get("quantiles", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])
    reach, value = (F.col("q3") - F.col("q1")) * k, F.col("value")
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    return (long_values(df, columns, [by]).join(side(quartiles), keys).groupBy(*keys)
            .agg(F.first("q1").alias("q1"), F.first("q2").alias("median"), F.first("q3").alias("q3"),
                 F.min(F.when(inside, value)).alias("whisker_low"), F.max(F.when(inside, value)).alias("whisker_high"),
                 F.count_if(~inside).alias("outliers")))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; a single value gets a range of width 1."""
    value = known(F.col(column))
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    flat = edges["lo"] == edges["hi"]
    low = F.when(flat, edges["lo"] - 0.5).otherwise(edges["lo"])
    width = F.when(flat, F.lit(1.0)).otherwise(edges["hi"] - edges["lo"]) / bins
    counts = (df.filter(value.isNotNull())
              .groupBy(F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("long").alias("bin"))
              .agg(F.count("*").alias("n")))
    # One row per bin, filled or empty.
    return (df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left")
            .select("bin", (low + F.col("bin") * width).alias("lower"), (low + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("n", F.lit(0)).alias("count")))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, over rows where both are known; null for a constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    one = df.agg(*[F.corr(known(F.col(a)), known(F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        value = F.col(f"r{i}")
        value = F.when(~F.isnan(value), value)
        rows += [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), value.alias("corr"))
                 for x, y in ({(a, b), (b, a)})]
    return one.select(F.inline(F.array(*rows)))
