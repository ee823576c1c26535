"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A broadcast side may hold at most this many (narrow, aggregated) rows.
BROADCAST_ROWS = 10_000


def use_utc(spark: SparkSession) -> SparkSession:
    """All hour, weekday and day boundaries in this package are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = 8, app: str = "txnrisk", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def broadcast_if_few(df: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """``F.broadcast`` for frames with about one row per distinct key of ``df``, if there are few; else no hint.

    The check reads the key columns only and counts at most ``max_rows + 1`` keys. Unhinted joins
    shuffle, and adaptive execution splits their skewed partitions.
    """
    few = not keys or df.select(*keys).distinct().limit(max_rows + 1).count() <= max_rows
    return F.broadcast if few else lambda side: side


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions are evaluated once per row.

    The optimizer replaces a column by its expression wherever a filter uses it, so a filter on a column
    built in many steps evaluates every step many times over. A generator of one row stops that; filters
    on other columns still move below it, and unused columns around it are still pruned.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores: what a fit reads many times shouldn't sit in the few partitions of a small file."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the cluster names; keep the lineage where none is named."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if named else df


def settled(df: DataFrame) -> DataFrame:
    """Few rows that would come out differently if they were computed again, computed once: in the shared folder, or, where none
    is named, by way of the driver."""
    kept = cut_lineage(df)
    return kept if kept is not df else df.sparkSession.createDataFrame(df.collect(), df.schema)
