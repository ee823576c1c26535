"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Fewer than HOT_KEYS keys can each hold more than 1/HOT_KEYS of the rows, whatever the data.
HOT_KEYS = 1000


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys with more than 1/HOT_KEYS of all rows, as a local frame of fewer than HOT_KEYS rows; None where
    there is none. ``counts`` has the key columns and ``n``; a null key joins nothing and is left out."""
    total = counts.agg(F.sum("n")).scalar()
    known = [F.col(key).isNotNull() for key in on]
    found = counts.filter((F.col("n") * HOT_KEYS > total) & reduce(lambda a, b: a & b, known)).select(*on)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def skew_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Left join of ``left`` to ``right``, where ``right`` is unique on ``on``.

    The rows of hot keys are joined map-side: the few right rows they need are broadcast and their left
    rows never shuffle. All other keys take the ordinary join, which is the whole plan where no key is
    hot. ``counts`` (key columns and ``n``) may be passed where the caller has it already.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in on])
    # Rows without a key join nothing; they go past the join instead of meeting in one of its partitions.
    joined = _keyed_join(left.filter(keyed), right, on, counts)
    return joined.unionByName(left.filter(~keyed), allowMissingColumns=True)


def _keyed_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame | None) -> DataFrame:
    hot = hot_keys(counts if counts is not None else left.groupBy(*on).agg(F.count("*").alias("n")), on)
    if hot is None:
        return left.join(right, on, "left")
    hot = F.broadcast(hot)
    hot_right = F.broadcast(right.join(hot, on, "left_semi"))
    hot_rows = left.join(hot, on, "left_semi").join(hot_right, on, "left")
    return hot_rows.unionByName(left.join(hot, on, "left_anti").join(right, on, "left"))
