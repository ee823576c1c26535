"""Exact ranks at scale: running sums and quantiles without a global sort in one task.

Both cut the value axis into pieces at approximate quantiles. The cuts only decide how evenly the
work is spread; counts per piece are exact, so the results are exact for any cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from txnrisk.session import broadcast_if_few

# Running sums: pieces of the axis, a power of two. Each holds about 1 / BINS of the distinct values.
_BIN_BITS = 12
BINS = 1 << _BIN_BITS
# The wanted fractions as one text literal: an array of thousands of literals is slow to build.
_CUTS = ",".join(str(i / BINS) for i in range(1, BINS))
_CUT_ACCURACY = 4 * BINS

# Quantiles: the relative rank error of the sketch, and how far around a wanted rank to cut.
_ACCURACY = 50_000
_MARGIN = 2 / _ACCURACY


def _cuts(value: Column) -> Column:
    """BINS - 1 increasing cut points, from a mergeable sketch of bounded size."""
    return F.percentile_approx(value, F.split(F.lit(_CUTS), ",").cast("array<double>"), _CUT_ACCURACY)


def binary_place(value: Column, cuts: Column, bits: int = _BIN_BITS) -> Column:
    """How many of the 2^bits - 1 ascending cuts are <= value, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Add running totals of columns over all rows in ``order``: ``{column: name of its running total}``.

    ``order`` must be a unique number per row (aggregate by it first). Each piece of the axis is
    summed by its own task, from an offset out of the (at most BINS) totals of the pieces before.
    """
    cuts = df.agg(_cuts(F.col(order))).scalar()
    placed = df.withColumn("_cuts", cuts).withColumn("_bin", binary_place(F.col(order), F.col("_cuts"))).drop("_cuts")
    way = F.desc if descending else F.asc
    # One row per piece, so this window over all pieces sorts at most BINS rows.
    before = Window.orderBy(way("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_bin").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("_bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    upto = Window.partitionBy("_bin").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(F.broadcast(offsets), "_bin")
            .withColumns({name: F.col(f"_before_{c}") + F.sum(c).over(upto) for c, name in sums.items()})
            .drop("_bin", *[f"_before_{c}" for c in sums]))


def long_values(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value) rows of the non-null, non-NaN numbers in ``columns``."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return (df.select(*(by or []), F.inline(F.array(*pairs)))
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
                    approx: bool = False, side: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per (by..., column): ``n`` and the array ``quantiles``, linearly interpolated.

    Three column-pruned scans: a sketch places two cuts close around every wanted rank; the pieces
    between the cuts are counted; the few pieces that hold a wanted rank are read out, collapsed
    to distinct values. With ``approx`` the sketch is the answer. ``side`` hints the join with the
    rows per group, where the caller has checked their number already.
    """
    by = by or []
    values, keys = long_values(df, columns, by), [*by, "column"]
    if approx:
        return values.groupBy(*keys).agg(F.count("*").alias("n"),
                                         F.percentile_approx("value", probs, _ACCURACY).alias("quantiles"))
    around = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-_MARGIN, _MARGIN)]
    cuts = [f"cut{i}" for i in range(len(around))]
    sketch = (values.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("value", around, _ACCURACY).alias("cuts"))
              .select(*keys, "n", *[F.get("cuts", F.lit(i)).alias(c) for i, c in enumerate(cuts)]))
    # One sketch row per column and group; the number of groups is checked.
    side = side or broadcast_if_few(df, by)
    piece = reduce(lambda a, b: a + b, [(F.col("value") >= F.col(c)).cast("int") for c in cuts])
    placed = values.join(side(sketch), keys).select(*keys, "value", "n", piece.alias("piece"))

    def position(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    first = F.col("before")
    last = first + F.col("size") - 1
    ranks = F.array(*[f(position(p)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    wanted = F.filter(F.array_distinct(ranks), lambda r: (r >= first) & (r <= last))

    def running(partition: list[str], order: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.sum("size").over(window) - F.col("size")

    pieces = (placed.groupBy(*keys, "piece").agg(F.count("*").alias("size"), F.first("n").alias("n"))
              .withColumn("before", running(keys, "piece"))
              .filter(F.size(wanted) > 0).select(*keys, "piece", F.col("before").alias("start")))
    # At most two pieces per wanted quantile and group.
    found = (placed.join(side(pieces), [*keys, "piece"])
             .groupBy(*keys, "piece", "value").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.first("start").alias("start"))
             .withColumn("before", F.col("start") + running([*keys, "piece"], "value"))
             .select(*keys, "n", "value", F.explode(wanted).alias("rank")))
    # Two entries per wanted quantile.
    at_rank = found.groupBy(*keys).agg(
        F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def interpolated(p: float) -> Column:
        low = F.try_element_at("at", F.floor(position(p)).cast("long"))
        high = F.try_element_at("at", F.ceil(position(p)).cast("long"))
        return low + (high - low) * (position(p) - F.floor(position(p)))

    return at_rank.select(*keys, "n", F.array(*[interpolated(p) for p in probs]).alias("quantiles"))


def fit_quantiles(df: DataFrame, column: str, probs: list[float], approx: bool = False) -> list[float] | None:
    """The quantiles of one column as numbers (None without values), so that what is built from
    them holds plain literals: filters on them reach the scan."""
    row = exact_quantiles(df, [column], probs, approx=approx).first()
    return row and list(row["quantiles"])
