"""Exact quantiles of a history that grows by partitions, without reading the old partitions whole.

Each partition (a day, say) is summarized once: per column a mergeable sketch, and the exact number of its values between the
sketch's quantiles. A refit merges the sketches to place two cuts around each wanted rank. The stored counts say how many values
lie far below, so only values close to the cuts are read, by a filter of plain numbers that reaches the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from txnrisk.operators.ranks import binary_place, long_values, running_sums
from txnrisk.operators.scaling import Scaler
from txnrisk.session import BROADCAST_ROWS, broadcast_if_few, settled

# The size of a sketch, and a margin that should exceed its relative rank error; exact counts show where it does not.
_SKETCH = 2048
_MARGIN = 0.005
# Pieces of a partition whose values are counted, a power of two.
_PIECE_BITS = 8
_PIECES = 1 << _PIECE_BITS


def summarize(df: DataFrame, columns: list[str], part: str) -> DataFrame:
    """(part, column, n, sketch, cuts, counts), one row per partition and column with known values.

    ``counts[i]`` is the exact number of values with i of the ``cuts`` at or below them. Null and NaN don't count; a null
    partition is one of its own. Partitions don't depend on each other, so the rows of a new one are simply added.
    """
    values = long_values(df, columns, [part])
    at = F.array(*[F.lit(i / _PIECES) for i in range(1, _PIECES)])
    # Sketches draw at random, so what is counted must be counted by the very cuts that are stored.
    sketches = settled(values.groupBy(part, "column").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", _SKETCH).alias("sketch"))
                       .withColumn("cuts", F.kll_sketch_get_quantile_double("sketch", at)))
    side = broadcast_if_few(df, [part], 1000)
    v, s = values.alias("v"), side(sketches.select(F.col(part).alias("of"), F.col("column").alias("name"), "cuts")).alias("s")
    same = F.col(f"v.{part}").eqNullSafe(F.col("s.of")) & (F.col("v.column") == F.col("s.name"))
    placed = v.join(s, same).select("of", "name", binary_place(F.col("value"), F.col("cuts"), _PIECE_BITS).alias("piece"))
    # At most _PIECES entries per row.
    held = (placed.groupBy("of", "name", "piece").agg(F.count("*").alias("size"))
            .groupBy("of", "name").agg(F.map_from_entries(F.collect_list(F.struct("piece", "size"))).alias("sizes")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(_PIECES - 1)), lambda i: F.coalesce(F.try_element_at("sizes", i), F.lit(0)))
    return (sketches.join(held, F.col(part).eqNullSafe(F.col("of")) & (F.col("column") == F.col("name")))
            .select(part, "column", "n", "sketch", "cuts", counts.alias("counts")))


def write_summary(df: DataFrame, columns: list[str], part: str, path: str) -> None:
    """Store the summaries of the partitions in ``df``; a partition that is stored already is replaced, others stay."""
    (summarize(df, columns, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))


def _ranks(n: int, p: float) -> tuple[int, int]:
    return math.floor((n - 1) * p), math.ceil((n - 1) * p)


def _cuts_around(summaries: DataFrame, wanted: list[tuple[str, float]], margin: float) -> dict[tuple[str, float], tuple[float, float]]:
    """For each column and fraction two values that have its rank between them, unless the sketches err by more than the margin."""
    probs = sorted({p for _, p in wanted})
    at = F.array(*[F.lit(min(max(p + side, 0.0), 1.0)) for p in probs for side in (-margin, margin)])
    merged = summaries.groupBy("column").agg(F.kll_merge_agg_double("sketch", _SKETCH).alias("sketch"))
    found = {r["column"]: r["cuts"] for r in merged.select("column", F.kll_sketch_get_quantile_double("sketch", at).alias("cuts")).collect()}
    return {(c, p): (found[c][2 * probs.index(p)], found[c][2 * probs.index(p) + 1]) for c, p in wanted}


def near_values(df: DataFrame, starts: DataFrame, column: str, part: str, low: float, high: float) -> DataFrame:
    """(value, size): the values of ``column`` from each partition's own start up to ``high``, with their numbers."""
    value = F.col(f"`{column}`")
    close = df.filter((value >= F.lit(low)) & (value <= F.lit(high))).select(F.col(part).alias("in"), value.cast("double").alias("value"))
    return (close.join(starts, F.col("in").eqNullSafe(F.col("of")) & (F.col("value") >= F.col("start")))
            .groupBy("value").agg(F.count("*").alias("size")))


def _values_at(near: DataFrame, ranks: tuple[int, int], before: int, low: float) -> list[float] | None:
    """The values at the two ranks, or None if they don't lie in ``near`` from ``low`` upwards."""
    near = near.persist()
    try:
        below, inside, distinct = near.agg(F.coalesce(F.sum(F.when(F.col("value") < low, F.col("size"))), F.lit(0)),
                                 F.coalesce(F.sum(F.when(F.col("value") >= low, F.col("size"))), F.lit(0)), F.count("*")).first()
        first = before + below
        if not first <= ranks[0] <= ranks[1] < first + inside:
            return None
        above = near.filter(F.col("value") >= low)
        # A few values are sorted in one task, more of them piece by piece.
        upto = (above.withColumn("upto", F.sum("size").over(Window.orderBy("value"))) if distinct <= BROADCAST_ROWS
                else running_sums(above, "value", {"size": "upto"})).withColumn("upto", F.col("upto") + F.lit(first))
        # Two rows at most.
        holds = [(F.col("upto") > r) & (F.col("upto") - F.col("size") <= r) for r in ranks]
        rows = upto.filter(holds[0] | holds[1]).select("value", *[h.alias(f"h{i}") for i, h in enumerate(holds)]).collect()
        return [next(r["value"] for r in rows if r[f"h{i}"]) for i in range(2)]
    finally:
        near.unpersist()


def refit(df: DataFrame, summaries: DataFrame, columns: list[str], probs: list[float], part: str) -> dict[str, tuple[int, list[float]]]:
    """Per column with known values their number and the exact quantiles, linearly interpolated, of all partitions in ``summaries``.

    ``df`` is the whole history; of it only values near the wanted ranks are read. Its rows must be those that were
    summarized: a partition without a summary doesn't count. Should the sketches err by more than the margin, which the exact
    counts show, the cuts are placed farther apart. What comes to the driver is a few numbers per column and fraction.
    """
    summaries = summaries.filter(F.col("column").isin(columns))
    n = {r["column"]: r["n"] for r in summaries.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    side = broadcast_if_few(summaries, [part])
    found: dict[tuple[str, float], float] = {}
    open_, margin = [(c, p) for c in columns if c in n for p in probs], _MARGIN
    while open_:
        cuts = _cuts_around(summaries, open_, margin)
        for (c, p), (low, high) in cuts.items():
            place = binary_place(F.lit(low), F.col("cuts"), _PIECE_BITS)
            of_column = summaries.filter(F.col("column") == c).withColumn("place", place)
            starts = of_column.select(F.col(part).alias("of"), F.coalesce(F.get("cuts", F.col("place") - 1), F.lit(-math.inf)).alias("start"),
                                      F.aggregate(F.slice("counts", 1, F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x).alias("before"))
            least, before = starts.agg(F.min("start"), F.sum("before")).first()
            ends = _values_at(near_values(df, side(starts.drop("before")), c, part, least, high), _ranks(n[c], p), before, low)
            if ends:
                found[c, p] = ends[0] + (ends[1] - ends[0]) * ((n[c] - 1) * p - _ranks(n[c], p)[0])
        open_, margin = [w for w in open_ if w not in found], margin * 8
    return {c: (n[c], [found[c, p] for p in probs]) for c in columns if c in n}


def iqr_bounds(df: DataFrame, summaries: DataFrame, column: str, part: str, k: float = 1.5) -> tuple[float | None, float | None]:
    """Bounds for ``clean.outliers`` and ``clean.winsorize``, those of ``clean.iqr_bounds`` over the history."""
    got = refit(df, summaries, [column], [0.25, 0.75], part).get(column)
    if got is None:
        return None, None
    low, high = got[1]
    return low - (high - low) * k, high + (high - low) * k


def fit_robust(df: DataFrame, summaries: DataFrame, columns: list[str], part: str) -> Scaler:
    """The scaler that ``scaling.fit_robust`` fits over the history."""
    found = {c: (q[1], (q[2] - q[0]) or 1.0) for c, (_, q) in refit(df, summaries, columns, [0.25, 0.5, 0.75], part).items()}
    return {c: found.get(c, (0.0, 1.0)) for c in columns}


def high_amount_cut(df: DataFrame, summaries: DataFrame, column: str, part: str, q: float = 0.95) -> float:
    """The cut for ``features.high_amount``; infinite, which flags nothing, without any value."""
    got = refit(df, summaries, [column], [q], part).get(column)
    return got[1][0] if got else math.inf
