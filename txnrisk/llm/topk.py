"""Exact top-k search by inner product, by distributed histogram selection.

For a block of queries, every task scores all of its rows and counts the scores in ranges; the counts of all tasks together say
in which range each query's k-th score lies. That range is divided and counted again until it is a single value. Then one
more pass keeps the scores above the k-th value and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from txnrisk.llm.shared import shared_folder

#: Queries searched together: their vectors are what is broadcast, so its size doesn't depend on the data.
BLOCK = 1024
#: Ranges that a pass divides an interval into, and rows scored at a time.
RANGES, ROWS = 512, 2048


def vectors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled vectors of the rows that take part, shorter vectors filled up with zeros."""
    column = batch.column("vector")
    flat = column.flatten()
    lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = ~np.asarray(column.is_null()) & ~np.asarray(batch.column("vec_id").is_null())
    good[owner[~np.isfinite(values)]] = False
    wide = np.zeros((len(lengths), int(lengths.max(initial=0))))
    within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fine = good[owner]
    wide[owner[fine], within[fine]] = np.floor(scale * values[fine])
    ids = batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[good], wide[good]


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products, a line per query. Doubles are exact below 2 ** 53, by the bound on the vectors' lengths."""
    width = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :width], queries[:, :width]
    bound = np.sqrt((rows**2).sum(axis=1).max(initial=0)) * np.sqrt((queries**2).sum(axis=1).max(initial=0))
    if bound >= 2.0**62:
        raise OverflowError("an inner product may not fit into 64 bits")
    if bound < 2.0**52:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def scored(batches: Iterator[pa.RecordBatch], queries: tuple[np.ndarray, np.ndarray], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, scores and what may be counted (all but a query's own id) of some rows at a time."""
    query_ids, matrix = queries
    for batch in batches:
        ids, wide = vectors(batch, scale)
        for at in range(0, len(ids), ROWS):
            some = ids[at : at + ROWS]
            yield some, scores(wide[at : at + ROWS], matrix), query_ids[:, None] != some[None, :]


def block_queries(rows: DataFrame, chosen, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The query vectors of one block, by ascending id; of rows with the same id the first by its vector."""
    got = rows.filter(chosen).toArrow()
    parts = [vectors(b, scale) for b in got.to_batches()]
    width = max((m.shape[1] for _, m in parts), default=0)
    held: dict[int, tuple] = {}
    for ids, wide in parts:
        for i, v in zip(ids.tolist(), np.pad(wide, ((0, 0), (0, width - wide.shape[1]))).tolist(), strict=True):
            held[i] = min(held.get(i, tuple(v)), tuple(v))
    order = sorted(held)
    return np.array(order, np.int64), np.array([held[i] for i in order]).reshape(len(order), width)


def search_block(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int, scale: int, longest: float) -> DataFrame:
    """The k best rows for each of the queries."""
    context, n = rows.sparkSession.sparkContext, len(queries[0])
    sent = context.broadcast(queries)
    reach = np.ceil(np.sqrt((queries[1] ** 2).sum(axis=1)) * longest).astype(np.int64) + 1
    low, width, above = -reach, 2 * reach + 1, np.zeros(n, np.int64)  # the k-th score is in [low, low + width); above: scores beyond
    enough = np.ones(n, bool)
    while (open_ := enough & (width > 1)).any():
        step = -(-width // RANGES)
        state = context.broadcast((low, width, step, open_, above))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            low, width, step, open_, above = state.value
            counts = np.zeros((n, RANGES), np.int64)
            line = np.arange(n, dtype=np.int64)[:, None] * RANGES
            for _, score, may in scored(batches, sent.value, scale):
                inside = may & open_[:, None] & (score >= low[:, None]) & (score < (low + width)[:, None])
                place = line + (score - low[:, None]) // step[:, None]
                counts += np.bincount(place[inside], minlength=n * RANGES).reshape(n, RANGES)
            # Ranges below the task's own k-th score can't hold the k-th of all, so they need not be sent.
            beyond = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            query, place = np.nonzero((counts > 0) & (beyond < (k - above)[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(place), pa.array(counts[query, place])], ["query", "place", "n"])

        counted = rows.mapInArrow(count, "query long, place long, n long").groupBy("query", "place").agg(F.sum("n").alias("n"))
        run = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("place"))))
        gone = context.broadcast((k - above).tolist())
        need = F.array(*[F.lit(int(x)) for x in gone.value])
        found = run.filter(F.col("upto") >= need[F.col("query").cast("int")]).groupBy("query").agg(F.max(F.struct("place", (F.col("upto") - F.col("n")).alias("beyond"))).alias("at"))
        at = {r["query"]: (r["at"]["place"], r["at"]["beyond"]) for r in found.collect()}
        for q in np.flatnonzero(open_):
            if q in at:
                place, beyond = at[q]
                low[q], above[q] = low[q] + place * step[q], above[q] + beyond
                width[q] = step[q]
            else:  # fewer than k rows in all: every score counts
                enough[q] = False
    cut = context.broadcast(np.where(enough, low, np.iinfo(np.int64).min))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0, np.int64),) * 3]
        for ids, score, may in scored(batches, sent.value, scale):
            query, row = np.nonzero(may & (score > cut.value[:, None]))
            kept.append((query, ids[row], score[query, row]))
            # Of those equal to the k-th value, at most k of a task can be among the best.
            query, row = np.nonzero(may & (score == cut.value[:, None]))
            order = np.lexsort((ids[row], query))
            query, row = query[order], row[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            kept.append((query[nth < k], ids[row[nth < k]], score[query[nth < k], row[nth < k]]))
        query, ids, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[0][query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    passed = rows.mapInArrow(keep, "query_id long, vec_id long, score long")
    return passed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, is_query, k: int = 10, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of greatest inner product for each row that ``is_query`` (a condition on vec_id) picks, itself excluded.

    ``embeddings`` has vec_id and a vector of numbers, whose components become floor(scale * x). Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id, and all rows are returned if there are fewer than ``k``. Rows whose vec_id or
    vector is null, or whose vector holds a null or non-finite component, take no part. A shorter vector is filled up with
    zeros. Rows with the query's own vec_id are never among its results; other repeated rows are results of their own; of
    queries repeated with the same vec_id one is searched. Empty tables give no rows; other columns are not read.

    Queries are searched in blocks of bounded size against all rows, so nothing that is sent to tasks grows with the data, and
    no row is shuffled: only counts and results are.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [float(np.sqrt((vectors(b, scale)[1] ** 2).sum(axis=1).max(initial=0))) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([max(most, default=0.0)])], ["most"])

    longest = rows.mapInArrow(lengths, "most double").agg(F.max("most")).first()[0] or 0.0
    wanted = is_query(F.col("vec_id"))
    blocks = max(1, -(-rows.filter(wanted).select("vec_id").count() // BLOCK))
    folder = shared_folder(spark)
    for block in range(blocks):
        queries = block_queries(rows, wanted & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block), scale)
        if len(queries[0]):
            search_block(rows, queries, k, scale, longest).write.mode("append").parquet(folder)
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
