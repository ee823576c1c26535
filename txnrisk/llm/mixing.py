"""Mixing sources to target weights by weighted sampling without replacement.

Efraimidis-Spirakis sampling: every document gets an exponential key, scaled by its quality weight, and within a source the
documents are taken in the order of their keys until the source's token budget is reached. A source whose target exceeds its
size gives complete epochs first; only the remaining fraction of an epoch is selected by keys. The cut-off key of a source is
found through histograms of key ranges, so no task ever sorts a whole source. A document that is too long for what is left of
the budget is passed over, and those behind it that still fit are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import ArrowUDFType

from txnrisk.llm.shared import written
from txnrisk.llm.text import needed, portions, texts_of

#: Key ranges that a level of refinement counts in each source.
RANGES = 1024
LEVELS = 2
#: Documents of a source that a round goes through one after another, once the first document is too long (twice that at most,
#: rows with equal keys aside, which count as one).
AT_ONCE = 1024
#: Refinements of a key range after which all keys in it are equal.
FINEST = 6
#: Above every u.
END = 2.0
#: Bytes that count as letters for the quality weight: ASCII letters and all of UTF-8's other bytes.
LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
NO_LETTERS = bytes(b for b in range(256) if b not in LETTERS)


def letter_share(text: bytes) -> float:
    """The default quality weight, from 0.25 to 1: how much of the text, spaces apart, is letters."""
    seen = sum(map(len, text.split()))
    return 0.25 + 0.75 * (len(text.translate(None, NO_LETTERS)) / seen if seen else 0.0)


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight; a share stops at ``most`` times the source's size, and the excess is shared again by
    weight among the others until none is above."""
    done: dict = {}
    open_ = {s for s in sizes if sizes[s] > 0}
    while open_:
        left, weight = total - sum(done.values()), sum(weights[s] for s in open_)
        above = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        done |= {s: float(most * sizes[s]) for s in above} if above else {s: left * weights[s] / weight for s in open_}
        open_ = open_ - above if above else set()
    return {s: done.get(s, 0.0) for s in sizes}


def cyclic_weights(sources: list) -> dict:
    """1, 2, 3 and again, in code point order, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}


def sizes_and_keys(batch: pa.RecordBatch, quality: Callable[[bytes], float], seed: int) -> tuple[pa.Array, pa.Array]:
    """``size`` and ``u`` of documents with the columns id and t."""
    texts, ids = texts_of(batch, "t"), batch.column("id").to_pylist()
    size = [len(t.split()) for t in texts]
    r = np.array([(xxhash.xxh3_64_intdigest(t, seed) ^ xxhash.xxh3_64_intdigest(str(i), seed + 1)) + 1 for t, i in zip(texts, ids, strict=True)], float) / 2.0**64
    key = -np.log(r) / np.array([max(quality(t), 1e-9) for t in texts])
    return pa.array(size, pa.int64()), pa.array(key / (1 + key))


def keyed(docs: DataFrame, carry: list[str], quality: Callable[[bytes], float] = letter_share, seed: int = 0) -> DataFrame:
    """The ``carry`` columns with ``size`` (words) and ``u`` in [0, 1), the exponential key mapped by key / (1 + key).

    The key is -ln(r) / weight, r from a hash of doc_id and text. The map keeps the order, brings the keys into a bounded range,
    and keeps large keys apart, as 1 - exp(-key) would not.
    """
    source = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(carry)], F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("t"))
    schema = T.StructType(source.schema.fields[: len(carry)]).add("size", "long").add("u", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "t"):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(carry))], *sizes_and_keys(batch, quality, seed)], schema=None, names=[*(f"c{i}" for i in range(len(carry))), "size", "u"])

    return source.mapInArrow(run, schema)


def key_of(quality: Callable[[bytes], float] = letter_share, seed: int = 0) -> Column:
    """The same ``size`` and ``u`` as a struct beside whole rows: only ids and texts go to the Python workers, and only these two
    numbers come back."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for id_, t in columns:
            parts = [sizes_and_keys(p, quality, seed) for p in portions([pa.RecordBatch.from_arrays([id_, t], ["id", "t"])], "t")]
            size, u = (pa.concat_arrays(x) for x in zip(*parts)) if parts else (pa.array([], pa.int64()), pa.array([], pa.float64()))
            yield pa.StructArray.from_arrays([size, u], ["size", "u"])

    # Called so, it is computed once a row; a filter on its result would move below it with a call of its own.
    key = F.arrow_udf(run, "size long, u double", ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return key(F.col("doc_id").cast("string"), F.col("text").cast("binary"))


def cut_offs(marks: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source: ``cut`` (documents with a smaller u are taken), ``spans`` (of those behind it, the ones with a u from ``low`` to
    below ``high`` and a size of at most ``most`` are taken) and ``extra`` (the u of one more document, or null).

    ``marks``: source, size, u. ``budgets``: source, budget. Each level counts words in ranges of u and goes on in the range in
    which the budget runs out, so what is sorted at the end is a millionth part of a source. From there on documents that are
    too long are passed over. Of the documents not taken, the one whose size comes nearest to what is left of the budget (ties:
    smaller u) is taken too, if that comes nearer to the budget.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    for _ in range(LEVELS):
        m, s = marks.alias("m"), state.alias("s")
        inside = m.join(s, F.col("m.source").eqNullSafe(F.col("s.source")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("width")))
        place = F.least(F.floor((F.col("u") - F.col("low")) / F.col("width") * RANGES), F.lit(RANGES - 1))
        counted = inside.groupBy(F.col("s.source").alias("source"), "left", "low", "width", place.alias("place")).agg(F.sum("size").alias("words"))
        by = Window.partitionBy("source").orderBy("place")
        run = counted.withColumn("before", F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # The first range in which the budget runs out; if all fit, the last one.
        crossing = run.filter(F.col("before") <= F.col("left")).groupBy("source", "left", "low", "width").agg(F.max(F.struct("place", "before")).alias("at"))
        state = crossing.select("source", (F.col("left") - F.col("at.before")).alias("left"), (F.col("low") + F.col("at.place") * F.col("width") / RANGES).alias("low"), (F.col("width") / RANGES).alias("width"))
    s = state.alias("s")
    inside = marks.alias("m").join(s, F.col("m.source").eqNullSafe(F.col("s.source")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("width")))
    by_key = inside.groupBy(F.col("s.source").alias("source"), "left", "low", "width", "u").agg(F.sum("size").alias("words"))
    run = by_key.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("u")))
    cut = run.groupBy("source", "left", "low", "width").agg(
        F.min(F.when(F.col("upto") > F.col("left"), F.col("u"))).alias("over"), F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("used"),
    ).select("source", F.coalesce("over", F.col("low") + F.col("width")).alias("cut"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("gap"))
    cut = written(budgets.select("source").alias("b").join(cut.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")), "left").select(F.col("b.source").alias("source"), "cut", "gap"))
    # A cut at the end of the last range may leave documents above it only by rounding; they count as not taken yet.
    cut = docs_behind(marks, cut)
    m, c = marks.alias("m"), cut.alias("c")
    taken = in_spans(F.col("u"), F.col("size"), F.col("spans"))
    rest = m.join(c, F.col("m.source").eqNullSafe(F.col("c.source")) & (F.col("u") >= F.col("cut")) & (F.col("size") <= 2 * F.col("gap")) & ~taken)
    units = rest.groupBy(F.col("c.source").alias("source"), "gap", "u").agg(F.sum("size").alias("words"))
    near = units.groupBy("source", "gap").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "u")).alias("best"))
    near = near.filter(F.col("best.off") < F.col("gap")).select("source", F.col("best.u").alias("extra")).alias("n")
    return c.join(near, F.col("c.source").eqNullSafe(F.col("n.source")), "left").select(F.col("c.source").alias("source"), "cut", "spans", "extra")


SPANS = "array<struct<low: double, high: double, most: double>>"


def in_spans(u: Column, size: Column, spans: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: (u >= s["low"]) & (u < s["high"]) & (size <= s["most"])), F.lit(False))


def docs_behind(marks: DataFrame, cut: DataFrame) -> DataFrame:
    """source, cut, spans and what is left of ``gap`` after the documents behind the cut that still fit, in the order of u.

    A round takes the next documents that are not longer than the gap, up to the key that ``next_ends`` finds, and goes through
    them one by one. As the gap falls, fewer documents come into question; the last round meets none. Rows with the same u are
    taken together or not at all. What comes back to the driver is a row per source, like the mix itself.
    """
    spark = marks.sparkSession
    state = {r["source"]: [r["cut"], r["gap"], []] for r in cut.collect() if r["cut"] is not None}
    at = {source: start for source, (start, _, _) in state.items()}
    while at:
        now = spark.createDataFrame([(s, u, state[s][1]) for s, u in at.items()], "of string, at double, gap double")
        fit = joined(marks.filter("size > 0"), now).filter((F.col("u") >= F.col("at")) & (F.col("size") <= F.col("gap")))
        ends = next_ends(fit, at)
        if not ends:
            break
        few = joined(fit.drop("of"), spark.createDataFrame(list(ends.items()), "of string, end double")).filter(F.col("u") < F.col("end"))
        units = few.groupBy("source", "at", "gap", "end", "u").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
        # Where rounding has put the end before the first row, the next round goes on from there.
        at = {s: end for s, end in ends.items() if end < END}
        for r in units.groupBy("source").applyInPandas(one_by_one, f"source string, gap double, spans {SPANS}").collect():
            held = state[r["source"]]
            held[1] = r["gap"]
            held[2] += [tuple(x) for x in r["spans"]]
            if r["gap"] < 1:
                at.pop(r["source"], None)
    return spark.createDataFrame([(s, u, gap, spans) for s, (u, gap, spans) in state.items()], f"source string, cut double, gap double, spans {SPANS}")


def joined(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` (source) with what ``of``, which has a row per source, says of theirs; null is a source too."""
    return rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("of")))


def next_ends(rows: DataFrame, at: dict) -> dict:
    """Per source of ``rows`` (source, u) the key below which lie at least ``AT_ONCE`` of its rows and at most twice as many, or
    ``END`` if it hasn't so many.

    The range of keys in which the count reaches ``AT_ONCE`` is cut into ranges again until it adds few enough, so the rows up to
    the end don't grow with the source. Only keys equal to the last digits can add more.
    """
    spark, ends = rows.sparkSession, {}
    open_ = {source: (low, 1.0, 0) for source, low in at.items()}  # from, to, rows before
    for level in range(FINEST):
        if not open_:
            break
        ranges = spark.createDataFrame([(s, *r) for s, r in open_.items()], "range_of string, low double, high double, before long")
        inside = rows.select("source", "u").join(F.broadcast(ranges), F.col("source").eqNullSafe(F.col("range_of")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        place = F.least(F.floor((F.col("u") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
        # At most RANGES rows per source.
        counted = inside.groupBy("source", "before", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
        counted = counted.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("place")))
        reached = F.min(F.when(F.col("upto") >= AT_ONCE, F.struct("place", "upto", "n")))
        found, open_, tried = counted.groupBy("source").agg(reached.alias("at")).collect(), {}, open_
        for r in found:
            low, high, _ = tried[r["source"]]
            if r["at"] is None:
                ends[r["source"]] = high if level else END
                continue
            place, upto, n = r["at"]
            width = (high - low) / RANGES
            below, above = low + place * width, high if place == RANGES - 1 else low + (place + 1) * width
            if upto <= 2 * AT_ONCE or level == FINEST - 1 or not low <= below < above:
                ends[r["source"]] = max(above, float(np.nextafter(below, END)), float(np.nextafter(at[r["source"]], END)))
            else:
                open_[r["source"]] = (below, above, upto - n)
        # Rounding may have left a range without the rows that were counted in it.
        ends |= {s: high for s, (_, high, _) in tried.items() if level and s not in open_ and s not in ends}
    return {s: END if end >= 1.0 else end for s, end in ends.items()}


def one_by_one(units: pd.DataFrame) -> pd.DataFrame:
    """The spans in which documents of one source are taken, and what they leave of the gap."""
    units = units.sort_values("u")
    first = units.iloc[0]
    low, most, left, spans = float(first["at"]), float(first["gap"]), float(first["gap"]), []
    for u, words, size in zip(units["u"].tolist(), units["words"].tolist(), units["size"].tolist(), strict=True):
        if size > most:
            continue
        if words <= left:
            left -= words
        else:
            spans.append({"low": low, "high": u, "most": most})
            low, most = float(np.nextafter(u, END)), left
    spans.append({"low": low, "high": float(first["end"]), "most": most})
    return pd.DataFrame({"source": [first["source"]], "gap": [left], "spans": [spans]})


def plan(docs: DataFrame, quality: Callable[[bytes], float] = letter_share, weights: Callable[[list], dict] = cyclic_weights, total: float = 1.0, most: float = 3.0, seed: int = 0) -> DataFrame:
    """Per source: source_size, target, epochs, cut, spans, extra. ``total`` is the share of all words that the mix has.

    The table of sources goes through the driver and to all tasks: a mix has one weight per source, so it is as long as the list
    of weights. The rows of a large source are never brought together.
    """
    marks = written(keyed(docs, ["source"], quality, seed).withColumnRenamed("c0", "source"))
    sizes = {r["source"]: r["size"] or 0 for r in marks.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    wanted = targets(sizes, weights(list(sizes)), total * sum(sizes.values()), most)
    rows = []
    for source, size in sizes.items():
        epochs = int(min(wanted[source] // size, most)) if size else 0
        rows.append((source, int(size), wanted[source], epochs, wanted[source] - epochs * size))
    table = docs.sparkSession.createDataFrame(rows, "source string, source_size long, target double, epochs int, budget double")
    cuts = cut_offs(marks, table.filter("budget >= 0.5").select("source", "budget"))
    t, c = table.alias("t"), cuts.alias("c")
    whole = t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.source", "source_size", "target", "epochs", "cut", "spans", "extra")
    return F.broadcast(docs.sparkSession.createDataFrame(whole.collect(), whole.schema))


def copies(u: Column, size: Column) -> Column:
    """How often the mix takes a document: complete epochs, and once more if its key is before the cut or it still fits."""
    chosen = F.coalesce((u < F.col("cut")) | u.eqNullSafe(F.col("extra")) & F.col("extra").isNotNull() | in_spans(u, size, F.col("spans")), F.lit(False))
    return F.col("epochs") + chosen.cast("int")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken.

    ``size`` counts words (null or empty text: 0), ``taken`` the words that the mix takes, repeats counted; documents are taken
    whole. Null is a source of its own, last in order. A document with size 0 takes nothing. Rows repeated with the same
    doc_id and text have the same key and share their fate. Empty tables give no rows. The same input gives the same mix.
    """
    docs = needed(docs, "doc_id", "source", "text")
    decided = plan(docs, **options).alias("p")
    rows = keyed(docs, ["doc_id", "source"], options.get("quality", letter_share), options.get("seed", 0)).alias("d")
    both = rows.join(decided, F.col("d.c1").eqNullSafe(F.col("p.source")), "left")
    return both.select(F.col("c0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies(F.col("u"), F.col("size"))).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    names = docs.columns
    decided = plan(needed(docs, "doc_id", "source", "text"), **options).alias("p")
    key = key_of(options.get("quality", letter_share), options.get("seed", 0))
    rows = docs.select(F.col("source").alias("of"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), key.alias("key")).alias("d")
    both = rows.join(decided, F.col("d.of").eqNullSafe(F.col("p.source")), "left")
    size, times = F.col("key.size"), copies(F.col("key.u"), F.col("key.size"))
    return both.filter((times > 0) & (size > 0)).select("row", F.explode(F.sequence(F.lit(1), times)).alias("nth")).select("row.*")
