"""Exact de-duplication with counting quotient filters.

Each input partition files the 64-bit fingerprints of its texts into counting quotient filters, one per range of fingerprints.
Filters of one range merge without loss, since remainders are stored in full and in order. Only fingerprints whose merged
count is above one route their documents to a comparison of all bytes; all others are unique without further work.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from txnrisk.llm.shared import broadcast_few, written
from txnrisk.llm.text import needed, portions, sorted_counts, texts_of

#: Fingerprints that one range is meant to hold; the number of ranges follows the number of rows.
RANGE_ROWS = 1 << 20
LEAST_RANGES = 16


@dataclass
class QuotientFilter:
    """The values of one range. A value's top ``q`` bits are its quotient and its low ``r`` bits its remainder.

    ``occupied`` has a bit for each quotient that holds a value, ``last`` a bit for each stored remainder that ends the run of
    its quotient; ``remainders`` are ascending within a run, ``counts`` their multiplicities. Nothing is lost: ``values`` gives
    back exactly what was put in.
    """

    q: int
    r: int
    occupied: np.ndarray
    last: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """``values``: ascending and distinct, below ``2 ** bits``."""
        q = min(bits, max(3, int(len(values)).bit_length()))
        r = bits - q
        quotients = (values >> np.uint64(r)) if r < 64 else np.zeros(len(values), np.uint64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients.astype(np.int64)] = True
        last = np.append(quotients[1:] != quotients[:-1], True) if len(values) else np.empty(0, bool)
        remainders = values & np.uint64((1 << r) - 1) if r < 64 else values
        return cls(q, r, np.packbits(occupied), np.packbits(last), remainders, counts.astype(np.int64))

    def values(self) -> np.ndarray:
        runs = np.flatnonzero(np.unpackbits(self.occupied)[: 1 << self.q]).astype(np.uint64)
        ends = np.unpackbits(self.last)[: len(self.remainders)]
        run = np.cumsum(ends) - ends
        return (runs[run] << np.uint64(self.r)) | self.remainders if len(self.remainders) else self.remainders

    def pack(self) -> bytes:
        """Header, bits, remainders in as many bytes as they need, counts as one byte with the large ones apart."""
        width = max(1, (self.r + 7) // 8)
        body = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        large = np.flatnonzero(self.counts > 255)
        head = np.array([self.q, self.r, len(self.remainders), len(large)], "<i8").tobytes()
        small = np.where(self.counts > 255, 0, self.counts).astype(np.uint8).tobytes()
        return b"".join((head, self.occupied.tobytes(), self.last.tobytes(), body, small, large.astype("<i8").tobytes(), self.counts[large].astype("<i8").tobytes()))

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        q, r, n, m = np.frombuffer(data, "<i8", 4)
        at = 32

        def take(size: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, size, at)
            at += got.nbytes
            return got

        occupied, last = take((1 << int(q)) + 7 >> 3, "u1"), take(int(n) + 7 >> 3, "u1")
        width = max(1, (int(r) + 7) // 8)
        wide = np.zeros((int(n), 8), np.uint8)
        wide[:, :width] = take(int(n) * width, "u1").reshape(width, int(n)).T
        counts = take(int(n), "u1").astype(np.int64)
        large = take(int(m), "<i8")
        counts[large] = take(int(m), "<i8")
        return cls(int(q), int(r), occupied, last, wide.reshape(-1).view("<u8").astype(np.uint64), counts)


def merged(filters: list[QuotientFilter], bits: int) -> QuotientFilter:
    """One filter for all of them: runs merge by sorted remainders, and equal values add their counts."""
    values = np.concatenate([f.values() for f in filters])
    counts = np.concatenate([f.counts for f in filters])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return QuotientFilter.build(values[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def fingerprinted(docs: DataFrame, keep: list[str], bits: int = 64, with_text: bool = False) -> DataFrame:
    """The ``keep`` columns with ``fp`` (the top ``bits`` of a 64-bit fingerprint), ``text_sha256`` and, if asked for, ``norm``:
    all of the text after lower-casing A-Z; a null text counts as empty."""
    source = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(keep)], F.col("text").cast("binary").alias("t"))
    schema = T.StructType(source.schema.fields[:-1]).add("fp", "long").add("text_sha256", "string")
    schema = schema.add("norm", "binary") if with_text else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "t"):
            texts = [t.lower() for t in texts_of(batch, "t")]
            fps = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)) >> np.uint64(64 - bits)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(fps.view(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = [*(f"c{i}" for i in range(len(keep))), "fp", "text_sha256"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.binary())] if with_text else []), names + ["norm"] * with_text)

    return source.mapInArrow(run, schema)


def repeated_fingerprints(fps: DataFrame, rows: int, bits: int = 64) -> DataFrame:
    """The fingerprints (column ``fp``) that occur more than once, with ``fp_count``. ``rows`` sets the number of ranges."""
    top = min(bits, max(LEAST_RANGES, rows // RANGE_ROWS).bit_length())
    low = bits - top

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        values, counts = sorted_counts(np.concatenate(held) if held else np.empty(0, np.uint64))
        ranges = (values >> np.uint64(low)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        made = defaultdict(list)
        for at, upto in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if upto > at:
                made["range"].append(ranges[at])
                made["filter"].append(QuotientFilter.build(values[at:upto] & np.uint64((1 << low) - 1), counts[at:upto], low).pack())
        yield pa.RecordBatch.from_arrays([pa.array(made["range"], pa.int64()), pa.array(made["filter"], pa.binary())], ["range", "filter"])

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        one = merged([QuotientFilter.unpack(f) for f in group["filter"]], low)
        often = one.counts > 1
        values = one.values()[often] | np.uint64(int(key[0]) << low)
        return pd.DataFrame({"fp": values.view(np.int64), "fp_count": one.counts[often]})

    return fps.select("fp").mapInArrow(filed, "range long, filter binary").groupBy("range").applyInPandas(joined, "fp long, fp_count long")


def copy_groups(docs: DataFrame, marks: DataFrame, bits: int = 64) -> DataFrame:
    """One row for each group of two or more equal texts: fp, text_sha256, keep_id, group_size. ``marks``: the written ``fp`` of all.

    The bytes of all texts in a group are compared through their least and greatest value, which partial aggregates
    reduce before the shuffle, so a text that a third of the rows share is one row per task. Two texts with the same
    SHA-256 but other bytes would end the job with an error.
    """
    often = written(repeated_fingerprints(marks, marks.count(), bits).select("fp"))
    grouped = (
        fingerprinted(docs, ["doc_id"], bits, with_text=True).join(broadcast_few(often), "fp", "left_semi")
        .groupBy("fp", "text_sha256")
        .agg(F.max("c0").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("norm").alias("least"), F.max("norm").alias("most"))
        .filter("group_size > 1")
    )
    same = F.assert_true(F.col("least") == F.col("most"), "two texts share a SHA-256")
    return grouped.filter(same.isNull()).select("fp", "text_sha256", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null equals the empty text. Of equal texts the row with the largest
    doc_id stays (a null doc_id is smaller than any; if all are null, keep_id is null). Of rows repeated with the same doc_id
    and text, one is kept. Empty tables give no rows; other columns are not read.
    """
    docs = needed(docs, "doc_id", "text")
    marks = written(fingerprinted(docs, ["doc_id"], bits).withColumnRenamed("c0", "doc_id").withColumn("row_no", F.monotonically_increasing_id()))
    verified = copy_groups(docs, marks, bits).select("fp", "text_sha256")
    keys = ["fp", "text_sha256"]
    picked = (
        marks.join(verified, keys, "left_semi").groupBy(*keys)
        .agg(F.max(F.struct("doc_id", -F.col("row_no"))).alias("best"), F.count(F.lit(1)).alias("size"))
        .select(*keys, "size", F.col("best.doc_id").alias("best_id"), (-F.col("best.col2")).alias("best_row"))
    )
    known = marks.join(picked, keys, "left")
    alone = F.col("size").isNull()
    return known.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("best_row"))).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; of rows repeated with the kept id and text, one.

    Where the table of groups is small enough to be broadcast, every row is decided in the map; beyond that all rows are shuffled
    once. Null counts as the empty text, and a null id is kept only where its group has no other. Empty tables give no rows.
    """
    keys, narrow = ["fp", "text_sha256"], needed(docs, "doc_id", "text")
    marks = written(fingerprinted(narrow, ["doc_id"], bits).withColumnRenamed("c0", "doc_id"))
    groups = written(copy_groups(narrow, marks, bits))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    often = written(marks.join(broadcast_few(groups), keys).filter(stays).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    marked = fingerprinted(whole, ["row"], bits).withColumnRenamed("c0", "row")
    once = broadcast_few(written(groups.join(often, keys, "left").select(*keys, "keep_id", F.col("n").isNotNull().alias("again"))))
    alone = F.col("again").isNull() | (F.col("row.doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again"))
    kept = marked.join(once, keys, "left").filter(alone).select("row.*")
    if often.isEmpty():
        return kept
    # Only groups whose kept id occurs more than once are looked at again.
    more = marked.join(once.filter("again"), keys).filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    return kept.unionByName(more.dropDuplicates(keys).select("row.*"))
