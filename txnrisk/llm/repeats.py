"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes that begin at minimisers are kept: of every ``min_words - SEED + 1`` adjacent seeds (runs of ``SEED`` words) the one
with the least hash. The choice depends on the words alone, so a passage of ``min_words`` or more that two documents share has a
minimiser at the same place in both. Suffixes whose seed occurs in one document only are dropped. The others are sorted and each
is compared with its neighbours, which gives the longest match to its right, and matches are extended to the left. A sorted
neighbour need not be the one that matches farthest to the left; so every run of ``min_words`` around a minimiser that the
match to the right still allows is then looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.shared import written
from txnrisk.llm.text import mixed, needed, portions, texts_of, word_hashes

SEED = 8
MIN_WORDS = 50
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def seeds(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the minimisers of a document with these word hashes; ``span`` words around a seed (min_words - SEED)."""
    n = len(hashes) - SEED + 1
    if n < span + 1:
        return np.empty(0, np.int64)
    grams = grams_at(hashes)
    windows = np.lib.stride_tricks.sliding_window_view(grams, span + 1)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def grams_at(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SEED + 1
    made = np.full(n, SEED, np.uint64)
    for i in range(SEED):
        made = mixed(made * GOLDEN + hashes[i : i + n])
    return made


def around(hashes: np.ndarray, places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the ``span`` words to the left (nearest first) and to the right of each seed; 0 beyond the text."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    short[short == 0] = 1
    padded = np.concatenate((np.zeros(span, np.uint32), short, np.zeros(span, np.uint32)))
    steps = np.arange(span)
    return padded[places[:, None] + span - 1 - steps], padded[places[:, None] + span + SEED + steps]


def documents(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """A number for (doc_id, text), the doc_id, and the word hashes of the lower-cased text."""
    texts = [t.lower() for t in texts_of(batch)]
    words = [t.split() for t in texts]
    hashes, at = word_hashes([w for x in words for w in x]), 0
    for doc_id, text, x in zip(batch.column("doc_id").to_pylist(), texts, words, strict=True):
        yield xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(str(doc_id))) >> 1, doc_id, hashes[at : at + len(x)]
        at += len(x)


def arrays(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def seed_owners(docs: DataFrame, span: int) -> DataFrame:
    """(key, least, most): the seeds of each task with the least and the greatest document number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for uid, _, hashes in documents(batch):
                at = seeds(hashes, span)
                if len(at):
                    keys.append(grams_at(hashes)[at])
                    owners.append(np.full(len(at), uid, np.int64))
            key, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
            yield arrays(key=key, least=owner, most=owner)

    return docs.mapInArrow(run, "key long, least long, most long").groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def seed_rows(docs: DataFrame, span: int) -> DataFrame:
    """(key, uid, doc_id, at, n, class): every seed; ``class`` digests the seed with all words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            made = []
            for uid, doc_id, hashes in documents(batch):
                at = seeds(hashes, span)
                if len(at):
                    left, right = around(hashes, at, span)
                    both = np.ascontiguousarray(np.hstack((left, right)))
                    kind = [xxhash.xxh3_64_intdigest(r) for r in both]
                    made.append((grams_at(hashes)[at].view(np.int64), np.full(len(at), uid, np.int64), [doc_id] * len(at), at, np.full(len(at), len(hashes), np.int64), np.array(kind, np.uint64).view(np.int64)))
            if made:
                key, uid, doc_id, at, n, kind = zip(*made, strict=True)
                yield arrays(key=np.concatenate(key), uid=np.concatenate(uid), doc_id=pa.array([d for x in doc_id for d in x], pa.int64()), at=np.concatenate(at), n=np.concatenate(n), kind=np.concatenate(kind))

    return docs.mapInArrow(run, "key long, uid long, doc_id long, at long, n long, kind long")


def suffixes(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(key, right, left, uid, doc_id, at): the suffixes at ``wanted`` places (uid, places) with the words around them."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [t.lower() for t in texts_of(batch)]
            ids = batch.column("doc_id").to_pylist()
            uids = [xxhash.xxh3_64_intdigest(t, xxhash.xxh3_64_intdigest(str(i))) >> 1 for t, i in zip(texts, ids, strict=True)]
            yield arrays(uid=pa.array(uids, pa.int64()), doc_id=pa.array(ids, pa.int64()), text=pa.array(texts, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for (uid, doc_id, hashes), places in zip(documents(batch), batch.column("places").to_pylist(), strict=True):
                at = np.unique(np.array(places, np.int64))
                left, right = around(hashes, at, span)
                yield arrays(key=grams_at(hashes)[at].view(np.int64), right=pa.array([r.astype(">u4").tobytes() for r in right], pa.binary()), left=pa.array([x.astype(">u4").tobytes() for x in left], pa.binary()), uid=np.full(len(at), uid, np.int64), doc_id=pa.array([doc_id] * len(at), pa.int64()), at=at)

    texts = docs.mapInArrow(numbered, "uid long, doc_id long, text binary")
    return texts.join(wanted, "uid").select("uid", "doc_id", "text", "places").mapInArrow(run, "key long, right binary, left binary, uid long, doc_id long, at long")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words two lines of contexts share; nothing is shared beyond the text."""
    differ = np.hstack(((a != b) | (a == 0), np.ones((len(a), 1), bool)))
    return differ.argmax(axis=1)


def neighbours(ordered: DataFrame, span: int, min_words: int) -> DataFrame:
    """For sorted suffixes: ``start`` and ``end`` of the longest match with a neighbour in another document (null if it is too
    short), and the digests of the runs of ``min_words`` that the match to the right allows, with their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            right, left = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(n, span) for c in ("right", "left"))
            key, uid, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "uid", "at"))
            same = key[1:] == key[:-1]
            to_right = np.where(same, common(right[1:], right[:-1]), 0)
            to_left = np.where(same, common(left[1:], left[:-1]), 0)
            # At the edges of a batch the neighbour is elsewhere: any match is possible there.
            most = np.full(n, -1)
            most[1:] = np.where(same, to_right, -1)
            most[:-1] = np.maximum(most[:-1], np.where(same, to_right, -1))
            most[[0, -1]] = span
            begin, finish = at.copy(), at.copy()
            long_ = same & (uid[1:] != uid[:-1]) & (to_right + to_left + SEED >= min_words)
            for side in (slice(1, None), slice(None, -1)):
                better = long_ & (to_left + to_right > finish[side] - begin[side] - SEED)
                begin[side] = np.where(better, at[side] - to_left, begin[side])
                finish[side] = np.where(better, at[side] + SEED + to_right, finish[side])
            # Digests of the words to the left and to the right, growing outwards.
            grow = [np.zeros((n, span + 1), np.uint64), np.zeros((n, span + 1), np.uint64)]
            for total, words in zip(grow, (left, right), strict=True):
                for i in range(span):
                    total[:, i + 1] = mixed(total[:, i] * GOLDEN + words[:, i].astype(np.uint64) + np.uint64(1))
            has_left, has_right = (left != 0).sum(axis=1), (right != 0).sum(axis=1)
            back = np.arange(span + 1)
            open_ = (span - back[None, :] <= most[:, None]) & (back[None, :] <= has_left[:, None]) & (span - back[None, :] <= has_right[:, None])
            row, b = np.nonzero(open_)
            digest = mixed(mixed(key[row].view(np.uint64) * GOLDEN + grow[0][row, b]) + grow[1][row, span - b] + b.astype(np.uint64))
            cuts = np.searchsorted(row, np.arange(n + 1))
            runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(digest.view(np.int64)))
            starts = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[row] - b))
            found = finish > begin
            yield arrays(uid=batch.column("uid"), doc_id=batch.column("doc_id"), start=pa.array(begin, mask=~found), end=pa.array(finish, mask=~found), runs=runs, starts=starts)

    return ordered.mapInArrow(run, "uid long, doc_id long, start long, end long, runs array<long>, starts array<long>")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows doc_id, start_word, end_word, n_words: the longest stretches of a document of which every word lies in a run of
    ``min_words`` words (A-Z lower-cased) that another document has too.

    Words are counted from 0, ``end_word`` is exclusive. Documents without such a passage give no rows; that holds for null,
    empty and shorter texts. Rows repeated with the same doc_id and text are one document. A null doc_id is carried as null.
    Empty tables give no rows; other columns are not read. Words are told apart by their hashes.
    """
    span = min_words - SEED
    if span < 1:
        raise ValueError(f"min_words must be greater than {SEED}")
    docs = needed(docs, "doc_id", "text")
    shared = written(seed_owners(docs, span).filter("least != most").select("key"))
    held = written(seed_rows(docs, span).join(shared, "key"))
    kinds = held.groupBy("key", "kind").agg(F.min("uid").alias("first"), F.max("uid").alias("last"))
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = written(kinds.join(several, "key"))
    marked = held.join(kinds, ["key", "kind"])
    # Suffixes that agree in all words around the seed match as far as is looked at.
    whole = marked.filter("first != last").select("uid", "doc_id", F.greatest(F.col("at") - span, F.lit(0)).alias("start"), F.least(F.col("at") + SEED + span, F.col("n")).alias("end"))
    wanted = marked.filter("kinds > 1 AND (first = last OR uid = first)").groupBy("uid").agg(F.collect_set("at").alias("places"))
    table = written(suffixes(docs, written(wanted), span))
    parts = max(1, table.count() // 50_000)
    ordered = table.repartitionByRange(parts, "key", "right", "uid").sortWithinPartitions("key", "right", "uid")
    near = written(neighbours(ordered, span, min_words))
    extended = near.filter("start IS NOT NULL").select("uid", "doc_id", "start", "end")
    runs = near.select("uid", "doc_id", F.explode(F.arrays_zip("runs", "starts")).alias("run")).select("uid", "doc_id", F.col("run.runs").alias("digest"), F.col("run.starts").alias("start"))
    again = runs.groupBy("digest").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).filter("first != last").select("digest")
    looked_up = runs.join(again, "digest", "left_semi").select("uid", "doc_id", "start", (F.col("start") + min_words).alias("end"))
    every = whole.unionByName(extended).unionByName(looked_up)
    # A span is one number, so that a document's spans are a flat list.
    packed = (F.shiftleft("start", 32) + F.col("end")).alias("span")
    grouped = every.select("uid", "doc_id", packed).groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.collect_set("span").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("spans")
            spans = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((spans, row))
            row, start, end = row[order], spans[order] >> 32, spans[order] & 0xFFFFFFFF
            # Shifted by document, the greatest end so far never reaches into the next document.
            reach = np.maximum.accumulate(end + (row << 33))
            first = np.flatnonzero(np.concatenate(([True], start[1:] + (row[1:] << 33) > reach[:-1])))
            last = np.append(first[1:], len(row)) - 1
            a, b = start[first], reach[last] - (row[first] << 33)
            yield arrays(doc_id=batch.column("doc_id").take(pa.array(row[first])), start_word=pa.array(a), end_word=pa.array(b), n_words=pa.array(b - a))

    return grouped.select("doc_id", "spans").mapInArrow(run, "doc_id long, start_word long, end_word long, n_words long")
