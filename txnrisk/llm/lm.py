"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of all orders up to ``order`` with a uniform share. How they are mixed
depends on how often the longest known context occurs (buckets by powers of two), and the weights of each bucket are learned by
expectation-maximisation on documents that were left out of the counts.

Counting and looking up are one exchange. Documents are packed into blocks; a block sends the distinct n-grams of each key
range as one sorted list; the range adds the lists up and answers with the counts in the order of the list. So an n-gram moves
once per block, not once per token, and the answer needs no keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.shared import written
from txnrisk.llm.text import mixed, needed, portions, remainder, sorted_counts, texts_of, word_hashes

#: Bytes of text in a block, keys in a range.
BLOCK_BYTES, RANGE_KEYS = 8 << 20, 2 << 20
#: Roles of documents: in the counts, left out of them to learn the weights, left out of all learning.
COUNTED, TUNING, HELD_OUT = 0, 1, 2
START, END = word_hashes([b"  ", b" "])  # no word holds a space
#: Steps of the logarithm (base 2) of a ratio of estimates in which the evidence for the weights is counted.
STEP = 1 / 8
LEAST_WEIGHT = 1e-6


def role(doc_id: int | None, folds: int, fold: int, tuning: int) -> int:
    if remainder(doc_id, folds) == fold:
        return HELD_OUT
    return TUNING if remainder(doc_id, folds * tuning) // folds == 0 else COUNTED


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, compressed; ascending values leave little of the upper ones."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def blocks(docs: DataFrame, folds: int, fold: int, tuning: int) -> DataFrame:
    """Rows of (block, role, n_tokens, ids, nulls, lengths, texts): documents of one role, about ``BLOCK_BYTES`` of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = defaultdict(list)
        size: dict[int, int] = defaultdict(int)

        def close(r: int) -> pa.RecordBatch:
            nonlocal made
            ids, texts = zip(*held.pop(r), strict=True)
            size.pop(r)
            made += 1
            row = {
                "block": [f"{part}-{made}"], "role": [r], "n_tokens": [sum(len(t.split()) + 1 for t in texts)],
                "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "nulls": [np.array([i is None for i in ids], np.uint8).tobytes()],
                "lengths": [np.array([len(t) for t in texts], "<i8").tobytes()], "texts": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))],
            }
            return pa.RecordBatch.from_pydict(row, schema=BLOCK)

        for batch in portions(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                r = role(doc_id, folds, fold, tuning)
                if held[r] and size[r] + len(text) > BLOCK_BYTES:
                    yield close(r)
                held[r].append((doc_id, text.lower()))
                size[r] += len(text)
        for r in [r for r in held if held[r]]:
            yield close(r)

    return needed(docs, "doc_id", "text").mapInArrow(run, "block string, role int, n_tokens long, ids binary, nulls binary, lengths binary, texts binary")


BLOCK = pa.schema([("block", pa.string()), ("role", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lengths", pa.binary()), ("texts", pa.binary())])


class Tokens:
    """The tokens of a block: for each document a start, its words and an end; ``keys(n)`` hashes the n-gram that ends at each.
    N-grams that would begin before the start repeat it."""

    def __init__(self, lengths: bytes, texts: bytes):
        whole, at, words, counts = zstandard.ZstdDecompressor().decompress(texts), 0, [], []
        for length in np.frombuffer(lengths, "<i8").tolist():
            found = whole[at : at + length].split()
            words += found
            counts.append(len(found))
            at += length
        self.counts = np.array(counts, np.int64)
        self.starts = np.cumsum(self.counts + 2) - self.counts - 2
        self.hashes = np.empty(int(self.counts.sum()) + 2 * len(counts), np.uint64)
        inner = np.ones(len(self.hashes), bool)
        inner[self.starts] = inner[self.starts + self.counts + 1] = False
        self.hashes[inner], self.hashes[self.starts], self.hashes[self.starts + self.counts + 1] = word_hashes(words), START, END
        self.before = np.arange(-1, len(self.hashes) - 1)
        self.before[self.starts] = self.starts

    def keys(self, n: int) -> np.ndarray:
        key, at = mixed(self.hashes + np.uint64(n)), np.arange(len(self.hashes))
        for _ in range(n - 1):
            at = self.before[at]
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + self.hashes[at])
        return key


def ranges_of(n_tokens: int, order: int) -> int:
    """The number of key ranges, a power of two that follows the number of tokens."""
    return 1 << max(4, int(np.ceil(np.log2(max(1, n_tokens * order / RANGE_KEYS)))))


def requests(packs: DataFrame, order: int, ranges: int) -> DataFrame:
    """For each block, order and key range the sorted distinct keys and how often the block has each."""
    low = np.uint64(64 - (ranges - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Tokens(row["lengths"], row["texts"])
                for n in range(1, order + 1):
                    keys, counts = sorted_counts(tokens.keys(n))
                    cuts = np.searchsorted(keys >> low, np.arange(ranges + 1, dtype=np.uint64))
                    some = [(r, keys[a:b], counts[a:b]) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    for part in iter(lambda some=iter(some): list(islice(some, 256)), []):
                        columns = ([r for r, _, _ in part], [packed(k) for _, k, _ in part], [packed(c.astype("<u4")) for _, _, c in part])
                        fixed = ([row["block"]] * len(part), [row["role"]] * len(part), [n] * len(part))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*fixed, *columns)], ["block", "role", "n", "range", "keys", "counts"])

    schema = "block string, role long, n long, range long, keys binary, counts binary"
    return packs.select("block", "role", "lengths", "texts").mapInArrow(run, schema)


def answered(group: pd.DataFrame) -> pd.DataFrame:
    """Adds up the lists of one key range and order; answers every block in the order of its own list."""
    lists = [unpacked(k, "<u8") for k in group["keys"]]
    roles = group["role"].to_numpy()
    every, sums = None, {}
    learned = [i for i, r in enumerate(roles) if r != HELD_OUT]
    if learned:
        keys = np.concatenate([lists[i] for i in learned])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        every = keys[order][first]
        counts = np.concatenate([unpacked(group["counts"].iloc[i], "<u4") for i in learned]).astype(np.int64)
        tuned = np.concatenate([np.full(len(lists[i]), roles[i] == TUNING) for i in learned])
        sums["all"] = np.add.reduceat(counts[order], first)
        sums["kept"] = np.add.reduceat(np.where(tuned, 0, counts)[order], first)
    made = defaultdict(list)
    for i, (block, keys) in enumerate(zip(group["block"], lists, strict=True)):
        for name in ("all", "kept"):
            if name == "all" or roles[i] == TUNING:
                found = np.zeros(len(keys), "<u4")
                if every is not None:
                    at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
                    found = np.where(every[at] == keys, sums[name][at], 0).astype("<u4")
                made[name].append(packed(found))
            else:
                made[name].append(None)
        made["types"].append(0)
        made["kept_types"].append(0)
    made["types"][0] = 0 if every is None else len(every)
    made["kept_types"][0] = 0 if every is None else int((sums["kept"] > 0).sum())
    return group[["block", "role", "n", "range"]].reset_index(drop=True).assign(**made)


ANSWER = "block string, role long, n long, range long, all binary, kept binary, types long, kept_types long"


def estimates(tokens: Tokens, answers: pd.DataFrame, column: str, order: int, n_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token but the starts: its count, the maximum-likelihood estimates of order 1, 2, ... (a row each; 0 where the
    context is unknown) and how often each context occurs."""
    counts = []
    for n in range(1, order + 1):
        mine = answers[answers["n"] == n].sort_values("range")
        values = np.concatenate([unpacked(x, "<u4") for x in mine[column]]).astype(np.int64)
        keys = tokens.keys(n)
        by = np.argsort(keys)
        number = np.cumsum(np.concatenate(([False], keys[by][1:] != keys[by][:-1])))
        count = np.empty(len(keys), np.int64)
        count[by] = values[number]
        counts.append(count)
    real = np.ones(len(tokens.hashes), bool)
    real[tokens.starts] = False
    contexts = [np.full(int(real.sum()), n_tokens, np.int64)] + [counts[n - 2][tokens.before][real] for n in range(2, order + 1)]
    likely = [c[real] / np.maximum(x, 1) for c, x in zip(counts, contexts, strict=True)]
    return counts[0][real], np.array(likely), np.array(contexts)


def buckets(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the longest known order (1 if no context is known) and the power of two of that context's count."""
    known = np.ones(contexts.shape[1], np.int64)
    for n in range(2, len(contexts) + 1):
        known[(contexts[n - 1] > 0) & (known == n - 1)] = n
    count = np.take_along_axis(contexts, known[None, :] - 1, 0)[0]
    return known, np.where(known > 1, np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def evidence(packs: DataFrame, answers: DataFrame, order: int, n_tokens: int, uniform: float) -> DataFrame:
    """How often each (known, bucket, ratios of the estimates to the uniform share) occurs in the tuning documents."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples():
            tokens = Tokens(row.lengths, row.texts)
            _, likely, contexts = estimates(tokens, right, "kept", order, n_tokens)
            known, bucket = buckets(contexts)
            with np.errstate(divide="ignore"):
                steps = np.where(likely > 0, np.round(np.log2(likely / uniform) / STEP), -(2**15)).astype(np.int64)
            steps[np.arange(1, order + 1)[:, None] > known] = -(2**15)
            cells, counts = np.unique(np.vstack((known, bucket, steps)).T, axis=0, return_counts=True)
            made.append(pd.DataFrame({"cell": [",".join(map(str, c)) for c in cells.tolist()], "n": counts}))
        return pd.concat(made) if made else pd.DataFrame({"cell": pd.Series(dtype=str), "n": pd.Series(dtype=np.int64)})

    tuning = packs.filter(F.col("role") == TUNING).select("block", "lengths", "texts")
    replies = answers.filter(F.col("role") == TUNING).select("block", "n", "range", "kept")
    return tuning.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learned_weights(cells: list[tuple[str, int]], order: int, rounds: int = 50) -> dict[tuple[int, int], np.ndarray]:
    """Weights of the uniform share and of orders 1 to ``known`` in each bucket, by expectation-maximisation over the evidence.
    Buckets without evidence take the weights of the bucket nearest to them, or equal ones."""
    by: dict[tuple[int, int], list] = defaultdict(list)
    for cell, n in cells:
        known, bucket, *steps = map(int, cell.split(","))
        by[known, bucket].append((n, [1.0, *(2.0 ** (s * STEP) if s > -(2**15) else 0.0 for s in steps[:known])]))
    weights = {}
    for key, held in by.items():
        times, ratios = np.array([n for n, _ in held], float), np.array([r for _, r in held])
        w = np.full(ratios.shape[1], 1 / ratios.shape[1])
        for _ in range(rounds):
            share = ratios * w
            w = (times[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / times.sum()
            w = np.maximum(w, LEAST_WEIGHT)
            w /= w.sum()
        weights[key] = w
    for known in range(1, order + 1):
        have = [b for k, b in weights if k == known]
        for bucket in range(64):
            if (known, bucket) not in weights:
                weights[known, bucket] = weights[known, min(have, key=lambda b: (abs(b - bucket), b))] if have else np.full(known + 1, 1 / (known + 1))
    return weights


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = 2, folds: int = 7, fold: int = 2, tuning: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out of all learning (a null id counts as the empty
    text); of the others one in ``tuning`` is first left out of the counts to learn the weights, and then counted too. Tokens
    are the words of the text with A-Z lower-cased, then one end; a null, empty or blank text is the end alone. ``base_score``
    sums log10((c + 1) / (N + V + 1)) over the tokens, ``score`` is the model's log10 probability of the text, which gives
    unseen tokens together the mass of one more type. Repeated rows count as often as they occur and each is scored. Without any
    learning document N and V are 0, and so are the scores. Empty tables give no rows; other columns are not read.
    """
    packs = written(blocks(docs, folds, fold, tuning))
    totals = {r["role"]: r["n"] for r in packs.groupBy("role").agg(F.sum("n_tokens").alias("n")).collect()}
    n_kept, n_all = totals.get(COUNTED, 0), totals.get(COUNTED, 0) + totals.get(TUNING, 0)
    asked = requests(packs, order, ranges_of(sum(totals.values()), order))
    answers = written(asked.groupBy("n", "range").applyInPandas(answered, ANSWER))
    types = answers.filter("n = 1").agg(F.sum("types"), F.sum("kept_types")).first()
    v_all, v_kept = (max(0, (x or 0) - 1) for x in types)  # the start is counted among them, but is no token
    uniform = 1 / (v_all + 1)
    cells = evidence(packs, answers, order, n_kept, 1 / (v_kept + 1)).collect() if totals.get(TUNING) and n_kept else []
    weights = learned_weights([(r["cell"], r["n"]) for r in cells], order)
    table = np.zeros((order + 1, 64, order + 1))
    for (known, bucket), w in weights.items():
        table[known, bucket, : known + 1] = w

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples():
            tokens = Tokens(row.lengths, row.texts)
            count, likely, contexts = estimates(tokens, right, "all", order, n_all)
            known, bucket = buckets(contexts)
            w = table[known, bucket]
            chance = w[:, 0] * uniform + (w[:, 1:] * likely.T).sum(axis=1) if n_all else np.ones(len(count))
            each = tokens.counts + 1
            first = np.cumsum(each) - each
            add = lambda x: np.add.reduceat(x, first)
            ids = np.frombuffer(row.ids, "<i8")
            made.append(pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "held_out": row.role == HELD_OUT, "n_tokens": each, "n_known": add((count > 0).astype(np.int64)), "train_tokens": n_all,
                "base_score": add(np.log10((count + 1) / (n_all + v_all + 1))), "score": add(np.log10(chance)),
            }))
            made[-1].loc[np.frombuffer(row.nulls, np.uint8) > 0, "doc_id"] = pd.NA
        return pd.concat(made)

    texts = packs.select("block", "role", "ids", "nulls", "lengths", "texts")
    replies = answers.select("block", "n", "range", "all")
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, RESULT)
