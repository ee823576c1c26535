"""Packing documents into training sequences by bin completion.

Documents become token pieces in one map. Of the pieces only their lengths matter for packing, and there are at most as many
lengths as a sequence has tokens, so the search works on a histogram of lengths: its size never grows with the data. The search
is bin completion with branch and bound: take the longest piece left, enumerate the undominated ways to fill the rest of its
sequence, least waste first, and go on with what is left; a best-fit solution is the first incumbent, and branches whose waste
bound can't beat the incumbent are cut. Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from txnrisk.llm.shared import written
from txnrisk.llm.text import needed, portions, texts_of
from txnrisk.llm.token_counts import byte_alphabet

LIMIT = 1024
#: Id that ends a document.
END = 2
#: The pre-tokenizer of byte-level vocabularies, and the pattern that it stands for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """The ids that the tokenizer in a file gives a text, little-endian, 4 bytes each.

    For a byte-level vocabulary whose ids follow its merges, the same ids come several times faster from the same file's
    vocabulary taken as ranks (a test holds the two against each other). Texts that hold the string of a special token, and
    all texts of other tokenizers, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.tokenizer, model = Tokenizer.from_file(path), whole["model"]
        self.special = [t["content"] for t in whole.get("added_tokens", [])]
        vocabulary = {k: v for k, v in model.get("vocab", {}).items() if k not in self.special} if model["type"] == "BPE" else {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        plain = whole.get("normalizer") is None and whole.get("pre_tokenizer") == BYTE_LEVEL and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        self.ranks = None
        if plain and [vocabulary.get(m) for m in merged] == list(range(256, 256 + len(merged))):
            back = byte_alphabet()
            ranks = {bytes(back[c] for c in k): v for k, v in vocabulary.items()}
            self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: bytes) -> bytes:
        text = text.decode()
        if self.ranks is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task (``part``) and the rank within it among the
    pieces of the same length (``nth``). Only documents of more than ``limit`` ids are cut; their first piece has the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, part = TextIds(tokenizer_path), np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        closing = np.array([end], "<u4").tobytes()
        for batch in portions(batches):
            owner, piece, start, length, crc, nth = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = ids_of(text) + closing
                n = len(ids) // 4
                at, number, upto = 0, 0, (n - 1) % limit + 1
                while at < n:
                    owner.append(doc_id)
                    piece.append(number)
                    start.append(at)
                    length.append(upto - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * upto]))
                    nth.append(int(seen[upto - at]))
                    seen[upto - at] += 1
                    at, upto, number = upto, upto + limit, number + 1
            kinds = ((owner, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([part] * len(owner), pa.int32()), (nth, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in kinds], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


@dataclass(frozen=True)
class Filling:
    """``times`` sequences that all hold pieces of these lengths: pairs (length, how many), longest first."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def least_sequences(counts: np.ndarray, limit: int) -> int:
    """A lower bound: for each a, pieces above limit - a are alone, those above half are apart, and those from a to half must
    fit into what the latter leave; the greatest of these bounds over all a."""
    size = np.arange(limit + 1)
    number, total = np.append(np.cumsum(counts[::-1])[::-1], 0), np.append(np.cumsum((counts * size)[::-1])[::-1], 0)
    half, best = limit // 2, -(-int(total[0]) // limit)
    a = np.arange(1, half + 1)
    alone, apart = number[limit - a + 1], number[half + 1] - number[limit - a + 1]
    free = apart * limit - (total[half + 1] - total[limit - a + 1])
    small = total[a] - total[half + 1]
    return max(best, int((alone + apart + np.maximum(0, -(-(small - free) // limit))).max(initial=0)))


def best_fit(counts: np.ndarray, limit: int) -> list[Filling]:
    """Best-fit decreasing on the histogram: each length, longest first, goes to the fullest sequences that still take it."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                each = limit // length
                times, over = divmod(left, each)
                for held, n in ((each, times), (over, 1 if over else 0)):
                    if n:
                        group = room.setdefault(limit - held * length, {})
                        group[(length,) * held] = group.get((length,) * held, 0) + n
                break
            group = room[fits]
            held, n = group.popitem()
            take = min(n, left)
            if n > take:
                group[held] = n - take
            if not group:
                del room[fits]
            after = room.setdefault(fits - length, {})
            after[(*held, length)] = after.get((*held, length), 0) + take
            left -= take
    return [filling(held, n) for group in room.values() for held, n in group.items()]


def filling(held: tuple[int, ...], times: int) -> Filling:
    return Filling(tuple((length, held.count(length)) for length in sorted(set(held), reverse=True)), times)


def smeared(lengths: int, waste: int) -> int:
    """Bit s is set if one of the ``lengths`` (a set of bits) is in s..s + waste."""
    covered = 1
    while covered <= waste:
        step = min(covered, waste + 1 - covered)
        lengths |= lengths >> step
        covered += step
    return lengths


def completions(counts: np.ndarray, room: int, most: int | None = None) -> Iterator[tuple[tuple[int, int], ...] | None]:
    """All undominated ways to fill ``room`` with pieces that are there, as (length, how many), least waste first, and of equal
    waste those with the longest pieces first. None stands for a branch that was looked at in vain.

    A set is dominated if a piece left out fits in place of some of its pieces and is at least as long as these together:
    what can be done with the replaced pieces elsewhere can then be done with the set that holds the longer one. The sums that
    the shorter lengths can make are known as bits, so no branch is entered that can't be filled as far as wanted.
    """
    there = [int(x) for x in np.flatnonzero(counts[: room + 1])]
    number, sums, within = [int(counts[x]) for x in there], [1], (2 << room) - 1
    for x, n in zip(there, number, strict=True):
        can, left, step = sums[-1], min(n, room // x), 1
        while left:
            step = min(step, left)
            can |= can << step * x
            left, step = left - step, 2 * step
        sums.append(can & within)

    def ways(upto: int, need: int, waste: int, held: tuple, pieces: int, one: int, more: int, out: int) -> Iterator[tuple | None]:
        """``one`` and ``more``: sums of one and of several held pieces; ``out``: lengths of which a piece is left out."""
        if not need:
            yield held
            return
        for i in range(bisect_right(there, need, 0, upto) - 1, -1, -1):
            if not sums[i + 1] >> need & 1:
                return
            x = there[i]
            # What replaces pieces is longer than x, and of these lengths all that are held are known.
            longer, after = smeared(out, waste), smeared(out >> 1, waste - 1) if waste else 0
            found, single, several = [], one | 1 << x, more
            for n in range(1, min(number[i], need // x) + 1):
                several |= (several | single if n > 1 else several | one) << x
                if several & longer or single & after or (most is not None and pieces + n > most):
                    break
                if sums[i] >> need - n * x & 1:
                    found.append((n, several))
            if not found:
                yield None
            for n, several in reversed(found):
                yield from ways(i, need - n * x, waste, (*held, (x, n)), pieces + n, single, several, out & ~(1 << x) if n == number[i] else out)

    every = sum(1 << x for x in there)
    for total in range(room, 0, -1):
        if sums[-1] >> total & 1:
            yield from ways(len(there), total, room - total, (), 0, 0, 0, every)


#: A branch of a filling that is looked at in vain counts as this part of a step.
LOOK = 64


def complete_bins(counts: np.ndarray, limit: int, nodes: int | None = None, width: int | None = None, most: int | None = None) -> list[Filling]:
    """Fillings that use every piece, in as few sequences as the search finds within ``nodes`` steps.

    One step fills as many sequences alike as the counts allow; half as many, a quarter and so on are tried after all
    fillings. Unless told otherwise, the steps are enough to go down several times through all lengths, and neither the ways
    to fill a sequence (``width``) nor the pieces in one (``most``) are limited. The search stops early when the incumbent
    meets the lower bound, so its result is then proved to be the least.
    """
    nodes = 1500 + 4 * np.count_nonzero(counts) if nodes is None else nodes
    budget = int(nodes) * LOOK
    incumbent = best_fit(counts, limit)
    best, floor = sum(f.times for f in incumbent), least_sequences(counts, limit)

    def steps(left: np.ndarray) -> Iterator[Filling | None]:
        left = left.copy()
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        part, again = 1, True
        while again:
            again, given = False, 0
            for way in completions(left, limit - longest, most):
                if way is None:
                    yield None
                    continue
                lengths = ((longest, way[0][1] + 1), *way[1:]) if way[0][0] == longest else ((longest, 1), *way)
                times = min((int(left[x]) + (x == longest)) // n for x, n in lengths)
                if times >= part:
                    yield Filling(lengths, times // part)
                    again |= times >= 2 * part
                given += 1
                if given == width:
                    break
            if not given:
                yield Filling(((longest, 1),), int(left[longest]) + 1)
            part *= 2

    left, used, path = counts.copy(), 0, []
    trail: list[Iterator[Filling | None]] = [steps(left)] if best > floor else []
    while trail and budget > 0 and best > floor:
        done = next(trail[-1], trail)
        if done is trail:
            trail.pop()
            if path:
                undone = path.pop()
                used -= undone.times
                for length, n in undone.lengths:
                    left[length] += n * undone.times
            continue
        budget -= 1 if done is None else LOOK
        if done is None:
            continue
        for length, n in done.lengths:
            left[length] -= n * done.times
        used += done.times
        path.append(done)
        if not left.any():
            if used < best:
                best, incumbent = used, list(path)
            trail.append(iter(()))
        elif used + least_sequences(left, limit) >= best:
            trail.append(iter(()))
        else:
            trail.append(steps(left))
    return incumbent


def places(fillings: list[Filling]) -> dict[str, np.ndarray]:
    """For each length the ranks from which a filling takes its pieces: columns length, rank, each, sequence, offset."""
    rows, taken, sequence = [], {}, 0
    for f in fillings:
        offset = 0
        for length, each in f.lengths:
            rows.append((length, taken.get(length, 0), each, sequence, offset))
            taken[length] = taken.get(length, 0) + each * f.times
            offset += each * length
        sequence += f.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "each", "sequence", "offset"))} | {"sequences": np.array([sequence])}


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end: int = END, nodes: int | None = None) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Each row is packed on its own, so repeated rows and null ids are packed as often
    as they occur. Empty tables give no rows. Every sequence is gapless from 0 and holds at most ``limit`` ids.
    """
    made = written(pieces(docs, tokenizer_path, limit, end))
    per_task = written(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(limit + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    held = docs.sparkSession.sparkContext.broadcast(places(complete_bins(histogram, limit, nodes)))
    by = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "part", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    ranked = made.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        # One ascending key for (length, rank): the ranks are shifted to follow those of the shorter lengths.
        shift = np.concatenate(([0], np.cumsum(histogram)))
        keys = shift[p["length"]] + p["rank"]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, shift[length] + rank, side="right") - 1
            copy, among = np.divmod(rank - p["rank"][at], p["each"][at])
            added = [pa.array(p["sequence"][at] + copy), pa.array(p["offset"][at] + among * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *added], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
