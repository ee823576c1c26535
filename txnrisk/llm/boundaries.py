"""Fill-in-middle: texts cut in three at code point boundaries, and put together in another order.

The byte offsets at which code points begin (and the end of the text) form a set of integers, held like a Roaring bitmap: one
container for each 65,536 offsets, which is a sorted array, a bitmap or a list of runs, whichever is smallest, with the
cumulative cardinalities beside them. The k-th boundary is found by a search among the cumulative cardinalities and a select
inside one container; two selects give both cuts. The text is never decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from txnrisk.llm.text import portions, texts_of

#: Offsets that one container covers.
SPAN = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Marks that begin the parts of each form, in the order of the output.
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


class ArrayContainer:
    """Ascending offsets."""

    def __init__(self, offsets: np.ndarray):
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class RunContainer:
    """Runs of consecutive offsets: their starts, and how many offsets lie before each."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), np.cumsum(lengths) - lengths

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BitmapContainer:
    """A bit for each offset, in words of 64."""

    def __init__(self, offsets: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[offsets] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")

    def select(self, k: int) -> int:
        upto = np.cumsum(np.bitwise_count(self.words).astype(np.int64))
        word = int(np.searchsorted(upto, k, side="right"))
        rest = k - int(upto[word - 1]) if word else k
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[rest])


def container(offsets: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container: two bytes an offset, four a run, or 8192 for all bits."""
    firsts = np.flatnonzero(np.concatenate(([True], offsets[1:] != offsets[:-1] + 1)))
    array, runs, bitmap = 2 * len(offsets), 2 + 4 * len(firsts), SPAN // 8
    if runs <= min(array, bitmap):
        return RunContainer(offsets[firsts], np.diff(np.append(firsts, len(offsets))))
    return ArrayContainer(offsets) if array <= bitmap else BitmapContainer(offsets)


class BoundarySet:
    """The offsets at which code points of a UTF-8 text begin, and its end."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.containers, sizes = [], []
        for at in range(0, len(data) + 1, SPAN):
            part = data[at : at + SPAN]
            offsets = np.flatnonzero((part & 0xC0) != 0x80)
            if at + SPAN > len(data):  # the last one holds the end of the text
                offsets = np.append(offsets, len(part))
            if len(offsets):
                self.containers.append((at, container(offsets)))
                sizes.append(len(offsets))
        self.upto = np.cumsum(sizes)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        place = int(np.searchsorted(self.upto, k, side="right"))
        at, held = self.containers[place]
        return at + held.select(k - (int(self.upto[place - 1]) if place else 0))


def drawn_numbers(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of eight digits of the SHA-256 of ``<seed>:<doc_id>``; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def arranged(text: bytes, doc_id: int | None, seed: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle, and the output."""
    boundaries = BoundarySet(text)
    n = len(boundaries) - 1
    h1, h2, h3, h4 = drawn_numbers(doc_id, seed)
    if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    cuts = boundaries.select(low), boundaries.select(high)
    parts = {PREFIX: text[: cuts[0]], MIDDLE: text[cuts[0] : cuts[1]], SUFFIX: text[cuts[1] :]}
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, low, high - low, b"".join(mark.encode() + parts[mark] for mark in FORMS[form])


def fill_in_middle(docs: DataFrame, plain: int = 10, spm: int = 20, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as doc_id, n, form, prefix_chars, middle_chars, output.

    A text of ``n`` code points is cut at two boundaries drawn from the SHA-256 of seed and doc_id. ``plain`` percent of the
    texts stay as they are, and so do empty ones and those that contain a mark; of the others ``spm`` percent begin with the
    suffix and the rest with the prefix. Null texts count as empty, a null doc_id as an empty id. prefix_chars and middle_chars
    are null where the form is plain. Rows repeated with the same doc_id are cut by the same numbers. Empty tables give no rows;
    other columns are not read. Each row is computed by itself, without a shuffle.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    schema = T.StructType().add("doc_id", "long").add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "t"):
            ids = batch.column("doc_id")
            made = [arranged(t, i, seed, plain, spm) for t, i in zip(texts_of(batch, "t"), ids.to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. No part contains a mark, so each mark is found
    where it was set."""

    def part(mark: str) -> Column:
        """What stands between a mark and the next one or the end."""
        after = F.substring_index(output, mark, -1)
        for other in (PREFIX, SUFFIX, MIDDLE):
            after = F.substring_index(after, other, 1)
        return after

    return F.when(form == "plain", output).otherwise(F.concat(part(PREFIX), part(MIDDLE), part(SUFFIX)))


def digests(made: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` made, with output_sha256 and restored_sha256 instead of the output."""
    back = restored(F.col("output"), F.col("form"))
    sha = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)
