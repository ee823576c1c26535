"""Texts as bytes, words and hashes, shared by the operators that read documents inside tasks.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split()`` yields. A null text counts
as empty. Only the letters A-Z are lower-cased, which is what ``bytes.lower()`` does; other letters stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text whose words are held at a time.
PORTION = 4 << 20
#: Odd multipliers that spread the bits of 64-bit hashes (fixed values of a well-known mixer).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def lowered_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word (keyed SipHash with a fixed key, the same in every process)."""
    if not words:
        return np.empty(0, np.uint64)
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that makes every bit depend on all others."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and how often each occurs."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def id_remainder(column: Column, modulus: int) -> Column:
    """The same as a column expression."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def portions(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text (one row at least), so that the words of a piece fit into memory
    however many rows a batch has."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for at, upto in zip(cuts, cuts[1:], strict=False):
            if upto > at:
                yield batch.slice(at, upto - at)


def needed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with those an operator adds."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
