"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter's place in an n-gram permutes its vector
(a rotation for each place), multiplying the permuted vectors binds them into the vector of the n-gram, and adding the vectors
of all n-grams bundles them into the vector of a text or of a language. A text has the language whose prototype has the
greatest cosine to it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import ArrowUDFType

from txnrisk.llm.text import id_remainder, needed, portions, sorted_counts

DIMENSIONS = 512
#: Vectors of n-grams that a task remembers; beyond that it starts afresh.
REMEMBERED = 1 << 15
#: Of these, how many are added up at a time.
AT_ONCE = 1 << 11
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point its letter in lower case, 0 if it is none; made once in a process."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            table[code] = ord(low) if len(low := c.lower()) == 1 else code
    return table


class Alphabet:
    """From code points to letters: lower case, anything that is no letter becomes 0, the gap between words."""

    def __init__(self):
        self.letter = letters()

    def grams(self, text: str) -> np.ndarray:
        """The text's trigrams of letters and gaps, as numbers; gaps in a row are one, and one stands at either end."""
        letters = self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = np.concatenate(([0], letters, [0])).astype(np.uint64)
        letters = letters[np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))]
        if len(letters) < 3:
            return np.empty(0, np.uint64)
        return letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:]


class Vectors:
    """Vectors of letters and n-grams, made when first met."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed, self.letters = dimensions, seed, {}
        self.forget()
        self.table = np.empty((REMEMBERED, dimensions), np.int8)

    def forget(self) -> None:
        self.known, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letters[code]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Places in ``table`` of the distinct ``grams``."""
        at = np.searchsorted(self.known, grams)
        new = grams[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != grams)] if len(self.known) else grams
        if len(new):
            if len(self.known) and len(self.known) + len(new) > REMEMBERED:
                self.forget()
                return self.rows(grams)
            start = len(self.known)
            for i, gram in enumerate(new.tolist(), start):
                a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
                self.table[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            known, row = np.concatenate((self.known, new)), np.concatenate((self.row, np.arange(start, start + len(new))))
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
            at = np.searchsorted(self.known, grams)
        return self.row[at]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of ``grams``, in pieces of bounded size."""
        total = np.zeros(self.dimensions)
        for at in range(0, len(grams), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            rows = self.rows(grams[part])
            total += counts[part].astype(np.float32) @ self.table[rows].astype(np.float32)
        return total


def learn(docs: DataFrame, folds: int = 5, dimensions: int = DIMENSIONS, seed: int = 7) -> dict[str, np.ndarray]:
    """A prototype of unit length per non-null lang, from all documents whose crc32(doc_id as text) mod ``folds`` isn't 0.

    Each task adds up its texts per language and sends one vector per language; what reaches the driver is one vector per
    language. A language whose training texts hold no letters has no prototype.
    """
    rows = needed(docs, "doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), folds) != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, vectors, sums = Alphabet(), Vectors(dimensions, seed), {}
        for batch in portions(batches):
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(alphabet.grams(text))
            for lang, grams in by.items():
                got = vectors.bundle(*sorted_counts(np.concatenate(grams)))
                sums[lang] = sums.get(lang, 0) + got
        names = list(sums)
        flat = np.concatenate([sums[k] for k in names]) if names else np.empty(0)
        places = np.tile(np.arange(dimensions), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), dimensions) if names else [], pa.string()), pa.array(places, pa.int32()), pa.array(flat, pa.float64())], ["lang", "place", "value"])

    summed = rows.select("lang", "text").mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for r in summed.collect():
        prototypes.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["value"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(prototypes.items()) if np.linalg.norm(v) > 0}


def language_of(spark: SparkSession, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = 7) -> Callable[[Column], Column]:
    """From a text to a struct of lang_pred, score and grams (the text's trigrams). Only texts go to the Python workers, and only
    these three values come back; the rest of a row stays where it is."""
    held = spark.sparkContext.broadcast((list(prototypes), np.array(list(prototypes.values())).reshape(len(prototypes), dimensions)))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alphabet, vectors = Alphabet(), Vectors(dimensions, seed)
        names, against = held.value
        for texts in columns:
            found, scores, lengths = [], [], []
            for text in texts:
                grams = alphabet.grams(text.as_py() or "")
                lengths.append(len(grams))
                if not len(grams) or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                vector = vectors.bundle(*sorted_counts(grams))
                length = np.linalg.norm(vector)
                cosines = against @ vector / length if length else np.zeros(len(names))
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.int64())], ["lang_pred", "score", "grams"])

    return F.arrow_udf(run, "lang_pred string, score double, grams long", ArrowUDFType.SCALAR_ITER)


def identify(docs: DataFrame, folds: int = 5, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    ``held_out`` says that crc32(doc_id as text) mod ``folds`` is 0; such documents teach nothing (a null id counts as the empty
    text). ``score`` is the cosine to the winning prototype, cut to 0..1. A null text, a text without letters, and every text if
    nothing could be learned, gets ``und`` and 0. Ties go to the first language in code point order. Empty tables give no rows.
    """
    said = language_of(docs.sparkSession, learn(docs, folds, **options), **options)
    rows = needed(docs, "doc_id", "text").select("doc_id", said("text").alias("said"))
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "said.lang_pred", "said.score")


def in_a_language(docs: DataFrame, least: float = 0.08, sure: int = 60, folds: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with a score of ``least`` or more, with all their columns.

    A text of fewer than ``sure`` trigrams can't be told from chance by its cosine, so it goes only if it has no letters. Null and
    empty texts go, and all texts if nothing could be learned. Repeated rows share their fate. An empty table gives no rows.
    """
    said = language_of(docs.sparkSession, learn(docs, folds, **options), **options)("text")
    return docs.filter((said["lang_pred"] != UNKNOWN) & ((said["score"] >= least) | (said["grams"] < sure)))
