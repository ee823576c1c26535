"""Quality and toxicity by co-training.

Two classifiers look at a document from different sides: one at the words of its text, one at its metadata (source, language,
length and layout figures). Either sums the log-odds of all features, each the less the likelier it is by chance. Each labels the
unlabelled documents that it is sure of, and the other learns from them, until few new documents are handed over. Both are then
calibrated on documents kept out of training, and the calibrated views are combined to score every document.

The features of all documents are made once, in a table that the exchanges and the scoring read. An exchange adds up only the
documents whose labels it changes.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.shared import broadcast_few, written
from txnrisk.llm.text import id_remainder, portions

#: Places of hashed features in either view.
TEXT_PLACES, META_PLACES = 1 << 20, 512
#: Fitting reads at most about this many labelled documents, and all unlabelled ones; scoring reads all.
SAMPLE = 30_000
#: The exchange ends when at most this part of what is handed over is new; it is given up after this many rounds.
FEW, ROUNDS = 0.01, 20
#: A feature counts half if the likelihood ratio against chance, as twice its logarithm, is this much.
CHANCE = 16.0
#: A view hands on documents whose probability is this near to 0 or 1.
SURE = 0.02
REMEMBERED = 400_000
#: ASCII characters that separate words: all but letters, digits and bytes of other scripts.
GAPS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2,}|(?<= )[!-/:-@\[-`{-~](?= )")
PUNCTUATION, DIGITS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"0123456789"
ALONE = {bytes([c]) for c in PUNCTUATION}


def place(kind: bytes, value: bytes, places: int) -> int:
    return zlib.crc32(kind + value) % places


def content_words(text: bytes, marks: list[bytes] | None = None) -> set[bytes]:
    """The distinct words of the text without ASCII punctuation, and runs of punctuation marks (with ``~`` before them)."""
    marks = MARKS.findall(text) if marks is None else marks
    return set(text.lower().translate(GAPS).split()).union(b"~" + m for m in set(marks))


def word_places(word: bytes) -> tuple[int, ...]:
    """A word counts as itself and as its first four letters."""
    if word[:1] == b"~":
        return (place(b"m", word[:4], TEXT_PLACES),)
    return place(b"w", word, TEXT_PLACES), place(b"p", word.decode("utf-8", "ignore")[:4].encode(), TEXT_PLACES)


class KnownPlaces(dict):
    """The places of the words that a task has met, a bounded number of them."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = word_places(word)
        return found


def text_features(text: bytes, known: dict[bytes, tuple[int, ...]], marks: list[bytes] | None = None) -> set[int]:
    return set().union(*map(known.__getitem__, content_words(text, marks)))


def meta_features(text: bytes, source: str | None, lang: str | None, runs: list[bytes] | None = None) -> set[int]:
    """Source and language as they are, and figures of length and layout cut into classes. ``runs``: those of marks, if known."""
    words = text.split()
    runs = MARKS.findall(text) if runs is None else runs
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    marks, digits = (len(text) - len(text.translate(None, some)) for some in (PUNCTUATION, DIGITS))
    figures = {
        b"length": math.log2(len(text) + 1), b"words": math.log2(len(words) + 1), b"mean": min(20.0, len(text) / n),
        b"same": min(8, round(20 * same / n)), b"distinct": round(10 * len(set(words)) / n), b"marks": min(20, round(50 * marks / max(1, len(text)))),
        b"bars": min(8, round(20 * sum(map(ALONE.__contains__, words)) / n)), b"lines": math.log2(text.count(b"\n") + 1), b"digits": min(10, round(20 * digits / max(1, len(text)))),
        b"runs": min(6, len(runs) * 20 // n),
    }
    found = {place(k, str(int(v)).encode(), META_PLACES) for k, v in figures.items()}
    return found | {place(b"source", str(source).encode(), META_PLACES), place(b"lang", str(lang).encode(), META_PLACES)}


@dataclass(frozen=True)
class View:
    """The log-odds of each feature place (0 for those never seen) and of the classes."""

    weights: np.ndarray
    intercept: float

    def __reduce__(self):
        """Sent in single precision, and without the zeros if these are most."""
        at = np.flatnonzero(self.weights).astype(np.int32)
        if 2 * len(at) < len(self.weights):
            return unpacked, (len(self.weights), at, self.weights[at].astype(np.float32), self.intercept)
        return unpacked, (len(self.weights), None, self.weights.astype(np.float32), self.intercept)


def unpacked(places: int, at: np.ndarray | None, weights: np.ndarray, intercept: float) -> View:
    dense = np.zeros(places, np.float32)
    dense[slice(None) if at is None else at] = weights
    return View(dense, intercept)


def log_odds(a: np.ndarray, b: np.ndarray, ones: float, zeros: float) -> np.ndarray:
    """The log-odds of features in ``a`` of ``ones`` and ``b`` of ``zeros`` documents, against those of the classes.

    One document in the proportion of the classes is added, so what is unseen tells nothing, and a feature of one class only
    has finite odds. They are shrunk by g^2 / (g^2 + CHANCE^2), g being twice the logarithm of the likelihood ratio against
    chance, which holds for counts of 0 as well; no feature is left out.
    """
    share = ones / (ones + zeros)
    told = lambda n, expected: n * np.log(np.where(n > 0, n, 1) / np.where(n > 0, expected, 1))
    g = 2 * np.maximum(0, told(a, (a + b) * share) + told(b, (a + b) * (1 - share)))
    return (np.log((a + share) / (b + 1 - share)) - math.log(share / (1 - share))) * g**2 / (g**2 + CHANCE**2)


def fit(counts: np.ndarray) -> View:
    """From counts of documents without and with the label (rows) by feature place; the last column counts all documents. With
    one class only, nothing tells the classes apart."""
    (b, a), (zeros, ones) = counts[:, :-1], counts[:, -1]
    weights = np.zeros(len(a))
    if ones and zeros:
        seen = np.flatnonzero(a + b)
        weights[seen] = log_odds(a[seen], b[seen], ones, zeros)
    return View(weights, math.log((ones + 1) / (zeros + 1)))


def platt(pairs: list[tuple[list[float], float]]) -> np.ndarray:
    """Logistic regression on few columns by Newton steps: from log-odds to calibrated log-odds; the offset comes last."""
    if not pairs or len({y for _, y in pairs}) < 2:
        width = len(pairs[0][0]) if pairs else 1
        return np.array([1.0 / width] * width + [0.0])
    x = np.array([[*v, 1.0] for v, _ in pairs])
    x[:, :-1] = np.clip(x[:, :-1], -30, 30)
    y, w = np.array([y for _, y in pairs]), np.zeros(x.shape[1])
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # Platt's targets keep the slope finite
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Combined:
    """Both views of one target with their calibrations and the combination of the calibrated log-odds."""

    text: View
    meta: View
    by_text: np.ndarray
    by_meta: np.ndarray
    both: np.ndarray

    def probability(self, text_odds: np.ndarray, meta_odds: np.ndarray) -> np.ndarray:
        a = self.by_text[0] * np.clip(text_odds, -30, 30) + self.by_text[1]
        b = self.by_meta[0] * np.clip(meta_odds, -30, 30) + self.by_meta[1]
        return 1 / (1 + np.exp(-np.clip(self.both[0] * a + self.both[1] * b + self.both[2], -30, 30)))


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "quality", "toxic").filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


#: The feature places of a document, ascending, as bytes: those of the text by their lower 16 bits and by the bits above, which
#: repeat and so take little room, and those of the metadata. Bytes go to and from the tasks as they are, number by number would not.
FEATURES = {"text": np.uint16, "text_high": np.uint8, "meta": np.uint16}


def as_bytes(values: np.ndarray, lengths: list[int]) -> pa.Array:
    """The values of all documents in a row, cut into one binary for each."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def from_bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all documents in a row, and how many each has."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.empty(0, kind)
    return flat, np.diff(ends) // np.dtype(kind).itemsize


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and ``FEATURES`` from rows with doc_id, source, lang and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownPlaces()
        for batch in portions(batches):
            one, two, lengths = array("i"), array("i"), ([], [])
            for text, source, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang")), strict=True):
                text = text or b""
                marks = MARKS.findall(text)
                for flat, n, found in zip((one, two), lengths, (text_features(text, known, marks), meta_features(text, source, lang, marks)), strict=True):
                    flat.extend(sorted(found))
                    n.append(len(found))
            flat, meta = (np.array(x, np.int32) for x in (one, two))
            made = [as_bytes(flat.astype(np.uint16), lengths[0]), as_bytes((flat >> 16).astype(np.uint8), lengths[0]), as_bytes(meta.astype(np.uint16), lengths[1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *FEATURES])

    return rows.mapInArrow(run, "doc_id long, text binary, text_high binary, meta binary")


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of all documents with their labels (quality, toxic; null where there is none)."""
    known = broadcast_few(written(known_labels(labels)))
    return with_features(docs).join(known, "doc_id", "left").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), *FEATURES)


def sampled(table: DataFrame, sample: int) -> DataFrame:
    """A bounded sample of the labelled documents, chosen by a hash of the id; fold 0 is for calibration."""
    known = table.filter("quality IS NOT NULL")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    few = known.filter(chance < min(1.0, sample / max(1, known.count())))
    return few.withColumn("fold", id_remainder(F.col("doc_id"), 5))


def unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of all documents without a label, those without an id among them."""
    return featured(docs, labels).filter("quality IS NULL")


TARGETS = ("quality", "toxic")
VIEWS = (("text", TEXT_PLACES), ("meta", META_PLACES))
#: Instead of a feature place: all documents, and those handed over that were not before.
ALL, NEW = -1, -2


@dataclass(frozen=True)
class Judge:
    """Both views of one target with the calibrations by which they are trusted."""

    text: View
    meta: View
    by_text: np.ndarray
    by_meta: np.ndarray

    def hands(self, lists: list[tuple[np.ndarray, np.ndarray]], n: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """The labels (-1: none) that the text view and the metadata view learn for ``n`` documents."""
        odds = [summed(view, flat, owner, n) * by[0] + by[1] for view, by, (flat, owner) in zip((self.text, self.meta), (self.by_text, self.by_meta), lists, strict=True)]
        by_text, by_meta = (np.abs(x) > edge for x in odds)
        agree = (odds[0] > 0) == (odds[1] > 0)
        # What one view is sure of goes to the other, unless that is just as sure of the opposite.
        return np.where(by_meta & (agree | ~by_text), odds[1] > 0, -1), np.where(by_text & (agree | ~by_meta), odds[0] > 0, -1)


def places_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either view the feature places of all documents in a row, and whose they are."""
    (low, n), (high, _), (meta, m) = (from_bytes(batch.column(name), kind) for name, kind in FEATURES.items())
    return [(flat, np.repeat(np.arange(batch.num_rows), of)) for flat, of in ((low | high.astype(np.int32) << 16, n), (meta.astype(np.int32), m))]


def summed(view: View, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, view.weights[flat], n) + view.intercept


def tally(rows: DataFrame, now: tuple | None = None, before: tuple | None = None, sure: float = SURE) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Counts of documents by target, view, label and feature place (the last place: all documents), and how many documents
    have a label that they did not have ``before``. Labels are those of the rows, or what is handed over ``now``: broadcast views
    of all targets and their calibrations. With ``before`` the counts are what to add to those of before: documents whose label
    has changed count for the new one and against the old one, all others not at all.

    Tasks add up their rows, so a task sends at most a row for each target and place, and so do all together.
    """
    edge = math.log((1 - sure) / sure)
    judging = lambda who: [Judge(*views, *by) for views, by in zip(who[0].value, who[1], strict=True)] if who else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges, judged = judging(now), judging(before)
        totals = [[np.zeros((2, places + 1), np.int64) for _, places in VIEWS] for _ in TARGETS]
        new = np.zeros((len(TARGETS), len(VIEWS)), np.int64)
        for batch in batches:
            n, lists = batch.num_rows, places_of(batch)
            for t, target in enumerate(TARGETS):
                if judges is None:
                    labels = [batch.column(target).fill_null(-1).to_numpy(zero_copy_only=False)] * 2
                else:
                    labels = judges[t].hands(lists, n, edge)
                earlier = judged[t].hands(lists, n, edge) if judged else [np.full(n, -1)] * 2
                new[t] += [int(((x >= 0) & (x != y)).sum()) for x, y in zip(labels, earlier, strict=True)]
                for total, label, old, (flat, owner) in zip(totals[t], labels, earlier, lists, strict=True):
                    changed = label != old
                    if not changed.any():
                        continue
                    mine = changed[owner]
                    some, of = flat[mine], owner[mine]
                    for value in (0, 1):
                        for who, sign in ((label, 1), (old, -1)):
                            picked = changed & (who == value)
                            if picked.any():
                                total[value, :-1] += sign * np.bincount(some[picked[of]], minlength=total.shape[1] - 1)
                                total[value, -1] += sign * picked.sum()
        for t in range(len(TARGETS)):
            for v, total in enumerate(totals[t]):
                at = np.flatnonzero(total.any(axis=0))
                place = np.where(at == total.shape[1] - 1, ALL, at)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    np.full(len(at) + 1, t, np.int32), np.full(len(at) + 1, v, np.int32), np.append(place, NEW).astype(np.int32), np.append(total[0, at], 0), np.append(total[1, at], new[t, v]))],
                    ["target", "view", "place", "zeros", "ones"])

    made = rows.select(*FEATURES, *TARGETS).mapInArrow(run, "target int, view int, place int, zeros long, ones long")
    found = made.groupBy("target", "view", "place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    target, view, place, zeros, ones = (found.column(c).to_numpy() for c in ("target", "view", "place", "zeros", "ones"))
    counts = [[np.zeros((2, places + 1)) for _, places in VIEWS] for _ in TARGETS]
    new = np.zeros((len(TARGETS), len(VIEWS)), np.int64)
    for t in range(len(TARGETS)):
        for v in range(len(VIEWS)):
            mine = (target == t) & (view == v)
            told = mine & (place != NEW)
            counts[t][v][:, place[told]] = zeros[told], ones[told]  # ALL is the last place
            new[t, v] = ones[mine & (place == NEW)].sum()
    return counts, new


def co_train(known: DataFrame, pool: DataFrame, rounds: int, sure: float) -> list[Combined]:
    """Fits both views of all targets; ``known`` as ``sampled`` makes it, ``pool`` the features of those without a label."""
    train, held = known.filter("fold != 0"), known.filter("fold = 0")
    given, _ = tally(train)
    views, before, told = [[fit(c) for c in counts] for counts in given], None, None
    for _ in range(rounds):
        sent = known.sparkSession.sparkContext.broadcast(views)
        # The sums are not probabilities yet, so each view is calibrated on the labels before it is trusted.
        now = sent, [calibrations(odds) for odds in found_odds(train, sent)]
        more, new = tally(pool, now, before, sure)
        told = [[a + b for a, b in zip(*both, strict=True)] for both in zip(told, more, strict=True)] if before else more
        if before:
            before[0].destroy()
        before, views = now, [[fit(a + b) for a, b in zip(*both, strict=True)] for both in zip(given, told, strict=True)]
        if all(new[t, v] <= FEW * told[t][v][:, -1].sum() for t in range(len(TARGETS)) for v in range(len(VIEWS))):
            break
    sent = known.sparkSession.sparkContext.broadcast(views)
    made = [combined(odds, *both) for odds, both in zip(found_odds(held, sent), views, strict=True)]
    for used in (sent, *(before or ())[:1]):
        used.destroy()
    return made


def combined(odds: list[tuple[float, float, int]], text: View, meta: View) -> Combined:
    by_text, by_meta = calibrations(odds)
    calibrated = [([by_text[0] * bounded(x) + by_text[1], by_meta[0] * bounded(z) + by_meta[1]], y) for x, z, y in odds]
    both = platt(calibrated)
    return Combined(text, meta, by_text, by_meta, both if len(both) == 3 else np.array([0.5, 0.5, 0.0]))


def bounded(odds: float) -> float:
    return min(30.0, max(-30.0, odds))


def found_odds(rows: DataFrame, sent: Broadcast) -> list[list[tuple[float, float, int]]]:
    """For each target both views' log-odds and the label of labelled rows, of which there are a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = places_of(batch)
            for t, (target, views) in enumerate(zip(TARGETS, sent.value, strict=True)):
                sums = [summed(view, *x, batch.num_rows) for view, x in zip(views, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), *map(pa.array, sums), batch.column(target)], ["target", "text_odds", "meta_odds", "label"])

    found: list[list] = [[] for _ in TARGETS]
    for t, x, z, y in rows.select(*FEATURES, *TARGETS).mapInArrow(run, "target int, text_odds double, meta_odds double, label int").collect():
        found[t].append((x, z, y))
    return found


def calibrations(odds: list[tuple[float, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    return platt([([x], y) for x, _, y in odds]), platt([([x], y) for _, x, y in odds])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, text): doc_id, quality, toxic (probabilities) and kept, which is true
    if quality is 0.5 or more and toxic is below 0.5.

    ``labels`` has doc_id, quality and toxic (0 or 1); rows with a null take no part, and of several labels for an id the
    greatest counts. Only the labelled documents of fitting are bounded, to about ``sample``. Without labels
    every document gets 0.5 and 0.5 and is not kept. A null text is empty; null source and language are values of their own;
    null ids are scored too; repeated rows are scored alike. An empty table gives no rows; other columns are not read.
    """
    table = written(featured(docs.select("doc_id", "source", "lang", "text"), labels))
    known = written(sampled(table, sample))
    held = docs.sparkSession.sparkContext.broadcast(co_train(known, table.filter("quality IS NULL"), rounds, sure))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = places_of(batch)
            found = [m.probability(*(summed(view, *x, batch.num_rows) for view, x in zip((m.text, m.meta), lists, strict=True))) for m in held.value]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found), pa.array((found[0] >= 0.5) & (found[1] < 0.5))], ["doc_id", "quality", "toxic", "kept"])

    return table.select("doc_id", *FEATURES).mapInArrow(run, "doc_id long, quality double, toxic double, kept boolean")
