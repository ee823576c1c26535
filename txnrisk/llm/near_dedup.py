"""Near-duplicate detection: MinHash signatures joined by Hamming distance over several indexes.

A document's set of word shingles gets a signature of ``POSITIONS`` min-hashes, each cut to 16 bits; two sets of similarity J
agree in each position with probability J. The signature is split into ``CHUNKS`` chunks. By the pigeonhole principle two
signatures that differ in at most ``(errors + 1) * CHUNKS - 1`` positions have a chunk with at most ``errors`` differences, so
enumerating the allowed errors of each chunk (leaving out each choice of positions) and joining on what remains finds *every*
pair within that distance. With 80 positions, 16 chunks and one error the distance is 31, where a pair of similarity 0.8 is
expected at 16; farther pairs are found unless all their chunks have more errors, so that a pair of similarity 0.8 is missed
with a probability of about 1e-9.

Every set also has its size and a bitmap that says for each of ``BITS`` hash values whether an odd number of its shingles has
it. Two bitmaps differ in no more places than the sets in shingles, so candidates whose sizes or bitmaps allow no similarity of
0.8 are refuted exactly, before a row is made of them. The others are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from txnrisk.llm.components import components
from txnrisk.llm.shared import FEW, broadcast_few, forget, written
from txnrisk.llm.text import mixed, needed, portions, sorted_counts, texts_of, word_hashes

POSITIONS, CHUNKS, ERRORS = 80, 16, 1
#: All pairs within this distance are found.
DISTANCE = (ERRORS + 1) * CHUNKS - 1
#: Places of the bitmap by which pairs are refuted, the same in 64-bit words, and the rows of a key that a task compares.
BITS = 2048
WORDS, CROWD = BITS // 64, 8192
#: Rounds of comparisons with drawn sets, and how many of the nearest of these are confirmed for each set.
ROUNDS, NEAREST = 3, 4
#: Orders of all sets in a round, by which sets are drawn.
ORDERS = 4
#: Shingles whose hashes are permuted at a time, bytes of text whose words are held at a time, pairs that are confirmed at a time
#: and sets held for them.
BLOCK, PORTION, PAIRS, HELD = 1 << 12, 1 << 20, 512, 64


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct ``k``-word shingles of the lower-cased text as ascending 64-bit hashes; with fewer words, all of them as
    one shingle; without words, none."""
    words = text.lower().split()
    return shingle_set(word_hashes(words), k)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(k, n)
    made = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return sorted_counts(made)[0]


def multipliers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, POSITIONS, np.uint64) | np.uint64(1), rng.integers(0, 2**64, POSITIONS, np.uint64)


def signature(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> bytes:
    """16 bits of the least permuted hash, for each of the permutations."""
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        np.minimum(least, (part[:, None] * times + plus).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` values of the top bits whether an odd number of hashes has it, in 64-bit words."""
    odd = np.bincount((hashes >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def different(x: str, y: str) -> Column:
    """A lower bound of how many shingles two sets (aliases with ``bits``) don't share."""
    return sum(F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(WORDS))


def possible(x: str, y: str, share: tuple[int, int]) -> Column:
    """Whether sizes and bitmaps of two sets (aliases with ``n`` and ``bits``) allow their link.

    With n and m shingles of which d aren't shared, intersection and union are (n + m - d) / 2 and (n + m + d) / 2.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (share[1] * F.least(n, m) >= share[0] * F.greatest(n, m)) & ((share[1] + share[0]) * different(x, y) <= (share[1] - share[0]) * (n + m))


def marked_sets(docs: DataFrame, k: int, carry: list[str], extra: str | None = None, seed: int = 3) -> DataFrame:
    """The ``carry`` columns (as c0, c1, ...), n_shingles and set_id, a 128-bit digest of the set, null if it is empty; with
    ``extra`` also the signature and bitmap (``sig``, ``bits``) or the compressed words (``words``)."""
    source = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(carry)], F.col("text").cast("binary").alias("t"))
    schema = T.StructType(source.schema.fields[: len(carry)]).add("n_shingles", "long").add("set_id", "binary")
    schema = schema.add(extra, "binary") if extra else schema
    schema = schema.add("bits", T.ArrayType(T.LongType())) if extra == "sig" else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = multipliers(seed)
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in portions(batches, "t", PORTION):
            texts = [t.lower().split() for t in texts_of(batch, "t")]
            hashes = word_hashes([w for t in texts for w in t])
            ends = np.cumsum([len(t) for t in texts])
            sets = [shingle_set(hashes[e - len(t) : e], k) for t, e in zip(texts, ends, strict=True)]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [*[batch.column(i) for i in range(len(carry))], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary())]
            if extra == "words":
                columns.append(pa.array([squeeze.compress(b" ".join(t)) for t in texts], pa.binary()))
            elif extra:
                columns.append(pa.array([signature(s, times, plus) if len(s) else None for s in sets], pa.binary()))
                columns.append(pa.array([parities(s) if len(s) else None for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row of positions a 64-bit key per chunk and choice of left-out positions."""
    width = POSITIONS // CHUNKS
    wide = signatures.astype(np.uint64).reshape(len(signatures), CHUNKS, width)
    made = []
    for number, out in enumerate(combinations(range(width), ERRORS)):
        key = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64) + np.uint64(number), wide.shape[:2]) + np.uint64(1)
        for i in range(width):
            if i not in out:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, i])
        made.append(key)
    return np.concatenate(made, axis=1)


def indexed(sets: DataFrame) -> DataFrame:
    """A row (key, sid) for each key of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signatures = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, POSITIONS)
                keys = chunk_keys(signatures)
                sid = np.repeat(batch.column("sid").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(sid)], ["key", "sid"])

    return sets.select("sid", "sig").mapInArrow(run, "key long, sid long")


def shared_keys(index: DataFrame) -> DataFrame:
    """The rows of ``index`` whose key another row has too. Rows are dealt by key once and pass a task in order, one held back at a
    time, so the number of rows of a key doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = None, False  # the last row so far, and whether the row before it has its key

        def batch_of(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sids)], ["key", "sid"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid"))
            if held:
                keys, sids = np.append(held[0], keys), np.append(held[1], sids)
            same = keys[1:] == keys[:-1]
            keep = np.append(same, False) | np.append(again if held else False, same)
            yield batch_of(keys[:-1][keep[:-1]], sids[:-1][keep[:-1]])
            held, again = (keys[-1], sids[-1]), bool(keep[-1])
        if held and again:
            yield batch_of(np.array([held[0]]), np.array([held[1]]))

    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, sid long")


def drawn_pairs(labelled: DataFrame, number: int) -> DataFrame:
    """Each set (``of``) with the sets (a, b: the two in order) drawn under its keys (key, sid, component) in a round, from other components.

    Keys are dealt into ``ORDERS`` classes, and in a class the first of its sets in one order of all sets is drawn under every key. So
    keys that the sets of a group share draw the same few sets, not one for each key: a group of n near copies gives
    some pairs for each of its sets, however many keys these share.
    """
    order = F.pmod("key", F.lit(ORDERS))
    draw = F.struct(F.xxhash64(order, "sid", F.lit(number)).alias("h"), "sid", "component")
    drawn = labelled.groupBy("key").agg(F.min(draw).alias("d")).select("key", F.col("d.sid").alias("r"), F.col("d.component").alias("other"))
    return labelled.join(drawn, "key").filter("component != other").select(F.least("r", "sid").alias("a"), F.greatest("r", "sid").alias("b"), F.col("sid").alias("of")).distinct()


def compared(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b, of) that aren't refuted, with a ``distance``."""
    x, y = (sets.select(F.col("sid").alias(f"sid_{s}"), "n", "bits").alias(s) for s in "xy")
    both = pairs.join(x, F.col("a") == F.col("sid_x")).join(y, (F.col("b") == F.col("sid_y")) & possible("x", "y", share))
    return both.select("a", "b", "of", different("x", "y").alias("distance"))


def unrefuted(split: DataFrame, share: tuple[int, int], crowd: int = CROWD) -> DataFrame:
    """The pairs (a, b) of sets that share a key, lie in different components and aren't refuted by sizes and bitmaps.

    ``split``: key, sid, component, n, bits, and the key's ``main`` component, its number of rows ``all`` and of ``others`` outside
    the main one. A key's rows go to one task; those of a key with more than ``crowd`` rows are dealt, so that any of the others
    meets any of all in one task. Tasks compare bitmaps in blocks, and only pairs that may be links leave them.
    """
    rows = split.select("key", "sid", "component", "main", "n", "bits", "all", "others")
    none = F.lit(-1).cast("long")
    few = rows.filter(F.col("all") <= crowd).withColumns({"i": none, "j": none, "side": F.lit(1)})
    large, parts = rows.filter(F.col("all") > crowd), lambda n: F.ceil(F.col(n) / F.lit(crowd)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("sid"), parts(n))
    there = large.withColumn("i", every("others")).withColumns({"j": own("all"), "side": F.lit(1)})
    asking = large.filter("component != main").withColumn("j", every("all")).withColumns({"i": own("others"), "side": F.lit(0)}).select(there.columns)
    units = few.unionByName(there).unionByName(asking).drop("all", "others")

    def compare(key: np.ndarray, sid: np.ndarray, component: np.ndarray, main: np.ndarray, n: np.ndarray, bits: np.ndarray, alone: bool, side: np.ndarray) -> np.ndarray:
        ask = np.flatnonzero(component != main) if alone else np.flatnonzero(side == 0)
        of = np.arange(len(sid)) if alone else np.flatnonzero(side == 1)
        found = []
        for x in ask:
            may = (component[of] != component[x]) & ((sid[x] < sid[of]) | (component[of] == main[of])) & (share[1] * np.minimum(n[x], n[of]) >= share[0] * np.maximum(n[x], n[of]))
            left = of[may]
            for upto in (WORDS // 4, WORDS):  # a quarter of the bitmap refutes most of them already
                apart = np.bitwise_count(bits[x, :upto] ^ bits[left, :upto]).sum(axis=1, dtype=np.int64)
                left = left[(share[1] + share[0]) * apart <= (share[1] - share[0]) * (n[x] + n[left])]
            if len(left):
                found.append(np.column_stack((np.minimum(sid[x], sid[left]), np.maximum(sid[x], sid[left]))))
        return np.concatenate(found) if found else np.empty((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the parts of a unit that isn't complete yet

        def done() -> np.ndarray:
            columns = [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*held, strict=True)]
            key, i, _, side, sid, component, main, n, bits = columns
            return compare(key, sid, component, main, n, bits, i[0] < 0, side)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "sid", "component", "main", "n")]
            columns.append(batch.column("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS))
            edge = np.zeros(batch.num_rows, bool)
            for place, c in enumerate(columns[:3]):
                edge[1:] |= c[1:] != c[:-1]
                edge[0] |= bool(held) and held[-1][place][-1] != c[0]
            found, first = [], 0
            for cut in np.flatnonzero(edge).tolist():
                if cut > first:
                    held.append([c[first:cut] for c in columns])
                if held:
                    found.append(done())
                    held = []
                first = cut
            held.append([c[first:] for c in columns])
            if found := [f for f in found if len(f)]:
                made = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])
        if held:
            made = done()
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], ["a", "b"])

    unit = ["key", "i", "j"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, words: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets have ``share[1] * intersection >= share[0] * union``."""
    one = words.select(F.col("sid").alias("a"), F.col("words").alias("words_a"))
    two = words.select(F.col("sid").alias("b"), F.col("words").alias("words_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = zstandard.ZstdDecompressor()
        for batch in (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS)):
            held: dict[bytes, np.ndarray] = {}
            keep = []
            for pair in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist(), strict=True):
                if len(held) > HELD:
                    held.clear()
                x, y = (held[w] if w in held else held.setdefault(w, shingles(spread.decompress(w), k)) for w in pair)
                least, most = sorted((len(x), len(y)))
                if share[1] * least < share[0] * most:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((x, y)))
                inside = int((both[1:] == both[:-1]).sum())
                keep.append(share[1] * inside >= share[0] * (len(x) + len(y) - inside))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) that join all sets which any confirmed link joins.

    In some rounds every set is compared with one set drawn under each of its keys, as far as they are not joined yet, and with
    the nearest few of these on full sets; large groups of near copies grow together in this way at a cost that is linear in
    their size. Under a key whose sets are all joined no further pair can change a component. Under the other keys, every pair
    from different components that was not compared before is compared: those outside the key's largest component with
    all others.
    """
    members = written(shared_keys(indexed(sets)))
    labelled = members.withColumn("component", F.col("sid"))
    found = tested = old = None
    for number in range(ROUNDS):
        pairs = drawn_pairs(labelled, number)
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        # A set has at most as many of these as it has keys.
        rank = F.row_number().over(Window.partitionBy("of").orderBy("distance", "a", "b"))
        chosen = written(compared(pairs, sets, share).withColumn("nth", rank).filter(F.col("nth") <= NEAREST).select("a", "b").distinct())
        more = written(confirmed(chosen, words_of(docs, sets, chosen, k), k, share))
        found, tested = (more, chosen) if found is None else (found.unionByName(more), tested.unionByName(chosen))
        if more.isEmpty():
            break
        joined = components(found).withColumnRenamed("node", "sid")
        labelled = written(members.join(joined, "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("component")))
        if old:
            forget(old)
        old = labelled
    counted = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
    apart = counted.filter("all > top.c").select("key", F.col("top.component").alias("main"), "all", (F.col("all") - F.col("top.c")).alias("others"))
    split = written(labelled.join(apart, "key"))
    pairs = unrefuted(split.join(sets.select("sid", "n", "bits"), "sid"), share).distinct().join(tested, ["a", "b"], "left_anti")
    rest = written(pairs)
    forget(split, members)
    return found.unionByName(confirmed(rest, words_of(docs, sets, rest, k), k, share))


def words_of(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``sid`` and the compressed words of each set that occurs in a pair, from the document of least id that has the set."""
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = written(ids.join(sets.select("sid", "set_id", "low"), "sid"))
    low = wanted.filter("low IS NOT NULL").select(F.col("low").alias("doc_id")).distinct()
    low = F.broadcast(low) if wanted.count() <= FEW else low
    # Only texts of these ids are looked at again. An id may have other texts too, and sets may be found under no id only.
    texts = docs.join(low, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    found = marked_sets(texts, k, [], "words").filter("set_id IS NOT NULL").select("set_id", "words")
    return written(found.join(wanted.select("sid", "set_id"), "set_id").groupBy("sid").agg(F.min("words").alias("words")))


def grouped(docs: DataFrame, k: int, share: tuple[int, int], carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_shingles, set_id and the ``carry`` columns), and for each set_id its ``group`` and the group's ``component_id``."""
    names = ["doc_id", *(carry or [])]
    marked = written(marked_sets(docs, k, names, "sig").withColumnsRenamed({f"c{i}": n for i, n in enumerate(names)}))
    some = marked.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"), F.min("sig").alias("sig"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    sets = written(some.withColumn("sid", F.monotonically_increasing_id()))
    joined = components(links(docs, sets, k, share)).withColumnRenamed("node", "sid")
    known = written(sets.select("set_id", "sid", "low").join(joined, "sid", "left").select("set_id", F.coalesce("component", "sid").alias("group"), "low", F.col("component").isNotNull().alias("linked")))
    least = known.filter("linked").groupBy("group").agg(F.min("low").alias("least"))
    linked = known.filter("linked").join(least, "group").select("set_id", "group", F.col("least").alias("component_id"))
    alone = known.filter("not linked").select("set_id", "group", F.col("low").alias("component_id"))
    return marked.select(*names, "n_shingles", "set_id"), written(linked.unionByName(alone))


def near_dedup(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct ``k``-word shingles have a similarity of ``share`` or more; ``component_id``
    is the least doc_id that links reach, ``kept`` says that it is the document's own. A text with fewer than ``k`` words is one
    shingle. A null, empty or blank text has no shingle, is linked with nothing and keeps its own id. Equal sets are linked
    without a comparison. Null ids are not counted as least unless there are no others; rows repeated with the same doc_id
    get the same values. Empty tables give no rows.
    """
    docs = needed(docs, "doc_id", "text")
    marked, groups = grouped(docs, k, share)
    some = marked.filter("set_id is not null").join(groups, "set_id").select("doc_id", "n_shingles", "component_id")
    none = marked.filter("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, with all their columns; of rows repeated with the kept id, one.

    Rows are known by doc_id and a hash of the text. Where the table of those that go is small enough to be broadcast, every row is
    decided in the map, without another look at its words; beyond that all rows are shuffled once. Null, empty and blank texts all stay, a null id is kept only where its group has no other. Empty tables
    give no rows.
    """
    text = F.xxhash64("text").alias("text_hash")
    marked, groups = grouped(needed(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")), k, share, ["text_hash"])
    rows = marked.filter("set_id is not null").join(groups, "set_id").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Of a group's rows with the kept id, those of the least hash stay; if there are several of these, one.
    kept = rows.filter("stays").groupBy("group").agg(F.min("text_hash").alias("least"))
    judged = rows.join(kept, "group", "left").withColumn("stays", F.col("stays") & (F.col("text_hash") == F.col("least")))
    known = judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    told = broadcast_few(written(known.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text"), "stays")))
    same = lambda d: d["doc_id"].eqNullSafe(told["of_id"]) & (d["text_hash"] == told["of_text"])
    hashed = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), "doc_id", text)
    alone = hashed.join(told, same(hashed), "left_anti").select("row.*")
    repeated = told.filter("stays")
    if repeated.isEmpty():
        return alone
    again = hashed.join(repeated, same(hashed), "left_semi")
    return alone.unionByName(again.dropDuplicates(["doc_id", "text_hash"]).select("row.*"))
