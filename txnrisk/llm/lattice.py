"""Near-duplicate vectors by lattice hashing.

A unit vector is projected at random to blocks of eight dimensions, and each block is decoded to the nearest point of the E8
lattice. The points of ``BLOCKS`` blocks together name a cell; each of ``TABLES`` tables has projections of its own. A vector is
at home in its own cell and probes the neighbouring cells that its projection is nearest to. Two vectors are candidates if one
is found in the other's home; a sketch of signs drops most candidates inside the join, and the cosine of the others is taken.

Found links join vectors to components. As every link lies inside a component, the links of a vector are then counted among
the vectors of its component, in blocks inside tasks: blocks so close that all of their pairs are links, or so far apart that
none is, are counted without comparing their vectors, and no list of pairs is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.llm.components import components
from txnrisk.llm.growth import joining_links
from txnrisk.llm.shared import written
from txnrisk.llm.text import MIX_A, mixed
from txnrisk.llm.vectors import finite_vectors, runs_of

#: With these, a pair of cosine 0.9 is found under one key with a probability of about 0.23, so it is missed with one of about
#: 0.005, and a pair of cosine 0.95 (0.51) hardly ever; 7 in a million pairs of unrelated vectors share a home.
TABLES, BLOCKS, PROBES, SCALE = 20, 2, 4, 0.55
#: Bits of the sketch, and standard deviations by which it may be off.
SKETCH, SLACK = 128, 5.0
#: Vectors of a component that are compared at a time; more in components of over its square, so that blocks stay fewer than vectors.
BLOCK = 1024
#: Vectors hashed at a time, and what an angle may be wrong by.
ROWS, EDGE = 256, 1e-6


@cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to a cell's neighbours."""
    whole = [(i, a, j, b) for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    made = np.zeros((len(whole), 8))
    for row, (i, a, j, b) in zip(made, whole, strict=True):
        row[i], row[j] = a, b
    half = np.array([s for s in product((0.5, -0.5), repeat=8) if np.prod(s) > 0])
    return np.concatenate((made, half))


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose sum is even: round, and where the sum is odd, round the worst component the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=-1)[..., None]
    other = np.take_along_axis(near, worst, -1) + np.where(np.take_along_axis(off, worst, -1) >= 0, 1, -1)
    turned = near.copy()
    np.put_along_axis(turned, worst, other, -1)
    return np.where((near.sum(axis=-1) % 2 != 0)[..., None], turned, near)


def lattice_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (the even integer points and the same shifted by a half) to each row of eight."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=-1) <= ((x - half) ** 2).sum(axis=-1)
    return np.where(nearer[..., None], whole, half)


class Hashing:
    """Projections and hash weights for vectors of one length, the same in every task."""

    def __init__(self, length: int, tables: int, probes: int, seed: int):
        rng = np.random.default_rng([seed, length])
        self.shape, self.probes = (tables, BLOCKS, 8), probes
        self.projection = rng.normal(size=(length, tables * BLOCKS * 8)) * SCALE
        self.signs = rng.normal(size=(length, SKETCH))
        self.weights = rng.integers(0, 2**64, self.shape, np.uint64) | np.uint64(1)
        self.tables = mixed(np.arange(tables, dtype=np.uint64) * MIX_A + np.uint64(length))
        # What a step to a neighbour adds to the hash of a cell. Coordinates are doubled to be whole.
        steps = (2 * roots()).astype(np.int64).view(np.uint64)
        self.steps = (self.weights[:, :, None, :] * steps).sum(axis=-1, dtype=np.uint64).reshape(tables, -1)

    def keys(self, units: np.ndarray) -> np.ndarray:
        """A row of keys per vector: the homes in all tables, then the probed neighbours."""
        x = (units @ self.projection).reshape(-1, *self.shape)
        points = lattice_point(x)
        base = ((2 * points).astype(np.int64).view(np.uint64) * self.weights).sum(axis=(-1, -2), dtype=np.uint64) + self.tables
        # Stepping by a root to the point p + v changes the squared distance by 2 - 2 (x - p) v.
        gain = ((x - points).astype(np.float32) @ roots().astype(np.float32).T).reshape(len(units), self.shape[0], -1)
        best = np.argpartition(-gain, self.probes, axis=-1)[..., : self.probes]
        near = base[..., None] + np.take_along_axis(np.broadcast_to(self.steps, gain.shape), best, -1)
        return mixed(np.concatenate((base, near.reshape(len(units), -1)), axis=1))

    def sketch(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.signs > 0, axis=1).view("<i8")


def unit_vectors(embeddings: DataFrame, vector: str) -> DataFrame:
    """vec_id, ``vid`` (a digest of the unit vector, null where there is none) and the ``unit`` vector in doubles.

    Vectors that point the same way but differ in length become equal up to rounding; those that don't are compared later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes | None] = [None] * batch.num_rows
            for places, wide in finite_vectors(batch.column("vector")):
                if wide.shape[1]:
                    most = np.abs(wide).max(axis=1)
                    places, wide = places[most > 0], wide[most > 0] / most[most > 0][:, None] + 0.0  # no overflow, no negative zero
                    for place, row in zip(places, wide / np.sqrt((wide**2).sum(axis=1))[:, None], strict=True):
                        made[place] = row.astype("<f8").tobytes()
            ids = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in made]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ids, pa.binary()), pa.array(made, pa.binary())], ["vec_id", "vid", "unit"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, vid binary, unit binary")


def by_length(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places and matrix."""
    sizes = np.array([len(u) for u in units])
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield places, np.frombuffer(b"".join(units[i] for i in places), "<f8").reshape(len(places), -1)


def indexed(sets: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """A row (key, sid, home, s0, s1) for the home and the probed cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashing] = {}
        for batch in batches:
            sid = batch.column("sid").to_numpy(zero_copy_only=False)
            for places, units in by_length(batch.column("unit").to_pylist()):
                hashing = known.setdefault(units.shape[1], Hashing(units.shape[1], tables, probes, seed))
                for at in range(0, len(places), ROWS):
                    part = units[at : at + ROWS]
                    keys, bits = hashing.keys(part), hashing.sketch(part)
                    home = np.tile(np.arange(keys.shape[1]) < tables, len(part))
                    wide = [np.repeat(x, keys.shape[1]) for x in (sid[places[at : at + ROWS]], bits[:, 0], bits[:, 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(wide[0]), pa.array(home), pa.array(wide[1]), pa.array(wide[2])], ["key", "sid", "home", "s0", "s1"])

    return sets.select("sid", "unit").mapInArrow(run, "key long, sid long, home boolean, s0 long, s1 long")


def close_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine is ``least`` or more."""
    one, two = (sets.select(F.col("sid").alias(n), F.col("unit").alias(f"unit_{n}")) for n in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(f"unit_{n}").to_pylist() for n in "ab")
            keep = [len(u) == len(v) and float(np.frombuffer(u, "<f8") @ np.frombuffer(v, "<f8")) >= least for u, v in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def matrix(rows: pa.Table, name: str = "unit") -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), "<f8").reshape(rows.num_rows, -1)


def linked_copies(x: np.ndarray, y: np.ndarray, copies: np.ndarray, least: float) -> np.ndarray:
    """For each row of ``x``: how many copies of rows of ``y`` have a cosine of ``least`` or more."""
    total = np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        for to in range(0, len(y), BLOCK):
            total[at : at + BLOCK] += (x[at : at + BLOCK] @ y[to : to + BLOCK].T >= least) @ copies[to : to + BLOCK]
    return total


def counted_links(rows: DataFrame, least: float, block: int) -> DataFrame:
    """sid and ``links``, the copies of other vectors of its component within ``least``. ``rows``: component, sid, copies, unit."""
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    parts = F.ceil(F.col("n") / F.greatest(F.lit(block), F.ceil(F.sqrt("n")))).cast("long")
    sizes = sizes.select("component", parts.alias("parts"))
    placed = written(rows.join(sizes, "component", "left").withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("sid"), "parts"))).drop("parts"))
    split = placed.filter("part >= 0")

    def outline(part: pa.Table) -> pa.RecordBatch:
        units = matrix(part)
        centre = units.sum(axis=0)
        centre = centre / max(np.sqrt((centre**2).sum()), 1e-300)
        radius = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
        copies = int(np.sum(part.column("copies").to_numpy()))
        return pa.RecordBatch.from_arrays([part.column("component").chunk(0)[:1], part.column("part").chunk(0)[:1], pa.array([centre.astype("<f8").tobytes()], pa.binary()), pa.array([radius]), pa.array([copies])], ["component", "part", "centre", "radius", "copies"])

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return runs_of(batches, ["component", "part"], outline)

    blocks = written(split.repartition("component", "part").sortWithinPartitions("component", "part").mapInArrow(outlines, "component long, part long, centre binary, radius double, copies long"))
    reach = float(np.arccos(np.clip(least, -1, 1)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("centre").to_pylist(), batch.column("centre_b").to_pylist()
            angle = np.array([np.arccos(np.clip(np.frombuffer(u, "<f8") @ np.frombuffer(v, "<f8"), -1, 1)) for u, v in zip(x, y, strict=True)])
            around = batch.column("radius").to_numpy() + batch.column("radius_b").to_numpy()
            same = batch.column("part").to_numpy() == batch.column("part_b").to_numpy()
            angle = np.where(same, 0.0, angle)
            verdict = np.where(angle + around <= reach - EDGE, 1, np.where(angle - around > reach + EDGE, -1, 0)).astype(np.int32)
            held = pa.RecordBatch.from_arrays([batch.column(c) for c in ("component", "part", "part_b", "copies", "copies_b")] + [pa.array(verdict)], ["component", "a", "b", "copies_a", "copies_b", "verdict"])
            yield held.filter(pa.array(verdict >= 0))

    other = blocks.select("component", *[F.col(c).alias(f"{c}_b") for c in ("part", "centre", "radius", "copies")])
    # A component of n vectors has at most as many blocks as the root of n, so pairs of blocks stay fewer than vectors.
    judged = written(blocks.join(other, "component").filter(F.col("part") <= F.col("part_b")).mapInArrow(judge, "component long, a long, b long, copies_a long, copies_b long, verdict int"))
    both = F.array(F.struct(F.col("a").alias("part"), F.col("copies_b").alias("more")), F.struct(F.col("b").alias("part"), F.col("copies_a").alias("more")))
    distinct = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    # Blocks whose pairs are all links give each vector all copies of the other block; a block with itself, all but its own.
    sums = judged.filter("verdict = 1").select("component", F.inline(distinct)).groupBy("component", "part").agg(F.sum("more").alias("more"))
    own = judged.filter("verdict = 1 AND a = b").select("component", F.col("a").alias("part"), F.lit(1).alias("own"))
    whole = split.join(sums, ["component", "part"]).join(own, ["component", "part"], "left").select("sid", (F.col("more") - F.when(F.col("own") == 1, F.col("copies")).otherwise(0)).alias("links"))
    sides = F.array(F.struct(F.col("a").alias("part"), F.lit(0).alias("side")), F.struct(F.col("b").alias("part"), F.lit(1).alias("side")))
    asked = judged.filter("verdict = 0").select("component", "a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)))
    units = split.join(asked, ["component", "part"]).select("component", "a", "b", "side", "sid", "copies", "unit")
    units = units.unionByName(placed.filter("part < 0").select("component", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("side"), "sid", "copies", "unit"))

    def compare(part: pa.Table) -> pa.RecordBatch:
        units, sid, copies = matrix(part), part.column("sid").to_numpy(), part.column("copies").to_numpy()
        if part.column("a")[0].as_py() == part.column("b")[0].as_py():
            links = linked_copies(units, units, copies, least) - np.where((units**2).sum(axis=1) >= least, copies, 0)
        else:
            first = part.column("side").to_numpy() == 0
            links = np.zeros(len(sid), np.int64)
            links[first] = linked_copies(units[first], units[~first], copies[~first], least)
            links[~first] = linked_copies(units[~first], units[first], copies[first], least)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(links)], ["sid", "links"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return runs_of(batches, ["component", "a", "b"], compare)

    keys = ["component", "a", "b"]
    open_ = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "sid long, links long")
    return whole.unionByName(open_).groupBy("sid").agg(F.sum("links").alias("links"))


def near_vectors(embeddings: DataFrame, least: float = 0.9, vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id and a vector of numbers): vec_id, n_links, component_id, kept.

    Two rows are linked if the cosine of their vectors, in double precision, is ``least`` or more. ``n_links`` counts the other
    rows that a row is linked with, ``component_id`` is the least vec_id that links reach, ``kept`` says that it is the row's
    own. Vectors that are null, empty, zero or hold a null or non-finite component are linked with nothing and keep their own id;
    vectors of different lengths aren't linked. Rows with equal vectors are linked without a comparison, also rows repeated
    with the same vec_id, which all get the same values. Null ids are not counted as least unless there are no others. Empty
    tables give no rows; other columns are not read.
    """
    spread = 180 / np.pi * np.arccos(least) / 180
    most = int(np.ceil(SKETCH * spread + SLACK * np.sqrt(SKETCH * spread * (1 - spread))))
    marked = written(unit_vectors(embeddings, vector))
    some = marked.filter("vid IS NOT NULL").groupBy("vid").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit"))
    sets = written(some.withColumn("sid", F.monotonically_increasing_id()))
    index = written(indexed(sets, tables, probes, seed))
    shared = index.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("z"), F.max("home").alias("home")).filter("home AND a != z").select("key")
    members = written(index.join(shared, "key"))

    def distance(x: str, y: str) -> Column:
        return sum(F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in ("s0", "s1"))

    links = joining_links(members, ["s0", "s1"], distance, lambda x, y: distance(x, y) <= most, lambda pairs: close_pairs(pairs, sets, least))
    joined = written(components(links).withColumnRenamed("node", "sid"))
    rows = joined.join(sets.select("sid", "copies", "unit"), "sid")
    counts = counted_links(rows, least, block)
    lows = joined.join(sets.select("sid", "low"), "sid").groupBy("component").agg(F.min("low").alias("component_id"))
    groups = sets.select("sid", "vid", "low", "copies").join(joined, "sid", "left").join(lows, "component", "left").join(counts, "sid", "left")
    groups = written(groups.select("vid", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id")))
    alike = marked.filter("vid IS NOT NULL").join(groups, "vid").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = marked.filter("vid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return alike.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
