"""Operators on vectors: near-duplicates by lattice hashing, clustering by the threshold algorithm."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import centroids, lattice, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, sid string, component string, unit string, vid string, cluster string, whole string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, *"abcdef") for i, v in rows], SCHEMA).repartition(3)


def direction(rng, base, cosine):
    """A unit vector at exactly this cosine from ``base``."""
    side = rng.normal(size=len(base))
    side -= side @ base * base
    return cosine * base + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def unit(rng, width=16):
    v = rng.normal(size=width)
    return v / np.linalg.norm(v)


def odd_rows(width=16):
    """Null, empty, zero, null or non-finite components, other lengths, copies, scaled copies, huge and tiny values, repeated and
    null ids, near copies and chains."""
    rng = np.random.default_rng(5)
    a, b = unit(rng, width), unit(rng, width)
    rows = [(1, None), (2, []), (3, [0.0] * width), (4, [None, *a[1:]]), (5, [math.nan, *a[1:]]), (6, [math.inf, *a[1:]]), (None, a), (None, None), (8, a[: width - 1]), (9, [*a, 0.0])]
    rows += [(20, a), (21, a), (21, a), (22, 3 * a), (23, 1e300 * a), (24, 1e-300 * a), (25, -a)]
    rows += [(30 + i, direction(rng, b, 0.97)) for i in range(40)]
    chain = unit(rng, width)
    for i in range(12):
        rows.append((100 - i, chain))
        chain = direction(rng, chain, 0.93)
    return rows + [(200 + i, unit(rng, width)) for i in range(60)]


def by_hand(rows, least=0.9):
    """All pairs, then all that links reach."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [None] * n
    for i, (_, v) in enumerate(rows):
        if good[i]:
            w = np.array(v, float) / max(abs(x) for x in v)
            units[i] = w / np.linalg.norm(w)
    linked = [[j for j in range(n) if j != i and good[i] and good[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec_id, len(linked[i]), low, vec_id == low))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [8, 1024])
def test_near_vectors_by_hand(spark, block):
    rows = odd_rows()
    assert got(lattice.near_vectors(table(spark, rows), tables=40, block=block)) == by_hand(rows)


def test_tight_and_loose_groups_in_blocks(spark):
    """Blocks that are counted whole, blocks that are compared, and blocks out of reach, against all pairs."""
    rng = np.random.default_rng(6)
    a = unit(rng, 8)
    rows = [(i, direction(rng, a, 0.999)) for i in range(150)]
    at = a
    for i in range(150):
        at = direction(rng, at, 0.96)
        rows.append((1000 + i, at))
    assert got(lattice.near_vectors(table(spark, rows), tables=40, block=16)) == by_hand(rows)


def test_recall_at_the_threshold(spark):
    """With the production parameters, pairs of cosine 0.9 to 0.91 in 64 dimensions: at least 0.98 are found."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1500):
        v = unit(rng, 64)
        rows += [(2 * i, v), (2 * i + 1, direction(rng, v, 0.9001 + 0.01 * rng.random()))]
    found = sum(r["n_links"] for r in lattice.near_vectors(table(spark, rows)).select("n_links").collect())
    assert found <= 3000 and found / 3000 >= 0.98


def test_links_of_given_vectors(spark):
    """All vectors of a table with near copies, against all pairs."""
    rng = np.random.default_rng(8)
    rows = [(i, unit(rng, 64)) for i in range(400)]
    rows += [(1000 + i, direction(rng, rows[i % 40][1], 0.95)) for i in range(300)]
    rows += [(5000 + i, direction(rng, rows[3][1], 0.99)) for i in range(200)]
    assert got(lattice.near_vectors(table(spark, rows))) == by_hand(rows)


def test_near_vectors_of_nothing(spark):
    assert lattice.near_vectors(table(spark, [])).count() == 0
    assert got(lattice.near_vectors(table(spark, [(1, None), (2, [1.0, 2.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 8)) * 2
    points = lattice.lattice_point(x)
    assert lattice.roots().shape == (240, 8) and np.allclose((lattice.roots() ** 2).sum(axis=1), 2)
    doubled = (2 * points).astype(int)
    assert ((doubled % 2).sum(axis=1) % 8 == 0).all() and (points.sum(axis=1) % 2 == 0).all()
    # No neighbour is nearer than the decoded point; in E8 that makes it the nearest.
    own = ((x - points) ** 2).sum(axis=1)
    assert all((((x - points - v) ** 2).sum(axis=1) >= own - 1e-9).all() for v in lattice.roots())


def test_steps_to_neighbours_are_their_cells():
    """The key that a probe computes is the home key of a vector in that cell."""
    hashing = lattice.Hashing(8, 3, 479, 1)
    vector = np.random.default_rng(10).normal(size=(1, 8))
    keys = set(hashing.keys(vector)[0].tolist())
    own = lattice.lattice_point((vector @ hashing.projection).reshape(hashing.shape)[0])
    for step in lattice.roots()[::17]:
        cell = own.copy()
        cell[0] += step
        home = ((2 * cell).astype(np.int64).view(np.uint64) * hashing.weights[:1]).sum(axis=(1, 2), dtype=np.uint64) + hashing.tables[:1]
        assert int(lattice.mixed(home)[0]) in keys


def test_runs_span_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([2, 2], [4, 5]), ([], []), ([2, 3], [6, 7]), ([4], [8]))]
    batches[2] = batches[0].slice(0, 0)
    runs = list(vectors.runs_of(iter(batches), ["k"], lambda t: t.column("v").to_pylist()))
    assert runs == [[1, 2], [3, 4, 5, 6], [7], [8]]
    assert list(vectors.runs_of(iter([]), ["k"], len)) == []


def clustered_by_hand(rows, k, rounds, scale, width, seed):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    out = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    own = {n: sum(d for _, d, m in out if m == n) for _, _, n in out}
    return sorted(((i, n, d, own[n], total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in out), key=repr)


def test_clusters_by_hand(spark):
    """Few distinct values, so that ties and empty clusters occur."""
    rng = np.random.default_rng(11)
    rows = [r for r in odd_rows(6) if r[0] not in (23, 24)] + [(300 + i, rng.integers(-2, 3, 6) / 4) for i in range(200)]
    mine = centroids.cluster(table(spark, rows), k=7, rounds=3, scale=4, width=6, seed=1)
    assert sorted((tuple(r) for r in mine.collect()), key=repr) == clustered_by_hand(rows, 7, 3, 4, 6, 1)


def test_few_vectors_and_none(spark):
    assert centroids.cluster(table(spark, [])).count() == 0
    rows = [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (3, None)]
    mine = centroids.cluster(table(spark, rows), k=5, width=2)
    assert sorted((tuple(r) for r in mine.collect()), key=repr) == clustered_by_hand(rows, 5, 3, 64, 2, 1)
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(table(spark, [(1, [1e300, 2.0])]), width=2).collect()


@pytest.mark.parametrize("width", [1, 3, 20])
def test_walk_finds_the_nearest(width):
    """Against all distances, with many equal values and ties."""
    rng = np.random.default_rng(12)
    for k in (1, 2, 9, 16):
        centres = rng.integers(-4, 5, (k, width))
        points = rng.integers(-6, 7, (500, width))
        number, distance = centroids.Lists(centres.tolist()).assigned(points)
        exact = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_walk_in_two_dimensions():
    """The second vector is as far from two centroids; the smaller number wins."""
    lists = centroids.Lists([[0, 0], [1000, 1000], [2000, 2000]])
    number, distance = lists.nearest(np.array([[1, 1], [500, 500], [2100, 1900]]))
    assert number.tolist() == [0, 0, 2] and distance.tolist() == [2, 500_000, 20_000]


def test_no_column_but_the_named_ones_is_read(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("unit", F.lit("x"))
    assert lattice.near_vectors(rows).columns == ["vec_id", "n_links", "component_id", "kept"]
