"""Refuting pairs of shingle sets by size and parity, and shared keys in one pass."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import exact_dedup, near_dedup


def test_bitmaps_refute_no_link(spark):
    """Against the sets themselves: the bound never exceeds what isn't shared, and no linked pair is refuted."""
    rng = np.random.default_rng(1)
    rows, sets = [], []
    for i in range(120):
        base = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 3000)), np.uint64))
        near = base[rng.random(len(base)) > rng.random() * 0.3]
        for some in (base, np.unique(np.append(near, rng.integers(0, 2**64, int(rng.integers(0, 1 + len(base) // 8)), np.uint64)))):
            if len(some):
                rows.append((len(sets), i, len(some), near_dedup.parities(some).tolist()))
                sets.append(set(some.tolist()))
    df = spark.createDataFrame(rows, "sid long, g int, n long, bits array<long>")
    x, y = df.alias("x"), df.alias("y")
    both = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.sid") < F.col("y.sid")))
    refuted = 0
    for r in both.select("x.sid", F.col("y.sid").alias("o"), near_dedup.different("x", "y").alias("d"), near_dedup.possible("x", "y", (4, 5)).alias("may")).collect():
        a, b = sets[r["sid"]], sets[r["o"]]
        assert r["d"] <= len(a ^ b)
        linked = 5 * len(a & b) >= 4 * len(a | b)
        assert r["may"] or not linked
        refuted += not r["may"]
    assert refuted > 20


def test_shared_keys(spark):
    """Keys of one row, of many, and one whose rows fill many batches."""
    rng = np.random.default_rng(2)
    keys = np.concatenate((rng.integers(0, 4000, 3000), np.full(30_000, -7), [5001, 5002]))
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "key long, sid long")
    often = Counter(keys.tolist())
    got = sorted(tuple(r) for r in near_dedup.shared_keys(df).collect())
    assert got == sorted((int(k), i) for i, k in enumerate(keys) if often[int(k)] > 1)
    assert near_dedup.shared_keys(df.limit(0)).count() == 0


def test_rows_repeated_with_the_kept_id(spark):
    """One of them stays, whole; groups without such rows are decided in the map."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "Same text", "a"), (2, "same TEXT", "b"), (2, "same text", "c"), (3, "other", "d"), (4, None, "e"), (5, "", "f"), (7, long, "g"), (6, long + " more", "h"), (6, long + " more", "i"), (None, "alone", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    exact = exact_dedup.without_copies(df).collect()
    assert sorted((r["doc_id"] or 0) for r in exact) == [0, 2, 3, 5, 6, 7] and {r["row"] for r in exact if r["doc_id"] == 2} < {"b", "c"}
    near = near_dedup.one_of_each_group(df, k=2).collect()
    assert sorted((r["doc_id"] or 0) for r in near) == [0, 1, 3, 4, 5, 6] and len({r["row"] for r in near}) == 6


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, row string")
    assert exact_dedup.without_copies(none).count() == 0 and near_dedup.one_of_each_group(none).count() == 0


@pytest.mark.parametrize("crowd", [1, 7, 8192])
def test_unrefuted_pairs(spark, crowd):
    """Against all pairs under each key, with keys dealt over many tasks or in one."""
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**64, 60, np.uint64)) for _ in range(4)]
    sets, rows = [], []
    for sid in range(60):
        some = base[sid % 4]
        sets.append(np.unique(np.concatenate((some[rng.random(len(some)) < 0.97], rng.integers(0, 2**64, int(rng.integers(0, 6)), np.uint64)))))
    for key, members in ((1, range(60)), (2, range(0, 60, 2)), (3, [5, 9]), (4, range(7, 30, 4))):
        component = {sid: sid // 13 for sid in members}
        often = Counter(component.values())
        main = max(often, key=lambda c: (often[c], c))
        rows += [(key, sid, component[sid], main, len(component), len(component) - often[main], len(sets[sid]), near_dedup.parities(sets[sid]).tolist()) for sid in members]
    df = spark.createDataFrame(rows, "key long, sid long, component long, main long, all long, others long, n long, bits array<long>").repartition(3)
    got = {tuple(r) for r in near_dedup.unrefuted(df, (4, 5), crowd).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]:
                apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a[7], b[7], strict=True))
                if 5 * min(a[6], b[6]) >= 4 * max(a[6], b[6]) and 9 * apart <= a[6] + b[6]:
                    want.add((a[1], b[1]))
    assert got == want and len(want) > 100


def test_pairs_of_a_large_group(spark, monkeypatch):
    """Copies with one other word each share most of their keys; a round draws some sets for each copy, not one for each key."""
    text, n = [f"w{i}" for i in range(400)], 300
    rows = [(i, " ".join([*text[:i], f"new{i}", *text[i + 1 :]])) for i in range(n)] + [(1000 + i, f"apart {i} " * 9) for i in range(20)]
    drawn, compared = [], near_dedup.compared

    def counted(pairs, *more):
        drawn.append(pairs.count())
        return compared(pairs, *more)

    monkeypatch.setattr(near_dedup, "compared", counted)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < n else i for i, _ in rows}
    assert n - 1 <= drawn[0] <= 20 * n, drawn
