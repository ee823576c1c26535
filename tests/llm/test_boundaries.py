"""Fill-in-middle: containers, selects, forms and the way back."""

import hashlib

import numpy as np
import pytest

from txnrisk.llm import boundaries as b, queries

SIGNS = ["a", "é", "日", "𝄞", "\x00", "\n", "é", "👩‍👩‍👧"]


def texts():
    rng = np.random.default_rng(3)
    mixed = "".join(SIGNS[i] for i in rng.integers(0, len(SIGNS), 40_000))
    return ["", "x", "日", "abc" * 30_000, "日本" * 40_000, mixed, ("a" * 70_000 + mixed) * 2, "é" * 32_768, "a" * 65_535, "a" * 65_536, "𝄞" * 16_384 + "b"]


def test_every_boundary_is_selected():
    for text in texts():
        data = text.encode()
        offsets = [0, *np.cumsum([len(c.encode()) for c in text]).tolist()]
        found = b.BoundarySet(data)
        assert len(found) == len(offsets) == len(text) + 1
        for k in {0, len(text), *range(0, len(text), max(1, len(text) // 500))}:
            assert found.select(k) == offsets[k]


def test_containers_are_the_smallest():
    kinds = {type(c) for t in texts() for _, c in b.BoundarySet(t.encode()).containers}
    assert kinds == {b.ArrayContainer, b.RunContainer, b.BitmapContainer}
    rng = np.random.default_rng(4)
    for offsets in (np.arange(5, 900), np.unique(rng.integers(0, b.SPAN, 300)), np.unique(rng.integers(0, b.SPAN, 30_000)), np.array([0]), np.array([b.SPAN - 1]), np.arange(b.SPAN)):
        held = b.container(offsets)
        assert [held.select(k) for k in range(0, len(offsets), 97)] == offsets[::97].tolist()


def by_hand(doc_id, text, plain, spm, seed):
    """On code points instead of bytes."""
    text = text or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if h[3] % 100 < spm:
        return doc_id, n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("plain", "spm", "seed"), [(10, 20, 1), (0, 50, 2), (100, 0, 3)])
def test_odd_texts_by_hand(spark, docs, plain, spm, seed):
    more = [(1000 + i, t) for i, t in enumerate([*texts(), "<", "<P", "a<P>b", "<S><M>", "<<P", "P>", "<P<S", "x<M", ">S<"] * 8)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    made = b.fill_in_middle(rows, plain, spm, seed)
    want = [by_hand(r["doc_id"], r["text"], plain, spm, seed) for r in rows.collect()]
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted(want, key=repr)
    assert plain == 100 or {"psm", "spm", "plain"} == {w[2] for w in want}
    back = made.select("doc_id", b.restored(made["output"], made["form"]).alias("text"))
    whole = sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=repr)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == whole


def test_clashing_names_and_empty_table(spark, docs, empty):
    assert b.fill_in_middle(empty).count() == 0
    clashing = docs.withColumnsRenamed({"kept": "form", "fp": "n", "row": "output", "size": "t"})
    assert b.digests(b.fill_in_middle(clashing)).count() == docs.count()


def test_digests_of_whole_texts(spark, sf):
    made = queries.QUERIES["op13_fill_in_middle"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in made)
