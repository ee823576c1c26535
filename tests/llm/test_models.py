"""Whole results of fitted models against plain Python: languages, mixture weights, and the pipeline's stages on odd tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from txnrisk.llm import language, lm

SF = "/root/testdata/sf0.001"


def letter_of(sign):
    low = sign.lower()
    return (ord(low) if len(low) == 1 else ord(sign)) if sign.isalpha() else 0


def trigrams(text):
    codes, last = [0], 0
    for sign in text:
        code = letter_of(sign)
        if code or last:
            codes.append(code)
        last = code
    if last:
        codes.append(0)
    return Counter(zip(codes, codes[1:], codes[2:], strict=False)) if len(codes) > 2 else Counter()


def languages_by_hand(rows, dimensions, seed, folds=5):
    letters = {}

    def letter(code):
        if code not in letters:
            letters[code] = np.random.default_rng((seed, code)).integers(0, 2, dimensions) * 2 - 1
        return letters[code]

    def bundle(text):
        total = np.zeros(dimensions)
        for (a, b, c), n in trigrams(text or "").items():
            total += n * np.array([letter(a)[i - 2] * letter(b)[i - 1] * letter(c)[i] for i in range(dimensions)])
        return total

    bundles = [bundle(text) for _, text, _ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i, _, _ in rows]
    sums = defaultdict(lambda: np.zeros(dimensions))
    for (_, text, lang), vector, out in zip(rows, bundles, held, strict=True):
        if lang is not None and text is not None and not out:
            sums[lang] += vector
    prototypes = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if np.linalg.norm(v)}
    found = []
    for (i, text, _), vector, out in zip(rows, bundles, held, strict=True):
        if not trigrams(text or ""):
            found.append((i, out, "und", 0.0))
            continue
        cosines = {k: float(p @ vector / np.linalg.norm(vector)) if np.linalg.norm(vector) else 0.0 for k, p in prototypes.items()}
        best = max(cosines, key=lambda k: (cosines[k], [-ord(c) for c in k]))
        found.append((i, out, best, min(1.0, max(0.0, cosines[best]))))
    return found


def test_languages_by_hand(spark, docs, small):
    """Every prototype and prediction once more, letter by letter."""
    frame = docs.filter("doc_id <> 60 OR doc_id IS NULL").select("doc_id", "text", "lang").unionByName(small.filter("n_chars < 2500").select("doc_id", "text", "lang"))
    rows = [tuple(r) for r in frame.collect()]
    want = sorted(languages_by_hand(rows, 64, 7), key=repr)
    got = sorted((tuple(r) for r in language.identify(frame, dimensions=64).collect()), key=repr)
    assert len(got) == len(rows) > 100
    key = lambda r: (repr(r[0]), round(r[3], 5))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and a[1] == b[1] and a[3] == pytest.approx(b[3], abs=1e-5)
        assert a[2] == b[2] or abs(a[3] - b[3]) < 1e-5


def test_mixture_weights_by_hand():
    """Expectation-maximisation token by token, in a bucket of its own evidence; it never makes the evidence less likely."""
    rng = np.random.default_rng(3)
    cells = {}
    for _ in range(300):
        known = int(rng.integers(1, 4))
        steps = [int(rng.integers(-8, 60)) if rng.random() < 0.7 else -(2**15) for _ in range(known)] + [-(2**15)] * (3 - known)
        cells[",".join(map(str, (known, int(rng.integers(0, 3)), *steps)))] = int(rng.integers(1, 9))
    got = lm.learned_weights(list(cells.items()), 3, rounds=50)
    by = defaultdict(list)
    for cell, n in cells.items():
        known, bucket, *steps = map(int, cell.split(","))
        by[known, bucket] += [[1.0] + [0.0 if s == -(2**15) else 2 ** (s / 8) for s in steps[:known]]] * n
    for key, tokens in by.items():
        w = [1 / len(tokens[0])] * len(tokens[0])
        likely = -math.inf
        for _ in range(50):
            shares = [0.0] * len(w)
            for t in tokens:
                whole = sum(a * b for a, b in zip(w, t, strict=True))
                for i, (a, b) in enumerate(zip(w, t, strict=True)):
                    shares[i] += a * b / whole
            w = [max(s / len(tokens), lm.LEAST_WEIGHT) for s in shares]
            w = [x / sum(w) for x in w]
            now = sum(math.log(sum(a * b for a, b in zip(w, t, strict=True))) for t in tokens)
            assert now >= likely - 1e-6
            likely = now
        assert np.allclose(got[key], w, atol=1e-9)


def test_stages_on_odd_tables(spark, docs, empty):
    """Null, empty and very long texts, repeated rows, null ids and clashing names pass all stages; so does a table without rows."""
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF).checkpoint()
        assert rows.columns == docs.columns and rows.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= rows.count()
    rows = empty
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).checkpoint()
        assert rows.count() == 0, name
