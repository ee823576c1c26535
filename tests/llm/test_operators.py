"""Each operator against brute force on texts that try it, and on the smallest tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnrisk.llm import components, exact_dedup, language, lm, mixing, near_dedup, packing, quality, repeats, token_counts, topk

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def lowered(text):
    return text.encode().lower()


# ---- 1, token counts

VOCABULARY = token_counts.Vocabulary((b"a", b"ab", b"abc", b"xyz"), (b"c", b"cd", b"d", b"bcde", b"yz"))


def greedy(word, v):
    word, n, at = v.mark + word, 0, 0
    while at < len(word):
        pool = v.starts if at == 0 else v.inner
        end = max((at + len(p) for p in pool if word.startswith(p, at)), default=None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@given(st.text("abcdexyz", min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_automaton_counts_the_greedy_pieces(word):
    assert token_counts.Automaton.build(VOCABULARY).count(word.encode()) == greedy(word.encode(), VOCABULARY)


def test_token_counts(docs, empty, small):
    vocabulary = token_counts.byte_level_vocabulary(PATH)
    starts, inner = set(vocabulary.starts), set(vocabulary.inner)

    def count(word):
        word, n, at = b" " + word, 0, 0
        while at < len(word):
            pool = starts if at == 0 else inner
            at = next(e for e in range(len(word), at, -1) if word[at:e] in pool)
            n += 1
        return n

    want = Counter((i, len(t.encode().split()), sum(map(count, t.encode().split())), 0) for i, t in pairs(docs))
    assert Counter(map(tuple, token_counts.token_counts(docs, vocabulary).collect())) == want
    assert token_counts.token_counts(empty, vocabulary).count() == 0
    assert token_counts.token_counts(small, vocabulary).count() == small.count()


# ---- 2, exact top-k

def brute_top(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: min(v for j, v in good if j == i) for i, _ in good if i % 100 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [7, 300])
def test_top_k(spark, n, monkeypatch):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(n)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 1.0]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5), (None, [1.0] * 5), (100, [0.1] * 5), (5, [0.3, 0.1])]
    monkeypatch.setattr(topk, "BLOCK", 2)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = sorted(map(tuple, topk.top_k(frame, lambda c: c % 100 == 0).collect()))
    assert got == brute_top(rows, 10)
    assert topk.top_k(frame.limit(0), lambda c: c % 100 == 0).count() == 0


# ---- 3, language model

def brute_model(rows, order=2):
    tokens = [(i, [b"<s>", *lowered(t).split(), b"</s>"]) for i, t in rows]
    rest = [(zlib.crc32(b"" if i is None else str(i).encode()) % 70, t) for i, t in tokens]
    grams = lambda t, n: [tuple(t[max(0, j + k)] for k in range(1 - n, 1)) for j in range(len(t))]
    every, kept = Counter(), Counter()
    for r, t in rest:
        if r % 7 != 2:
            for n in range(1, order + 1):
                every.update(grams(t, n))
                if r // 7:
                    kept.update(grams(t, n))
    return tokens, rest, grams, every, kept


def parts(t, j, grams, counts, total, order):
    """Estimates of all orders, the longest known order and its bucket, for token j."""
    gram = {n: grams[n][j] for n in range(1, order + 1)}
    context = {1: total} | {n: counts[grams[n - 1][j - 1]] for n in range(2, order + 1)}
    known = 1
    while known < order and context[known + 1] > 0:
        known += 1
    likely = [counts[gram[n]] / max(1, context[n]) for n in range(1, order + 1)]
    return likely, known, int(math.log2(max(1, context[known]))) if known > 1 else 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, small, order):
    for frame in (docs, small):
        rows = pairs(frame)
        tokens, rest, grams, every, kept = brute_model(rows, order)
        words = lambda c: [g for g in c if len(g) == 1 and g != (b"<s>",)]
        n_all, v_all = sum(every[g] for g in words(every)), len(words(every))
        n_kept, v_kept = sum(kept[g] for g in words(kept)), len([g for g in words(kept) if kept[g]])
        cells = Counter()
        for r, t in rest:
            if r % 7 != 2 and r // 7 == 0:
                by = {n: grams(t, n) for n in range(1, order + 1)}
                for j in range(1, len(t)):
                    likely, known, bucket = parts(t, j, by, kept, n_kept, order)
                    steps = [round(math.log2(x * (v_kept + 1)) / lm.STEP) if x and n <= known else -(2**15) for n, x in enumerate(likely, 1)]
                    cells[",".join(map(str, (known, bucket, *steps)))] += 1
        weights = lm.learned_weights(list(cells.items()), order)
        got = defaultdict(list)
        for r in lm.score_documents(frame, order).collect():
            got[r["doc_id"], r["n_tokens"]].append(r)
        for (i, t), (r, _) in zip(tokens, rest, strict=True):
            base = sum(math.log10((every[w,] + 1) / (n_all + v_all + 1)) for w in t[1:])
            by, score = {n: grams(t, n) for n in range(1, order + 1)}, 0.0
            for j in range(1, len(t)):
                likely, known, bucket = parts(t, j, by, every, n_all, order)
                w = weights[known, bucket]
                score += math.log10(w[0] / (v_all + 1) + sum(a * b for a, b in zip(w[1:], likely)))
            mine = got[i, len(t) - 1]
            assert any(
                m["held_out"] == (r % 7 == 2) and m["n_known"] == sum(every[w,] > 0 for w in t[1:]) and m["train_tokens"] == n_all
                and math.isclose(m["base_score"], base, rel_tol=1e-9) and math.isclose(m["score"], score, rel_tol=1e-6) for m in mine
            ), (i, mine, base, score)


def test_language_model_needs_no_rows(empty, spark):
    assert lm.score_documents(empty).count() == 0
    held = next(i for i in range(99) if lm.remainder(i, 7) == 2)
    only = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only["held_out"], only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"], only["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_model_beats_the_base_on_held_out_texts(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    r = lm.score_documents(d).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r["s"] > 0.95 * r["b"]


# ---- 4, near duplicates

def brute_components(rows, k, share):
    sets = []
    for i, t in rows:
        w = lowered(t).split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    label = list(range(len(sets)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and share[1] * len(x & y) >= share[0] * len(x | y):
            label[find(b)] = find(a)
    groups = defaultdict(list)
    for j, (i, _) in enumerate(sets):
        groups[find(j)].append(i)
    least = {g: min((i for i in m if i is not None), default=None) for g, m in groups.items()}
    return Counter((i, len(s), least[find(j)], i == least[find(j)]) for j, (i, s) in enumerate(sets))


def test_near_dedup(docs, empty, small):
    for frame, k in ((docs, 5), (small, 2)):
        got = Counter(map(tuple, near_dedup.near_dedup(frame, k).collect()))
        assert got == brute_components(pairs(frame), k, (4, 5))
    assert near_dedup.near_dedup(empty).count() == 0


def test_chains_and_separate_groups_under_one_key(spark):
    """Texts that drift step by step are one component though its ends share little."""
    rng = random.Random(9)
    now, rows = [f"w{i}" for i in range(80)], []
    for i in range(25):
        rows.append((i, " ".join(now)))
        now[rng.randrange(80)] = f"n{i}"
        now[rng.randrange(80)] = f"m{i}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, near_dedup.near_dedup(frame, 2).collect()))
    assert got == brute_components(rows, 2, (4, 5))


@given(st.lists(st.integers(0, near_dedup.POSITIONS - 1), max_size=near_dedup.DISTANCE, unique=True))
@settings(max_examples=100, deadline=None)
def test_signatures_within_the_distance_share_a_key(places):
    a = np.arange(near_dedup.POSITIONS, dtype=np.uint16)[None, :]
    b = a.copy()
    b[0, places] += 1000
    assert set(near_dedup.chunk_keys(a)[0].tolist()) & set(near_dedup.chunk_keys(b)[0].tolist())


def test_one_of_each_group(docs, empty):
    kept = near_dedup.one_of_each_group(docs, 5)
    assert kept.columns == docs.columns
    want = Counter({i: 1 if i is not None and t.split() else n for (i, t), n in Counter(pairs(docs)).items() if (i, True) in {(x[0], x[3]) for x in brute_components(pairs(docs), 5, (4, 5))}})
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got[70] == 1 and got[50] == 1 and not any(got[i] for i in range(51, 56)) and got[None] == 2
    assert set(got) == set(want)
    assert near_dedup.one_of_each_group(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(200, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 50, **{50 + i: 50 for i in range(30)}, 200: 200, 300: 200}


# ---- 5, exact copies

@given(st.dictionaries(st.integers(0, 2**20 - 1), st.integers(1, 1000), max_size=60), st.dictionaries(st.integers(0, 2**20 - 1), st.integers(1, 1000), max_size=60))
@settings(max_examples=100, deadline=None)
def test_quotient_filters_merge_without_loss(a, b):
    made = []
    for d in (a, b):
        values = np.array(sorted(d), np.uint64)
        made.append(exact_dedup.QuotientFilter.unpack(exact_dedup.QuotientFilter.build(values, np.array([d[v] for v in sorted(d)], np.int64), 20).pack()))
    one = exact_dedup.merged(made, 20)
    assert dict(zip(one.values().tolist(), one.counts.tolist(), strict=True)) == dict(Counter(a) + Counter(b))


@pytest.mark.parametrize("bits", [64, 5])
def test_exact_dedup(docs, empty, bits):
    """With fingerprints of five bits almost all texts collide, and the comparison of bytes has to tell them apart."""
    rows = pairs(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want, first = Counter(), set()
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        stays = i == keep and (lowered(t), i) not in first
        first |= {(lowered(t), i)} if stays else set()
        want[i, keep, len(ids), stays, hashlib.sha256(lowered(t)).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, bits).collect())) == want
    assert exact_dedup.exact_dedup(empty, bits).count() == 0
    kept = exact_dedup.without_copies(docs, bits)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(x[0] for x in want.elements() if x[3])


# ---- 6, repeated passages

def brute_passages(rows, n):
    owners, runs = defaultdict(set), {}
    for i, t in set(rows):
        w = lowered(t).split()
        runs[i, t] = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
        for x in runs[i, t]:
            owners[x].add((i, t))
    want = Counter()
    for (i, _), found in runs.items():
        spans = []
        for j, x in enumerate(found):
            if len(owners[x]) > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + n
                else:
                    spans.append([j, j + n])
        want.update((i, a, b, b - a) for a, b in spans)
    return want


@pytest.mark.parametrize("n", [20, 50])
def test_repeated_passages(docs, empty, small, n):
    for frame in (docs, small):
        assert Counter(map(tuple, repeats.repeated_passages(frame, n).collect())) == brute_passages(pairs(frame), n)
    assert repeats.repeated_passages(empty, n).count() == 0


def test_the_nearest_suffix_need_not_match_to_the_left(spark):
    """The passage of two texts is longer to the left than what a third text, next to them in order, shares with them."""
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(["a1", *w, "z1"])), (2, " ".join(["b1", *w, "y1"]))]
    rows += [(3 + j, " ".join([f"c{j}{i}" for i in range(30)] + w[j:] + ["z1", f"d{j}"])) for j in range(3, 45, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeated_passages(frame, 50).collect())) == brute_passages(rows, 50)


# ---- 7, packing

def check_packing(rows, got, limit=1024):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END]
        cut = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
        for n, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == list(np.cumsum([0] + [n for _, n in held[:-1]]))
        assert sum(n for _, n in held) <= limit
    return len(sequences)


def test_packing(docs, empty, small):
    for frame in (docs, small):
        rows = pairs(frame)
        got = packing.pack(frame, PATH).collect()
        n = check_packing(rows, got)
        lengths = np.bincount([r["length"] for r in got], minlength=1025)
        assert packing.least_sequences(lengths, 1024) <= n <= sum(f.times for f in packing.best_fit(lengths, 1024))
    assert packing.pack(empty, PATH).count() == 0


def brute_bins(items, limit):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= limit:
                put(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_bin_completion_finds_the_least(items):
    counts = np.bincount(items, minlength=21)
    found = packing.complete_bins(counts, 20, nodes=5000, width=50, most=20)
    assert sum(f.times for f in found) == brute_bins(sorted(items, reverse=True), 20)
    held = Counter()
    for f in found:
        for length, n in f.lengths:
            held[length] += n * f.times
    assert held == Counter(items)


@pytest.mark.parametrize("n", [16, 160])
def test_short_pieces_fill_their_sequences(n):
    """Three pieces of 150, four of 115 and one of 114 tokens are a sequence; best fit takes a sixteenth more."""
    counts = np.zeros(1025, np.int64)
    counts[[150, 115, 114]] = 3 * n, 4 * n, n
    assert sum(f.times for f in packing.best_fit(counts, 1024)) > n
    found = packing.complete_bins(counts, 1024)
    assert sum(f.times for f in found) == n
    held = Counter()
    for f in found:
        for length, each in f.lengths:
            held[length] += each * f.times
    assert held == {150: 3 * n, 115: 4 * n, 114: n}


@given(st.lists(st.sampled_from([*"a .\n\t\u3000 1é's|<", "the", " the", "<|endoftext|>", "word, ", "…", "«x»", "\r\n"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_ranks_give_the_tokenizers_ids(text):
    known = test_ranks_give_the_tokenizers_ids.__dict__
    ids = known.setdefault("ids", None) or known.update(ids=packing.TextIds(PATH)) or known["ids"]
    assert ids.ranks is not None
    for t in (text, text[::-1]):
        assert np.frombuffer(ids(t.encode()), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_encode_themselves():
    ids = packing.TextIds(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.ranks is None and np.frombuffer(ids(b"two words"), "<u4").tolist() == ids.tokenizer.encode("two words", add_special_tokens=False).ids


def test_ranks_agree_for_letters_of_all_scripts():
    ids = packing.TextIds(PATH)
    for at in range(0, 0x110000, 0x400):
        text = "".join(f"a{c} {c}1{c}{c}.  {c}" for c in map(chr, range(at, at + 0x400, 17)) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


# ---- 8, mixing

def test_targets():
    sizes = {"a": 100, "b": 10, None: 0, "c": 1000}
    weights = mixing.cyclic_weights(list(sizes))
    assert weights == {"a": 1, "b": 2, "c": 3, None: 1}
    got = mixing.targets(sizes, weights, 1110, 3)
    assert got["b"] == 30 and got[None] == 0 and math.isclose(got["a"], 270) and math.isclose(got["c"], 810)
    assert mixing.targets({}, {}, 0, 3) == {}


def test_mix(docs, empty, small):
    for frame in (docs, small):
        rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in frame.collect()]
        got = mixing.mix(frame).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for i, _, n in rows)
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        wanted = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), sum(sizes.values()), 3)
        taken, largest, by_id = Counter(), Counter(), {i: s for i, s, _ in rows if i is not None}
        for r in got:
            assert r["taken"] in [k * r["size"] for k in range(4)]
            if r["doc_id"] is not None:
                s = by_id[r["doc_id"]]
                assert r["source_size"] == sizes[s] and math.isclose(r["target"], wanted[s])
                taken[s] += r["taken"]
                largest[s] = max(largest[s], r["size"])
        for s, n in taken.items():
            if s not in ("a", "é"):  # one holds a text without id, the other a repeated row
                assert abs(n - wanted[s]) <= largest[s] / 2 + 1
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixed_rows(docs, empty):
    rows, taken = mixing.mixed_rows(docs), mixing.mix(docs)
    assert rows.columns == docs.columns
    want = Counter()
    for r in taken.collect():
        want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert Counter(r["doc_id"] for r in rows.collect()) == +want
    assert mixing.mixed_rows(empty).count() == 0


def test_whole_rows_of_the_mix_stay_out_of_python(docs):
    """Ids and texts go to Python once; what comes back are a size and a key."""
    plan = mixing.mixed_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    keys = docs.select("doc_id", "text", mixing.key_of().alias("k")).select("doc_id", "k.size", "k.u")
    assert sorted(map(repr, keys.collect())) == sorted(map(repr, mixing.keyed(docs, ["doc_id"]).withColumnRenamed("c0", "doc_id").collect()))


def test_heavier_documents_come_first(spark):
    """With weights 3 to 1 and half of all words wanted, the heavier half is taken about three times as often at first."""
    frame = spark.createDataFrame([(i, "s", ("heavy" if i % 2 else "light") + " w" * 9) for i in range(4000)], "doc_id long, source string, text string")
    got = mixing.mix(frame, quality=lambda t: 3.0 if t.startswith(b"heavy") else 1.0, total=0.1).filter("taken > 0").collect()
    heavy = sum(r["doc_id"] % 2 for r in got)
    assert abs(sum(r["taken"] for r in got) - 4000) <= 10 and 2.3 < heavy / (len(got) - heavy) < 3.9


def first_fit(docs, budget):
    """Words taken from (size, u) in the order of u, what is too long passed over, and the nearest one at the end."""
    left, rest = budget, []
    for u, size in sorted((u, size) for size, u in docs):
        if size <= left:
            left -= size
        else:
            rest.append(size)
    near = min((abs(size - left) for size in rest), default=left)
    return budget - left + (left + near if near < left and left + near in rest else left - near if near < left else 0)


def test_documents_behind_a_long_one_are_taken(spark, monkeypatch):
    """A document that is longer than what is left of the budget ends neither its source nor the search."""
    monkeypatch.setattr(mixing, "AT_ONCE", 16)
    rng = random.Random(3)
    rows = [(i, s, " ".join(["w"] * n)) for s, sizes in {"long": [20_000] + [100] * 200, "mixed": [rng.choice([1, 7, 40, 300, 2500]) for _ in range(150)]}.items() for i, n in enumerate(sizes, 1000 * (s == "mixed"))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    marks = mixing.keyed(frame, ["source"]).collect()
    for total in (0.1, 0.45):
        taken, target = Counter(), {}
        for r in mixing.mix(frame, total=total, weights=lambda sources: dict.fromkeys(sources, 1)).collect():
            s = "long" if r["doc_id"] < 1000 else "mixed"
            taken[s] += r["taken"]
            target[s] = r["target"], r["source_size"]
        for s, (wanted, size) in target.items():
            epochs = wanted // size
            assert taken[s] == epochs * size + first_fit([(m["size"], m["u"]) for m in marks if m["c0"] == s], wanted - epochs * size), (s, total)


def test_a_round_takes_a_bounded_part_of_a_source(spark, monkeypatch):
    """Also where most keys lie in one narrow range, and whatever the number of rows that share a key."""
    monkeypatch.setattr(mixing, "AT_ONCE", 50)
    rows = [("a", 0.3 + i * 1e-9) for i in range(4000)] + [(None, (i + 0.5) / 300) for i in range(300)] + [("few", 0.5)] * 20 + [("tied", 0.25)] * 500
    frame = spark.createDataFrame(rows, "source string, u double")
    ends = mixing.next_ends(frame, {"a": 0.0, None: 0.5, "few": 0.0, "tied": 0.0, "none": 0.0})
    got = {s: sum(r[0] == s and {"a": 0.0, None: 0.5}.get(s, 0.0) <= r[1] < end for r in rows) for s, end in ends.items()}
    assert 50 <= got["a"] <= 100 and 50 <= got[None] <= 100 and got["tied"] == 500 and got["few"] == 20
    assert ends["few"] == mixing.END and "none" not in ends


def test_large_keys_stay_apart(spark):
    """Documents of low quality have large keys; each still has a u of its own, below 1."""
    frame = spark.range(50_000).selectExpr("id AS doc_id", "'1234' AS text")
    got = mixing.keyed(frame, ["doc_id"]).agg(F.countDistinct("u").alias("n"), F.max("u").alias("most")).first()
    assert got["n"] == 50_000 and got["most"] < 1


# ---- 9, quality

def test_quality(spark, empty):
    sf = SF.replace("0.001", "0.1")
    d, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.score_documents(d, labels, sample=1500)
    held = got.withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t").join(labels, "doc_id").collect()
    assert got.count() == d.count()
    right = lambda rows: sum(r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in rows) / len(rows)
    assert right(held) > 0.9
    clean = [r for r in held if r["quality"] == 1 and r["toxic"] == 0]
    assert right(clean) > 0.95


def test_rare_words_of_one_class_count():
    """Of 100 toxic and 800 clean documents, 5 or 19 toxic ones and no clean one have a word; it has to tell something."""
    five, nineteen, both, once, clean = quality.log_odds(np.array([5.0, 19, 40, 1, 0]), np.array([0.0, 0, 320, 0, 300]), 100, 800)
    assert nineteen > five > 1 and abs(both) < 0.01 and 0 < once < 0.2 and clean < -1


def test_all_digits_and_all_standalone_marks_count():
    about = lambda text: quality.meta_features(text, "s", "en")
    assert all(about(b"ab%d cd%d word %d" % (d, d, d)) == about(b"ab0 cd0 word 0") != about(b"abx cdx word x") for d in range(10))
    marks = [bytes([c]) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    assert len(marks) == 32 and all(about(b"one %s two %s three" % (m, m)) == about(b"one | two | three") for m in marks)
    assert all(b"~" + m in quality.content_words(b"one " + m + b" two") for m in marks)


def test_features_are_kept_as_bytes(docs, empty):
    """What the exchanges read holds no lists of numbers; read back, it is the features of each document."""
    rows = docs.select("doc_id", "source", "lang", "text")
    made = quality.with_features(rows.coalesce(1))
    assert {f.dataType.typeName() for f in made.schema.fields if f.name != "doc_id"} == {"binary"}
    table, texts = made.toArrow().combine_chunks(), rows.coalesce(1).collect()
    for batch in (table.to_batches()[0], table.to_batches()[0].slice(5, 9), table.to_batches()[0].slice(0, 0)):
        about = texts if batch.num_rows == len(texts) else texts[5:14] if batch.num_rows else []
        for (flat, owner), of in zip(quality.places_of(batch), (
                lambda r: quality.text_features((r["text"] or "").encode(), quality.KnownPlaces()),
                lambda r: quality.meta_features((r["text"] or "").encode(), r["source"], r["lang"])), strict=True):
            assert [sorted(of(r)) for r in about] == [flat[owner == i].tolist() for i in range(len(about))]
    assert quality.with_features(empty.select("doc_id", "source", "lang", "text")).count() == 0


def test_views_learn_in_turn_from_all_unlabelled_documents(spark, monkeypatch):
    """Words and sources form a chain that starts at the labels: each link is learned only after the one before it, from the
    other view. One exchange reaches the first link only."""
    rows, labels, at = [], [], 0
    for side in (0, 1):
        for link in range(5):
            for _ in range(200):
                # A link joins its word to the source of the same number or the next one.
                rows.append((at, f"s{side}{link}" if at % 2 else f"s{side}{link + 1}", "en", f"{'pq'[side]}{'abcdef'[link] * 5}"))
                if link == 0 and at % 2:
                    labels.append((at, side, 1 - side))
                at += 1
    frame = spark.createDataFrame([*rows, (None, "s00", "en", "paaaaa")], "doc_id long, source string, lang string, text string").repartition(2)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.unlabelled(frame, given).count() == len(rows) + 1 - len(labels)
    passes, tally = [], quality.tally
    monkeypatch.setattr(quality, "tally", lambda rows, *a: passes.append(tally(rows, *a)) or passes[-1])
    got = {r["doc_id"]: r["quality"] for r in quality.score_documents(frame, given).collect()}
    assert len(passes) > 3 and (passes[-1][1] <= 0.01 * len(rows)).all()
    assert all(got[i] < 0.5 for i in range(400, 1000)) and all(got[i] > 0.5 for i in range(1400, 2000))


def test_quality_of_odd_tables(docs, empty, spark):
    schema = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0), "x") for i in range(10, 56)] + [(None, 1, 1, "x"), (11, None, 0, "x"), (12, 1, 0, "x")], schema)
    got = quality.score_documents(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(docs)) and all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in got)
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {(r["quality"], r["toxic"], r["kept"]) for r in none} == {(0.5, 0.5, False)}
    assert quality.score_documents(empty, labels).count() == 0


# ---- 10, languages

def test_language(small, docs, empty):
    got = language.identify(small)
    held = got.join(small.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.9
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["lang_pred"] in ("en", "fr", "und")) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language.identify(empty).count() == 0
    kept = language.in_a_language(docs)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def test_short_texts_stay(small):
    """Every text with a letter that is too short for its cosine to say anything stays; noise of some length goes."""
    rng = random.Random(5)
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.8 else " " for _ in range(400)) for _ in range(20)]
    rows = [(-1 - i, t) for i, t in enumerate(["a", "Ok", "hello there", "x y z", *noise, "", None, "12 34"])]
    extra = small.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in language.in_a_language(small.select("doc_id", "text", "lang").unionByName(extra)).collect()}
    assert {-1, -2, -3, -4} <= kept and not kept & {-25, -26, -27}
    assert sum(-5 - i in kept for i in range(20)) <= 2
    assert {r["doc_id"] for r in small.filter("text rlike '[a-z]'").collect()} <= kept


def test_nothing_learned(docs):
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_cosines_are_those_of_the_bundled_vectors(spark):
    alphabet, vectors = language.Alphabet(), language.Vectors(64, 7)
    grams = alphabet.grams("Ab, ab!")
    total = np.zeros(64)
    for word in ("\0ab", "ab\0", "b\0a"):
        a, b, c = (vectors.letter(ord(x)) for x in word)
        total += (np.roll(a, 2) * np.roll(b, 1) * c) * (1 if word == "b\0a" else 2)
    assert np.allclose(vectors.bundle(*language.sorted_counts(grams)), total)
