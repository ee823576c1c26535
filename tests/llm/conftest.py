import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, row string, size string, score string, key string, uid string, rank string, block string"


def words(rng, n, base=60):
    return " ".join(rng.choice("abcdefghij") + rng.choice("aeiou") + str(rng.randrange(base)) for _ in range(n))


def corpus():
    """Texts that try the operators: null, empty, blank, one word, copies, near copies, a shared passage, a very long text,
    repeated rows, a null id, letters of several scripts, and columns whose names the operators use themselves."""
    rng = random.Random(4)
    passage = words(rng, 64)
    rows = [(1, None, "en", "b"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "a"), (5, "ONE", "fr", "b"), (6, "one", None, "B")]
    rows += [(10 + i, words(rng, 30 + 7 * i), "en" if i % 2 else "fr", "abc"[i % 3]) for i in range(12)]
    rows += [(30 + i, words(rng, 20) + " " + passage + " " + words(rng, 15 + i), "en", "a") for i in range(4)]
    near = words(rng, 120).split()
    for i in range(6):
        changed = list(near)
        changed[17 * i + 3] = f"new{i}"
        rows.append((50 + i, " ".join(changed), "fr", None))
    rows += [(60, words(rng, 30_000, 5000), "en", "c")]
    rows += [(70, "Ünï çødé — 日本語 テスト \x00 end", "fr", "é"), (70, "Ünï çødé — 日本語 テスト \x00 end", "fr", "é"), (None, "no id here at all", "en", "a"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), *(f"x{j}" for j in range(9))) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
