"""The registered queries and the pipeline on the smallest tables."""

import sys
from pathlib import Path

import pytest
from test_operators import SF, check_packing, pairs

sys.path.insert(0, str(Path(__file__).parents[1]))

import __spark_entry__ as driver  # noqa: E402
import corpus_pipeline  # noqa: E402
from compare import compare, duck  # noqa: E402
from txnrisk.llm import near_dedup, queries  # noqa: E402

NAMES = """op1_token_counts op2_exact_top_k op3_lm_scoring op4_minhash_near_dedup op5_exact_dedup op6_suffix_array_dedup
op7_best_fit_packing op8_mixing op9_quality_classifier op10_language_id op11_embedding_near_dedup op12_centroid_clustering
op13_fill_in_middle""".split()


def test_all_are_registered():
    assert list(queries.QUERIES) == NAMES
    assert {*NAMES, "pipeline"} <= set(driver.queries()) and set(queries.ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


def test_stages_follow_each_other(spark, small):
    docs, kept = small, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == small.columns, name
        kept.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    languages, exact, near, mixed = (pairs(d) for d in kept)
    assert len(languages) > 0.95 * small.count()
    latest = {}
    for i, t in languages:
        latest[t.encode().lower()] = max(i, latest.get(t.encode().lower(), i))
    assert sorted(i for i, _ in exact) == sorted(latest.values())
    told = near_dedup.near_dedup(kept[1]).filter("kept").select("doc_id").collect()
    assert sorted(i for i, _ in near) == sorted(r["doc_id"] for r in told)
    assert set(mixed) <= set(near)
    check_packing(mixed, corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
