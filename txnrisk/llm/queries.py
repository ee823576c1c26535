"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txnrisk.llm import boundaries, centroids, exact_dedup, language, lattice, lm, mixing, near_dedup, packing, quality, repeats, token_counts, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    vocabulary = token_counts.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


@query
def op2_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


ORACLES["op2_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op3_lm_scoring(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=2, share=(80, 100))


@query
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


@query
def op6_suffix_array_dedup(spark, sf_dir):
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op9_quality_classifier(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op11_embedding_near_dedup(spark, sf_dir):
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op11_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.row_no AS a, b.row_no AS b FROM good a JOIN good b ON a.row_no <> b.row_no AND len(a.e) = len(b.e)
          AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT row_no, row_no FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.row_no) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT r.a, min(w.vec_id) AS component_id FROM reach r JOIN v w ON w.row_no = r.b GROUP BY r.a) c ON c.a = v.row_no"""


@query
def op12_centroid_clustering(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, width=64, seed=1)


def clustering_sql(k: int, rounds: int, scale: int, width: int, seed: int) -> str:
    """The rounds written out one after another."""
    steps = [f"""v AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT row_no, vec_id, v.e, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} c),
a{i} AS (SELECT row_no, vec_id, e, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""t{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY c, i),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM t{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(f.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""


ORACLES["op12_centroid_clustering"] = clustering_sql(16, 3, 64, 64, 1)


@query
def op13_fill_in_middle(spark, sf_dir):
    return boundaries.digests(boundaries.fill_in_middle(table(spark, sf_dir, "documents"), plain=10, spm=20, seed=1))


ORACLES["op13_fill_in_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, x, length(x) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM t),
w AS (SELECT doc_id, x, n, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high FROM u),
p AS (SELECT *, substr(x, 1, low) AS prefix, substr(x, low + 1, high - low) AS middle, substr(x, high + 1, n - high) AS suffix FROM w)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(x) AS restored_sha256 FROM p"""
