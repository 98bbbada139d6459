"""Registered queries of the operators that compare documents or vectors (4, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblake.llm import embeddings, minhash


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {f.__name__: f for f in (op4_embedding_near_dedup, op10_weighted_minhash)}
ORACLES = {
    "op4_embedding_near_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
           AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.x),
    n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM v LEFT JOIN n ON n.x = vec_id JOIN (SELECT x, min(c) AS component_id FROM reach GROUP BY x) m ON m.x = vec_id
    """,
}
