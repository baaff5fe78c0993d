"""Queries over ``embeddings``, with the SQL of exact search and exact links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, topk
from ._common import table


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5
"""

DEDUP_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached AS (SELECT vec_id, vec_id AS root FROM usable UNION SELECT l.y, r.root FROM reached r JOIN links l ON l.x = r.vec_id),
roots AS (SELECT vec_id, min(root) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(r.component_id, e.vec_id) AS component_id, coalesce(r.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN roots r ON r.vec_id = e.vec_id LEFT JOIN counts c ON c.vec_id = e.vec_id
"""

QUERIES = {f.__name__: f for f in (op8_exact_topk, op10_embedding_dedup)}
ORACLES = {"op8_exact_topk": TOPK_SQL, "op10_embedding_dedup": DEDUP_SQL}
