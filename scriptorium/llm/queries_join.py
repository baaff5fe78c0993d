"""Query of the similarity join, with its SQL: all pairs of sets that share a shingle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard
from ._common import table


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_join": op5_ngram_join}
JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))) END AS s FROM words
), sets AS (SELECT s, len(s) AS n, min(doc_id) AS k FROM shingled WHERE len(s) > 0 GROUP BY s),
holders AS (SELECT k, n, unnest(s) AS g FROM sets),
links AS (SELECT a.k AS x, b.k AS y FROM holders a JOIN holders b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT k, k AS root FROM sets UNION SELECT b.y, r.root FROM reached r JOIN both_ways b ON b.x = r.k),
roots AS (SELECT k, min(root) AS component_id FROM reached GROUP BY k)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id
FROM shingled d LEFT JOIN sets t ON t.s = d.s LEFT JOIN roots r ON r.k = t.k
"""
ORACLES = {"op5_ngram_join": JOIN_SQL}
