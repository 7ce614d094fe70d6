"""op3: near-duplicate embeddings."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.embedding import near_vectors


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}

ORACLES = {
    "op3_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(vec_id, via) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.y, r.via FROM reach r JOIN l ON l.x = r.vec_id WHERE r.via < l.y)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, r.via AS component_id, r.via = v.vec_id AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY 1) n ON n.x = v.vec_id
JOIN (SELECT vec_id, min(via) AS via FROM reach GROUP BY 1) r ON r.vec_id = v.vec_id
"""
}
