"""op2: near-duplicate groups of documents."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.minhash import near_duplicates


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}

ORACLES = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM w),
s AS (SELECT doc_id, unnest(s) AS sh FROM sets),
n AS (SELECT doc_id, len(s) AS n FROM sets),
e AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2) p
  JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y
  WHERE 100 * p.c >= 85 * (nx.n + ny.n - p.c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, via) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT b.y, r.via FROM reach r JOIN both_ways b ON b.x = r.doc_id WHERE r.via < b.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.via AS component_id, r.via = n.doc_id AS kept
FROM n JOIN (SELECT doc_id, min(via) AS via FROM reach GROUP BY 1) r ON r.doc_id = n.doc_id
"""
}
