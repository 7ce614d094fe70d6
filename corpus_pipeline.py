"""The corpus pipeline: quality classifier, near-duplicate removal, secret scan, packing.

Every stage works on all rows that the stage before kept; run() writes nothing between them, a caller that wants to
restart at a stage writes its result as Parquet and passes it on as docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquery.llm.common import materialize, table
from leafquery.llm.minhash import BROADCAST_IDS, near_duplicates
from leafquery.llm.packing import pack
from leafquery.llm.quality import keep_good
from leafquery.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go. Empty texts are judged like others."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more) one row stays, that of least id.

    Rows are told apart by a key of their own, so of rows that repeat an id one stays like of others; rows without an
    id come after those with one. Texts without words have no duplicates and stay.
    """
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "near-dedup-rows")
    ids = keyed.select("__row", "doc_id")
    groups = near_duplicates(keyed, words=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    kept = ids.join(groups, "__row").groupBy("component_id").agg(F.min(first).alias("first")).select("first.__row")
    gone = materialize(ids.join(kept, "__row", "left_anti").select("__row"), "near-dedup-gone")
    small = gone.count() <= BROADCAST_IDS
    return keyed.join(F.broadcast(gone) if small else gone, "__row", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays. n_chars is that of the new text."""
    out = redact(docs, path_col="source")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of the permitted lengths."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: Neither the forest nor the classifier nor the packing can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
