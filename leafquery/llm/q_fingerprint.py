"""op6: fingerprints of documents and of their edited texts."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.fingerprint import fingerprints


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
