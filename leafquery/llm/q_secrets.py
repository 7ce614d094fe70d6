"""op5: secrets in documents."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.secrets import findings


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
