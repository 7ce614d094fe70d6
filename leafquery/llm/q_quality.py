"""op8: quality scores."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.quality import classify


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
