"""op10: documents packed into sequences of five lengths."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.packing import pack


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
