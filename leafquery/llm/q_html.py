"""op1: main text of the pages."""

from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.common import table
from leafquery.llm.html_crf import extract_pages


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
