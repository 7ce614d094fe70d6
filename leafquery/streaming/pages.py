"""The same statements over pages as they arrive. Parsing and row expressions keep no state, so they stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafquery.api import Engine
from leafquery.lang.lexer import QueryError
from leafquery.lang.parser import parse


def read_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def query_stream(spark: SparkSession, pages: DataFrame, text: str) -> DataFrame:
    """A streaming result of a statement over one document source, without joins."""
    q = parse(text)
    if q.ctes or q.joins or q.items[0].kind in ("summarize", "tfidf"):
        raise QueryError("SEM-0305", "only statements within a document can stream")
    return Engine.of_table(spark, pages).execute(text)


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
