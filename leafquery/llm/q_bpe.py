"""op9: byte-level BPE, encoded and decoded."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.bpe import encode_documents
from leafquery.llm.common import table


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False).drop("valid_utf8")


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
