"""op7: token ids in bit-packed files, read back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafquery.llm.bitpack import read_ids, write_ids
from leafquery.llm.common import table


def op7_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


QUERIES = {"op7_bit_packed_ids": op7_bit_packed_ids}
