"""The stateless corpus build over a folder that keeps receiving files.

Cleaning, lexing and the hash split look at one row at a time, so the same expressions run on a
stream without state, watermark or shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.splitting import hash_split
from lexmill.plans.corpora import clean_and_tokenize


def read_code_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def write_corpus_stream(
    stream: DataFrame, path: str, checkpoint: str, key: str = "code", id_column: str = "id", seed: str = ""
) -> StreamingQuery:
    """Append cleaned and tokenised rows, one folder per split, until the input is used up."""
    built = hash_split(clean_and_tokenize(stream, key), id_column, seed)
    return (
        built.writeStream.format("parquet")
        .partitionBy("split")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
