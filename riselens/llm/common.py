"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riselens.session import configure

#: Fixed value: the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_docs(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named extra columns; clashing names go.

    Also fills in the session's unset settings, of which the bytes of an Arrow
    batch bound the memory of the Python workers that get these rows.
    """
    configure(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def hash2(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: together a 128-bit identity of a value."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]
