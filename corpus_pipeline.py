"""The corpus pipeline: five stages, each one operator, over ``documents``.

Every stage takes what its predecessor kept and returns the columns of
``documents``, the last one the pieces of the packed sequences.  Rows with null
doc_ids pass the filtering stages; rows that share a doc_id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riselens.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from riselens.llm.common import table
from riselens.session import checkpoint


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    toxic = toxicity.score(docs, model).where("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur earlier, exactly or nearly."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class (five-word shingles, 0.8)."""
    dropped = minhash_dedup.near_duplicates(docs, width=5).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Not expressible in SQL: a trained model, sketches, a tokenizer and a dynamic program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
