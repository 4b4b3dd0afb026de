"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riselens.llm import alignment, decontamination, divergence, line_dedup, minhash_dedup, packing, pieces, pii, quality, sharding, substring_dedup, token_counts, toxicity
from riselens.llm.common import table

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its worst sentence."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base values and verdict of every document."""
    return quality.filter_quality(table(spark, sf_dir, "documents"))


ORACLE["op6_quality_rules"] = quality.ORACLE_SQL


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur earlier, in the same or another document."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the evidence."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word, and whether it is the first of its class."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii.surrogate_texts(table(spark, sf_dir, "documents"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers cover every document, against the corpus's pair counts."""
    return alignment.link_statistics(table(spark, sf_dir, "documents"))


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    rows = pieces.round_trip(table(spark, sf_dir, "documents"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that set each apart."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = divergence.ORACLE_SQL
