"""From raw documents to token ids: five stages, each an operator of larkspur.llm over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, decontamination, language, line_dedup, minhash
from larkspur.llm.common import table, written
from larkspur.llm.registry import tokenizer_path

#: Rows of an Arrow batch, at most; Spark's default is 10,000.
BATCH_ROWS = "500"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers BATCH_ROWS at a time: batches take memory in the JVM and in the worker, outside any heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Those without a letter, or far from every learned language, go."""
    _small_batches(spark)
    return language.identify(docs, language.fit(docs)).where(~F.col("rejected")).select(*COLUMNS)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that no earlier line equals or nearly equals; n_chars follows. Those that lose every line go."""
    out = line_dedup.dedup_lines(docs)
    return out.where("n_dropped = 0 OR n_dropped < n_lines").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return minhash.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    _small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, packed, and digests of the ids and of what they decode to."""
    _small_batches(spark)
    both = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text"), tokenizer_path()).alias("both"))
    rows = both.select("doc_id", "lang", "source", "both.token_ids", F.col("both.token_ids").alias("ids"), "both.decoded")
    return bpe.digest(rows, ids="ids")


STAGES = [
    ("language ID", language_id),
    ("line dedup", deduplicate_lines),
    ("MinHash near-dedup", deduplicate_documents),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]
#: Learned models, hashed signatures and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
