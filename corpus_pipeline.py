"""A training-data pipeline of five stages. Each stage is written as Parquet and read again as the
next one's documents; all but the last return rows with the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farewatch.llm import decontaminate, language_id, mixing, ngram_join, token_store
from farewatch.llm.common import read_table, scratch_path

# the last stage's workers share their executor with what the stages before left in its heap
MEMO_WORDS, ENCODE_CHARS = 100_000, 1_000_000
ARROW_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that Spark sends to a Python worker at a time: the executor and the worker each
    hold a batch of texts. Stays set, as a stage's frame is run after the stage returns it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the models and the limits come from these documents' labels."""
    small_batches(spark)
    return language_id.keep_accepted(docs, language_id.fit(language_id.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights."""
    return mixing.emit(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token ids, written as compressed blocks; what the files hold per document."""
    small_batches(spark)
    path = scratch_path(spark, "pipeline-tokens")
    return token_store.read_documents(spark, token_store.write_tokens(docs, path, memo_words=MEMO_WORDS, encode_chars=ENCODE_CHARS))


STAGES = [("language ID", languages), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_free),
          ("mixing", mixture), ("token ids", token_ids)]

ORACLE_SQL = None       # language models and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{k + 1}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    return out
