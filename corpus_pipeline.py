"""A training-data pipeline over ``documents``: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, jaccard, substrings, toxicity
from gaugeworks.llm.queries import labelled, word_tokenizer
from gaugeworks.session import scratch_path


def _as_given(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, those beyond the five of the table included, in their order."""
    return found.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model, fitted on the labelled ones, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labelled(docs, labels, "toxic", toxicity.SAMPLE))
    return _as_given(toxicity.accepted(docs, model), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every group of near copies."""
    return _as_given(jaccard.one_of_each(docs), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that repeat a window of an earlier document; every document stays."""
    cut = substrings.drop_repeats(docs)
    return _as_given(cut.withColumn("n_chars", F.length("text").cast("long")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _as_given(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text that they decode to."""
    found = bpe.encode(docs, word_tokenizer())
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]
# Fitted trees, components and merges are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
