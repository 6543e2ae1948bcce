"""Retrieval quality against known relevant passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import union_all
from gaugeworks.functions.text import filled


def mark_hits(retrieved: DataFrame, relevant: DataFrame, question_key: str = "question_id", passage_key: str = "passage_id") -> DataFrame:
    """Adds ``hit`` to retrieved rows from (question, passage) pairs of known relevance."""
    pairs = relevant.select(question_key, passage_key).distinct().withColumn("hit", F.lit(True))
    rows = retrieved.join(pairs, [question_key, passage_key], "left")
    return rows.withColumn("hit", F.coalesce("hit", F.lit(False)))


def relevant_counts(relevant: DataFrame, question_key: str = "question_id", passage_key: str = "passage_id") -> DataFrame:
    pairs = relevant.select(question_key, passage_key).distinct()
    return pairs.groupBy(question_key).agg(F.count(F.lit(1)).alias("n_relevant"))


def question_metrics(
    counts: DataFrame, marked: DataFrame, k: int = K.TOP_K, depth: int = K.MRR_DEPTH, question_key: str = "question_id"
) -> DataFrame:
    """precision@k, recall@k and reciprocal rank per question.

    ``counts`` has one row per question with ``n_relevant``; ``marked`` is the ranked result
    with ``hit``. Precision divides by k even when fewer passages came back.
    """
    inside = F.col("hit") & (F.col("rank") <= k)
    first = F.min(F.when(F.col("hit") & (F.col("rank") <= depth), F.col("rank")))
    per_question = marked.groupBy(question_key).agg(
        F.count_if(inside).alias("hits"), first.alias("first_hit")
    )
    rows = counts.join(per_question, question_key, "left")
    hits, n = F.coalesce("hits", F.lit(0)), F.col("n_relevant")
    return rows.select(
        question_key,
        (F.lit(0.0) if k <= 0 else hits / F.lit(k)).alias("precision_at_k"),
        F.when(n > 0, hits / n).otherwise(0.0).alias("recall_at_k"),
        F.when(n > 0, F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).otherwise(0.0).alias("reciprocal_rank"),
    )


def question_set_means(metrics: DataFrame) -> DataFrame:
    """Means over the questions; no question gives zeros."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(
        F.count(F.lit(1)).alias("n_queries"), mean("precision_at_k").alias("avg_precision_at_k"),
        mean("recall_at_k").alias("avg_recall_at_k"), mean("reciprocal_rank").alias("avg_mrr"),
    )


def synthetic_questions(passages: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """n sampled passages as questions with that passage as the only relevant one.

    The sample is the n smallest seeded hashes, so it repeats, and only n rows per task travel.
    """
    rows = passages if "category" in passages.columns else passages.withColumn("category", F.lit(""))
    cases = []
    for kind, column, template in K.QUESTION_TEMPLATES:
        told = F.lit(template) if column is None else filled(template, F.lower(column) if column == "question" else F.col(column))
        fits = F.lit(True) if kind is None else F.col("dataset_type") == kind
        # The last template of a type needs no value.
        if column in ("question", "category"):
            fits = fits & (F.coalesce(column, F.lit("")) != "")
        cases.append(F.when(fits, told))
    place = F.md5(F.concat(F.col("passage_id"), F.lit(f":{seed}")))
    sampled = rows.orderBy(place, "passage_id").limit(n)
    return sampled.select(F.coalesce(*cases).alias("question"), "passage_id")


def history(runs: list[DataFrame] | DataFrame, limit: int = 10) -> DataFrame:
    """Stored evaluation runs (with ``ts``), newest first."""
    table = runs if isinstance(runs, DataFrame) else union_all(runs)
    return table.orderBy(F.desc("ts")).limit(limit)
