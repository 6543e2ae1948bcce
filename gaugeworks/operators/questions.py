"""Question intent, target datasets, evidence labels and log predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import union_all
from gaugeworks.functions.text import contains_any, first_rule


def intent(question: Column | str) -> Column:
    text = F.lower(F.col(question) if isinstance(question, str) else question)
    return first_rule(text, K.INTENT_HINTS, K.DEFAULT_INTENT)


def classify_questions(df: DataFrame, question: str = "text") -> DataFrame:
    """Adds the intent and whether an answer needs cited evidence."""
    return df.withColumn("intent", F.coalesce(intent(question), F.lit(K.DEFAULT_INTENT))).withColumn(
        "needs_evidence", F.col("intent").isin(*K.EVIDENCE_INTENTS)
    )


def _capable(intent_col: Column, has_text: Column, has_numeric: Column) -> Column:
    return (
        F.when(intent_col == "qualitative", has_text)
        .when(intent_col == "quantitative", has_numeric)
        .otherwise(F.lit(True))
    )


def target_datasets(df: DataFrame, profiles: DataFrame, key: str, question: str = "text") -> DataFrame:
    """(key, intent, dataset_name): the datasets a question should look into.

    ``profiles`` has name, dataset_type, has_text and has_numeric. A dataset is a target when
    the question names it or its type, or when it can serve the intent. Names and types are found by
    an equi-join with the question's substrings of the lengths that they have. All datasets that can
    serve an intent belong to the result of every question with that intent, so it is as large.
    """
    asked = classify_questions(df.select(key, F.col(question).alias("_q")), "_q").withColumn("_t", F.lower("_q"))
    named = profiles.select("name", F.explode(F.array(F.lower("name"), F.lower("dataset_type"))).alias("_n")).where(F.col("_n").isNotNull())
    # Distinct lengths of names are few, whatever the registry.
    lengths = named.agg(F.collect_set(F.char_length("_n")).alias("_l"))
    starts = asked.crossJoin(F.broadcast(lengths)).select(key, "intent", "_t", F.explode("_l").alias("_len"))
    starts = starts.where(F.char_length("_t") >= F.col("_len")).select(
        key, "intent", "_t", "_len", F.explode(F.sequence(F.lit(1), F.char_length("_t") - F.col("_len") + 1)).alias("_i")
    )
    pieces = starts.select(key, "intent", F.expr("substring(_t, _i, _len)").alias("_n")).distinct()
    by_name = pieces.join(named, "_n").select(key, "intent", F.col("name").alias("dataset_name"))
    intents = F.explode(F.array(*[F.lit(i) for i, _ in K.INTENT_HINTS], F.lit(K.DEFAULT_INTENT)))
    served = profiles.select(F.col("name").alias("dataset_name"), "has_text", "has_numeric", intents.alias("intent"))
    served = served.where(_capable(F.col("intent"), F.col("has_text"), F.col("has_numeric")))
    by_intent = asked.select(key, "intent").join(served.select("intent", "dataset_name"), "intent")
    return union_all([by_name, by_intent.select(key, "intent", "dataset_name")]).distinct()


def evidence_label(confidence: Column, citations: Column, intent_col: Column | None = None) -> Column:
    """High, Medium or Low by confidence and number of citations; profile answers are High."""
    label = (
        F.when((confidence >= 0.65) & (citations >= 3), "High")
        .when((confidence >= 0.35) & (citations >= 2), "Medium").otherwise("Low")
    )
    return label if intent_col is None else F.when(intent_col.isin(*K.PROFILE_INTENTS), "High").otherwise(label)


def assess_evidence(df: DataFrame, confidence: str = "confidence", citations: str = "citations", question: str = "question", has_profiles: Column | bool = True) -> DataFrame:
    """Adds label, score and reason for answered questions that carry their intent.

    ``has_profiles`` tells whether any dataset was profiled; an answer from profiles has no evidence without one.
    """
    known = has_profiles if isinstance(has_profiles, Column) else F.lit(has_profiles)
    profiled = F.col("intent").isin(*K.PROFILE_INTENTS)
    label = evidence_label(F.col(confidence), F.col(citations), F.col("intent"))
    label = F.when(profiled & ~known, "Low").otherwise(label)
    reason = (
        F.when(profiled, K.EVIDENCE_TEXTS["profile"])
        .when(label == "High", K.EVIDENCE_TEXTS["High"])
        .when(label == "Medium", K.EVIDENCE_TEXTS["Medium"])
        .otherwise(K.EVIDENCE_TEXTS["Low"])
    )
    broad = contains_any(F.lower(question), K.BROAD_TERMS)
    hint = F.when(
        ~profiled & broad & (label != "High"),
        K.EVIDENCE_TEXTS["broad"],
    ).otherwise("")
    return df.select(
        "*", label.alias("label"), F.when(profiled, known.cast("double")).otherwise(F.col(confidence)).alias("score"),
        F.concat(reason, hint).alias("reason"),
    )


def within_hours(ts: Column | str, hours: int, as_of: datetime | Column) -> Column:
    """Timestamps in the last hours before ``as_of``, which is given and never the wall clock."""
    column = F.col(ts) if isinstance(ts, str) else ts
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return column >= moment - F.make_dt_interval(hours=F.lit(hours))


def log_filter(
    df: DataFrame, level: str | None = None, module: str | None = None, user: str | None = None, action: str | None = None
) -> DataFrame:
    """Level, user and action by equality, module by substring."""
    if level:
        df = df.where(F.col("level") == level)
    if module:
        df = df.where(F.col("module").contains(module))
    if user:
        df = df.where(F.col("username") == user)
    if action:
        df = df.where(F.col("action") == action)
    return df


def context_field(context: Column | str, path: str) -> Column:
    return F.get_json_object(F.col(context) if isinstance(context, str) else context, path)
