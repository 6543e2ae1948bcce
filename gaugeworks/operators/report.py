"""Report tables: one ordered (section, seq, key, value) frame from stored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.joins import union_all
from gaugeworks.functions.pii import redacted

# Section order of a report.
SECTIONS = (
    "title", "dataset", "statistic", "category_count", "sentiment", "theme", "analysis", "pinned_insight", "citation",
)
ANALYSES_PER_DATASET = 10


def dataset_citation(datasets: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Dataset: "), F.col("name"), F.lit(" (ID: "), F.col("dataset_id").cast("string"), F.lit(", Type: "),
        F.col("dataset_type"), F.lit(", Records: "), F.col("row_count").cast("string"), F.lit(")"),
    )
    return datasets.select("dataset_id", text.alias("citation"))


def themes_of_first(datasets: DataFrame, themes: DataFrame, order: str = "dataset_id") -> DataFrame:
    """Themes of the first chosen dataset that has any."""
    chosen = themes.join(datasets.select("dataset_id", F.col(order).alias("_o")).distinct(), "dataset_id")
    first = chosen.agg(F.min_by("dataset_id", "_o").alias("_d"))
    return chosen.join(F.broadcast(first), F.col("dataset_id") == F.col("_d")).drop("_d", "_o")


def latest_analyses(analyses: DataFrame, per_dataset: int = ANALYSES_PER_DATASET) -> DataFrame:
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("ts"), F.desc("analysis_id"))
    return analyses.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= per_dataset).drop("_r")


def _section(df: DataFrame, section: str, key, value, order: Sequence) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in order]).alias("_order"),
        key.cast("string").alias("key"), value.cast("string").alias("value"),
    )


def report_rows(
    datasets: DataFrame, statistics: DataFrame | None = None, counts: DataFrame | None = None,
    sentiments: DataFrame | None = None, themes: DataFrame | None = None, analyses: DataFrame | None = None,
    insights: DataFrame | None = None,
) -> DataFrame:
    """Ordered rows of a report; free text is redacted.

    datasets: dataset_id, name, dataset_type, row_count. statistics: dataset_id, metric_name,
    n, mean, median, std_dev, min, max. counts: dataset_id, category, n. sentiments:
    dataset_id, sentiment, n. themes: dataset_id, theme_name, frequency, keywords. analyses as
    stored. insights: id, question, answer.
    """
    title = datasets.agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).select(
        F.concat(
            F.lit("Assessment Report: "),
            F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" Datasets"))),
        ).alias("title")
    )
    name = F.col("dataset_id")
    parts = [
        _section(title, "title", F.lit("title"), F.col("title"), [F.lit("")]),
        _section(datasets, "dataset", name, F.concat_ws(" | ", "name", "dataset_type", F.col("row_count").cast("string")), ["dataset_id"]),
        _section(dataset_citation(datasets), "citation", name, F.col("citation"), [F.lit("a"), "dataset_id"]),
    ]
    if statistics is not None:
        measures = ("n", "mean", "median", "std_dev", "min", "max")
        long = statistics.select(
            "dataset_id", "metric_name", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in measures]
        ).unpivot(["dataset_id", "metric_name"], list(measures), "measure", "value")
        key = F.concat_ws(".", F.col("dataset_id").cast("string"), "metric_name", "measure")
        parts.append(_section(long, "statistic", key, F.col("value"), ["dataset_id", "metric_name", "measure"]))
    if counts is not None:
        key = F.concat_ws(".", F.col("dataset_id").cast("string"), "category")
        parts.append(_section(counts, "category_count", key, F.col("n"), ["dataset_id", "category"]))
    if sentiments is not None:
        key = F.concat_ws(".", F.col("dataset_id").cast("string"), "sentiment")
        parts.append(_section(sentiments, "sentiment", key, F.col("n"), ["dataset_id", "sentiment"]))
    if themes is not None:
        first = themes_of_first(datasets, themes)
        text = F.concat(F.array_join("keywords", ", "), F.lit(" ("), F.col("frequency").cast("string"), F.lit(")"))
        parts.append(_section(first, "theme", F.col("theme_name"), redacted(text), ["theme_name"]))
    if analyses is not None:
        kept = latest_analyses(analyses.join(datasets.select("dataset_id"), "dataset_id", "left_semi"))
        texts = F.concat_ws(" ", *[redacted(c) for c in ("interpretation", "insights", "recommendations")])
        parts.append(_section(kept, "analysis", F.concat_ws(".", "analysis_type", F.col("analysis_id").cast("string")), texts, ["dataset_id", "ts", "analysis_id"]))
        cite = F.concat(
            F.lit("Quantitative Analysis: "), F.col("analysis_type"), F.lit(" (ID: "), F.col("analysis_id").cast("string"),
            F.lit(", Dataset: "), F.col("dataset_id").cast("string"), F.lit(", Date: "), F.col("ts").cast("string"), F.lit(")"),
        )
        parts.append(_section(kept, "citation", F.col("analysis_id"), cite, [F.lit("b"), "dataset_id", "ts", "analysis_id"]))
    if insights is not None:
        parts.append(_section(insights, "pinned_insight", redacted("question"), redacted("answer"), ["id"]))
        n = insights.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
        cite = F.concat(F.lit("Pinned Query Insights: "), F.col("n").cast("string"), F.lit(" item(s) selected by user"))
        parts.append(_section(n, "citation", F.lit("pinned"), cite, [F.lit("c")]))
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    # A report has a few rows per dataset; seq counts them inside a section.
    order = Window.partitionBy("section").orderBy("_order", "key")
    return union_all(parts).select(
        rank.cast("int").alias("section_no"), "section", F.row_number().over(order).alias("seq"), "key", "value"
    )
