"""Descriptive statistics over metrics, columns, groups and categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.joins import attach
from gaugeworks.functions.text import measure
from gaugeworks.operators import ordered


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value) rows of the numeric columns; NaN counts as missing."""
    wide = df.select(*by, *[measure(c).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column", "value")


def describe(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    probs: Mapping[str, float] | None = None,
) -> DataFrame:
    """n, mean, std_dev (sample, NULL for one row), min, max and the named exact quantiles.

    Missing values are left out, and so is a group that has no value at all.
    """
    probs = {"median": 0.5} if probs is None else probs
    placed = ordered.placed_counts(df.select(*by, measure(value).alias("_v")), "_v", by)
    table = placed.groupBy(*by).agg(
        F.max("n_all").alias("n"),
        F.max("mean").alias("mean"),
        *[ordered.quantile("_v", p).alias(name) for name, p in probs.items()],
        ordered.sample_deviation("_v").alias("std_dev"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    return table if by else table.where(F.col("n").isNotNull())


def usage_statistics(
    df: DataFrame, metric: str = "metric_name", value: str = "metric_value", by: Sequence[str] = (),
) -> DataFrame:
    """Per-metric statistics; the deviation of a single value is 0."""
    table = describe(df, value, [*by, metric])
    return table.withColumn("std_dev", F.coalesce("std_dev", F.lit(0.0)))


def category_counts(df: DataFrame, category: str = "category", by: Sequence[str] = ()) -> DataFrame:
    """Rows per category; missing and empty categories are left out."""
    kept = df.where(F.col(category).isNotNull() & (F.col(category) != ""))
    return kept.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))


def survey_statistics(
    df: DataFrame, text: str = "response_text", score: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Statistics of response length and, where a column is given, of the sentiment score."""
    length = F.when(F.col(text) != "", F.char_length(text).cast("double"))
    wide = df.select(
        *by, length.alias("response_length"), *([measure(score).alias("sentiment_score")] if score else [])
    )
    names = ["response_length"] + (["sentiment_score"] if score else [])
    table = describe(wide.unpivot(list(by), names, "measure", "_x"), "_x", [*by, "measure"])
    return table.withColumn("std_dev", F.coalesce("std_dev", F.lit(0.0)))


def column_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean, median, deviation, range and missing count of each numeric column."""
    columns = list(columns or numeric_columns(df))
    data = long_form(df, columns, by)
    keys = [*by, "column"]
    missing = data.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("missing"))
    return attach(missing, describe(data, "value", keys), keys, "left")


def group_statistics(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample deviation (NULL for one row), median, min and max per group."""
    return describe(df.where(F.col(group).isNotNull()), value, [*by, group])


def sentiment_distribution(df: DataFrame, category: str = "category", by: Sequence[str] = ()) -> DataFrame:
    """Shares of the three categories among processed rows, and the number of skipped rows."""
    hit = lambda name: F.count_if(F.col(category) == name)
    processed = F.count(category)
    share = lambda name: F.when(processed > 0, hit(name) / processed).alias(name)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        processed.alias("processed"),
        (F.count(F.lit(1)) - processed).alias("skipped"),
        share("positive"), share("neutral"), share("negative"),
    )


def sentiment_counts(df: DataFrame, category: str = "sentiment", by: Sequence[str] = ()) -> DataFrame:
    return category_counts(df, category, by)


def chart_sums(df: DataFrame, key: str | Sequence[str], value: str | None = None) -> DataFrame:
    """Sum of a numeric value per key, or rows per key; missing keys are dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = df.dropna(subset=keys)
    if value is None or not isinstance(df.schema[value].dataType, T.NumericType):
        return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return kept.groupBy(*keys).agg(F.sum(value).alias("total"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_summaries(
    datasets: DataFrame, statistics: DataFrame, order: str = "dataset_id", key: str = "metric_name"
) -> tuple[DataFrame, DataFrame]:
    """One header over several datasets and, per key, the statistics of the first dataset holding it.

    The header joins the registry's names in order; the registry holds one row per dataset.
    """
    names = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("name"))))
    header = datasets.agg(
        F.array_join(F.transform(names, lambda x: x["name"]), ", ").alias("dataset_name"),
        F.when(F.count(F.lit(1)) > 1, F.lit("multiple")).otherwise(F.min("dataset_type")).alias("dataset_type"),
        F.sum("row_count").alias("row_count"),
    )
    rest = [c for c in statistics.columns if c not in (order, key)]
    first = F.min_by(F.struct(order, *rest), F.col(order)).alias("_s")
    return header, statistics.groupBy(key).agg(first).select(key, "_s.*")


def benchmark_ranking(
    df: DataFrame, institution: str, value: str, by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE
) -> DataFrame:
    """Rank and percentile of every institution by value, best first; rows without a number are dropped.

    Equal values are ordered by institution name. Repeated rows of an institution with the
    same value are one row with their number in ``copies``; they still take up ranks.
    """
    data = df.withColumn("metric_value", measure(value)).where(F.col("metric_value").isNotNull())
    keyed = data.withColumn("_key", F.struct((-F.col("metric_value")).alias("v"), F.col(institution).cast("string").alias("i")))
    distinct = keyed.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered.running_before(distinct, "_key", ["n"], by, per_slice)
    rank = F.col("n_before") + 1
    top = F.greatest(F.col("n_all") - 1, F.lit(1))
    return placed.select(
        *by, F.col("_key.i").alias("institution"), (-F.col("_key.v")).alias("metric_value"), F.col("n").alias("copies"),
        rank.alias("rank"), F.round((1 - (rank - 1) / top) * 100, 1).alias("percentile"),
    )


def benchmark_summary(
    df: DataFrame, institution: str, value: str, target: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Count, mean, median, min and max, and the place of the target institution (name match ignores case)."""
    table = describe(df, value, by).drop("std_dev")
    if target is None:
        return table
    ranked = benchmark_ranking(df, institution, value, by).where(F.lower("institution") == target.lower())
    best = F.min_by(F.struct("institution", "metric_value", "rank", "percentile"), F.col("rank"))
    place = ranked.groupBy(*by).agg(best.alias("target"))
    return attach(table, place, by, "left")


def top_performers(df: DataFrame, institution: str, value: str, k: int = 5) -> DataFrame:
    data = df.select(F.col(institution).alias("institution"), measure(value).alias("metric_value"))
    return data.where(F.col("metric_value").isNotNull()).orderBy(F.desc("metric_value"), "institution").limit(k)
