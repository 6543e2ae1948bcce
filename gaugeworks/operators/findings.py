"""Data points, pattern statements and priorities taken from result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import union_all
from gaugeworks.functions.text import filled
from gaugeworks.operators.correlation import top_correlations


def data_points(
    statistics: DataFrame | None = None, correlations: DataFrame | None = None,
    trends: DataFrame | None = None, groups: DataFrame | None = None,
) -> DataFrame:
    """(type, subject, value, description) rows from the given result tables.

    statistics: column, mean. correlations: variable1, variable2, correlation (the three
    strongest are taken). trends: metric, slope, direction. groups: group, mean.
    """
    parts = []
    if statistics is not None:
        parts.append(statistics.select(
            F.lit("statistic").alias("type"), F.col("column").alias("subject"), F.col("mean").alias("value"),
            F.concat(F.lit("Mean "), F.col("column")).alias("description"),
        ))
    if correlations is not None:
        parts.append(top_correlations(correlations, 3).select(
            F.lit("correlation").alias("type"), F.concat_ws(", ", "variable1", "variable2").alias("subject"),
            F.col("correlation").alias("value"),
            F.concat(F.lit("Correlation between "), F.col("variable1"), F.lit(" and "), F.col("variable2")).alias("description"),
        ))
    if trends is not None:
        parts.append(trends.select(
            F.lit("trend").alias("type"), F.col("metric").alias("subject"), F.col("slope").alias("value"),
            F.concat(F.lit("Trend slope: "), F.col("direction")).alias("description"),
        ))
    if groups is not None:
        parts.append(groups.select(
            F.lit("group_statistic").alias("type"), F.col("group").alias("subject"), F.col("mean").alias("value"),
            F.concat(F.lit("Mean for "), F.col("group")).alias("description"),
        ))
    return union_all(parts)


def patterns(
    correlations: DataFrame | None = None, trends: DataFrame | None = None, comparisons: DataFrame | None = None,
    outliers: DataFrame | None = None, normality: DataFrame | None = None,
) -> DataFrame:
    """(subject, pattern) statements.

    correlations: correlation. trends: metric, direction, seasonal_pattern. comparisons:
    subject, significant. outliers: subject, n_outliers, n_observations. normality: subject, is_normal.
    """
    parts = []
    if correlations is not None:
        strong = correlations.agg(F.count_if(F.abs("correlation") > 0.7).alias("_k")).where(F.col("_k") > 0)
        parts.append(strong.select(
            F.lit("correlation").alias("subject"),
            filled(K.PATTERN_TEXTS["strong"], F.col("_k")).alias("pattern"),
        ))
    if trends is not None:
        moving = trends.where(F.col("direction") != "stable")
        parts.append(moving.select(F.col("metric").alias("subject"), filled(K.PATTERN_TEXTS["trend"], F.initcap("direction")).alias("pattern")))
        parts.append(trends.where(F.col("seasonal_pattern")).select(
            F.col("metric").alias("subject"), F.lit(K.PATTERN_TEXTS["seasonal"]).alias("pattern")
        ))
    if comparisons is not None:
        parts.append(comparisons.where(F.col("significant")).select(
            "subject", F.lit(K.PATTERN_TEXTS["groups"]).alias("pattern")
        ))
    if outliers is not None:
        share = F.when(F.col("n_observations") > 0, F.col("n_outliers") / F.col("n_observations") * 100).otherwise(0.0)
        parts.append(outliers.where(F.col("n_outliers") > 0).select(
            "subject",
            filled(K.PATTERN_TEXTS["outliers"], F.col("n_outliers"), F.format_string("%.1f", share)).alias("pattern"),
        ))
    if normality is not None:
        parts.append(normality.where(~F.col("is_normal")).select("subject", F.lit(K.PATTERN_TEXTS["skewed"]).alias("pattern")))
    return union_all(parts)


def correlation_priority(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    significant = F.coalesce(F.col("significant"), F.lit(False))
    strong = F.count_if(significant & (F.abs("correlation") > 0.7))
    level = F.when(strong >= 3, "high").when(F.count_if(significant) >= 2, "medium").otherwise("low")
    return pairs.groupBy(*by).agg(level.alias("priority"))


def trend_priority(direction: Column, r_squared: Column) -> Column:
    firm = F.coalesce(r_squared, F.lit(0.0)) > 0.5
    return F.when((direction == "decreasing") & firm, "high").when(direction != "stable", "medium").otherwise("low")


def comparison_priority(significant: Column, effect_size: Column) -> Column:
    large = F.coalesce(F.abs(effect_size) > 0.8, F.lit(False))
    return F.when(significant & large, "high").when(significant, "medium").otherwise("low")


def distribution_priority(n_outliers: Column, n_observations: Column) -> Column:
    share = F.when(n_observations > 0, n_outliers / n_observations * 100).otherwise(0.0)
    return F.when(share > 10, "high").when(share > 5, "medium").otherwise("low")
