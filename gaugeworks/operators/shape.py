"""Distribution shape, outliers and normality of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import attach, union_all
from gaugeworks.functions.tails import ks_p, phi, shapiro_wilk
from gaugeworks.functions.text import measure
from gaugeworks.operators import ordered


def _values(df: DataFrame, value: str, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    data = df.select(*by, *keep, measure(value).alias("value"))
    return data.where(F.col("value").isNotNull())


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Population skewness, excess kurtosis, quartiles and their range."""
    placed = ordered.placed_counts(_values(df, value, by), "value", by)
    size, m2 = F.max("n_all"), ordered.moment("value", 2)
    variance = F.when(m2 > 0, m2 / size)
    table = placed.groupBy(*by).agg(
        size.alias("n"), F.max("mean").alias("mean"), ordered.sample_deviation("value").alias("std_dev"),
        (ordered.moment("value", 3) / size / F.pow(variance, F.lit(1.5))).alias("skewness"),
        (ordered.moment("value", 4) / size / (variance * variance) - 3).alias("kurtosis"),
        *[ordered.quantile("value", p).alias(name) for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))],
    )
    if not by:
        table = table.where(F.col("n").isNotNull())
    return table.select(
        "*", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(F.col("n") >= K.MIN_ROWS_DISTRIBUTION, "ok").otherwise("insufficient_data").alias("status"),
    )


def iqr_outliers(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), factor: float = K.IQR_FACTOR
) -> DataFrame:
    """Rows outside the quartile fences with their distance in units of the quartile range (0 if that is 0)."""
    stats = distribution(df, value, by).where(F.col("status") == "ok")
    fences = stats.select(
        *by, "iqr", (F.col("q1") - factor * F.col("iqr")).alias("lower"), (F.col("q3") + factor * F.col("iqr")).alias("upper")
    )
    rows = attach(_values(df, value, by, [key]), fences, by)
    outside = rows.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    distance = F.when(F.col("value") < F.col("lower"), F.col("lower") - F.col("value")).otherwise(F.col("value") - F.col("upper"))
    severity = F.when(F.col("iqr") > 0, distance / F.col("iqr")).otherwise(0.0)
    return outside.select(*by, key, "value", "lower", "upper", severity.alias("severity"))


def z_outliers(df: DataFrame, value: str, key: str, by: Sequence[str] = (), limit: float = K.Z_LIMIT) -> DataFrame:
    """Rows more than ``limit`` sample deviations from the mean; severity is that distance."""
    data = _values(df, value, by, [key])
    stats = data.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    stats = stats.where((F.col("n") >= K.MIN_ROWS_DISTRIBUTION) & (F.col("_s") > 0)).drop("n")
    severity = F.abs((F.col("value") - F.col("_m")) / F.col("_s"))
    rows = attach(data, stats, by).withColumn("severity", severity)
    return rows.where(F.col("severity") > limit).select(*by, key, "value", "severity")


def outlier_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values outside the quartile fences per column; 0 where the quartile range is 0, none below 4 values."""
    from gaugeworks.operators.describe import long_form

    data = long_form(df, columns, by).where(F.col("value").isNotNull())
    keys = [*by, "column"]
    counts = ordered.value_counts(data, "value", keys)
    quartiles = ordered.quantiles(data, "value", (0.25, 0.75), keys)
    fences = quartiles.select(*keys, F.col("q")[0].alias("_a"), F.col("q")[1].alias("_b"))
    width = F.col("_b") - F.col("_a")
    out = (F.col("value") < F.col("_a") - K.IQR_FACTOR * width) | (F.col("value") > F.col("_b") + K.IQR_FACTOR * width)
    # Counted over the distinct values, whose shuffle the quartiles already needed.
    table = attach(counts, fences, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(out & (width != 0), F.col("n")).otherwise(0)).alias("outliers")
    )
    return table.where(F.col("n") >= 4)


def ks_normality(
    df: DataFrame, value: str, by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE
) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal with the sample mean and deviation.

    Mean and deviation come from the same data, so the p-value is conservative.
    """
    placed = ordered.placed_counts(_values(df, value, by), "value", by, per_slice)
    rows = attach(placed, placed.groupBy(*by).agg(ordered.sample_deviation("value").alias("_s")), by)
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("mean")) / F.col("_s"))
    rows = rows.withColumn("_phi", phi(z))
    total = F.col("n_all")
    gap = F.greatest((F.col("n_before") + F.col("n")) / total - F.col("_phi"), F.col("_phi") - F.col("n_before") / total)
    table = rows.groupBy(*by).agg(F.max("n_all").alias("n"), F.max(gap).alias("statistic"))
    return table.withColumn("p_value", ks_p(F.col("statistic"), F.col("n").cast("double")))


def shapiro_normality(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk W and p for groups of 3 to 5000 values; larger groups are left out."""
    keys = list(by)
    data = _values(df, value, by)
    sizes = data.groupBy(*by).agg(F.count("value").alias("n"))
    small = attach(data, sizes.where(F.col("n").between(3, K.SHAPIRO_MAX_ROWS)), by)
    if not keys:
        small = small.withColumn("_all", F.lit(1))
        keys = ["_all"]
    schema = ", ".join(f"`{k}` {small.schema[k].dataType.simpleString()}" for k in keys)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(group["value"].to_numpy())
        head = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "n": [len(group)], "statistic": [w], "p_value": [p]})

    out = small.drop("n").groupBy(*keys).applyInPandas(test, f"{schema}, n long, statistic double, p_value double")
    return out.select(*by, "n", "statistic", "p_value")


def normality(df: DataFrame, value: str, by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE) -> DataFrame:
    """Shapiro-Wilk up to 5000 values, Kolmogorov-Smirnov beyond; normal when p exceeds 0.05."""
    data = _values(df, value, by)
    sizes = data.groupBy(*by).agg(F.count("value").alias("_n"))
    large = attach(data, sizes.where(F.col("_n") > K.SHAPIRO_MAX_ROWS), by).drop("_n")
    ks = ks_normality(large, "value", by, per_slice)
    if not by:
        ks = ks.where(F.col("n") > 0)
    both = union_all([
        shapiro_normality(data, "value", by).withColumn("test_name", F.lit("Shapiro-Wilk")),
        ks.withColumn("test_name", F.lit("Kolmogorov-Smirnov")),
    ])
    return both.withColumn("is_normal", F.col("p_value") > K.ALPHA)


def recommend_correlation(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """pearson when both columns look normal, else spearman."""
    a = normality(df, first, by).select(*by, F.col("is_normal").alias("first_normal"))
    b = normality(df, second, by).select(*by, F.col("is_normal").alias("second_normal"))
    method = F.when(F.col("first_normal") & F.col("second_normal"), "pearson").otherwise("spearman")
    return attach(a, b, by).withColumn("recommended_method", method)


def recommend_comparison(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Comparison test by number of groups and their normality."""
    table = normality(df, value, [*by, group]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.bool_and("is_normal").alias("all_normal")
    )
    two, normal = F.col("n_groups") == 2, F.col("all_normal")
    test = (
        F.when(F.col("n_groups") < 2, F.lit(None).cast("string"))
        .when(two & normal, "t-test").when(two, "mann-whitney").when(normal, "anova").otherwise("kruskal-wallis")
    )
    return table.withColumn("recommended_test", test)
