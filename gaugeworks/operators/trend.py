"""Time series: trend, moving averages, autocorrelation and forecast, one series per group.

Every operator first sums the values per calendar date, so a series has at most one row
per date however many rows its metric holds, and the windows below are over dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.coerce import to_day
from gaugeworks.functions.tails import t_q
from gaugeworks.functions.text import measure


def daily_series(df: DataFrame, date: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, value): the sum per date; rows without a date are dropped."""
    kind = df.schema[date].dataType.typeName()
    day = F.col(date).cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else to_day(date)
    rows = df.select(*by, day.alias("date"), measure(value).alias("_v")).where(F.col("date").isNotNull())
    return rows.groupBy(*by, "date").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))


def positioned(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``x``, the position 0, 1, 2, ... of each date in its series."""
    window = Window.partitionBy(*by).orderBy("date")
    return series.withColumn("x", (F.row_number().over(window) - 1).cast("double"))


def direction(slope: Column, mean: Column) -> Column:
    """stable, increasing or decreasing; stable below 0.1 % of the mean per step."""
    flat = F.when(mean != 0, F.abs(slope) / F.abs(mean) < 0.001).otherwise(F.abs(slope) < 0.01)
    return F.when(flat, "stable").when(slope > 0, "increasing").otherwise("decreasing")


def _fit(series: DataFrame, by: Sequence[str]) -> DataFrame:
    placed = positioned(series, by)
    return placed.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("intercept"),
        F.when(F.var_pop("value") > 0, F.regr_r2("value", "x")).alias("r_squared"),
        (F.var_pop("value") * F.count("value")).alias("_syy"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )


def trend_fit(df: DataFrame, date: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line over the ordinal position, its R² and direction.

    A series shorter than the minimum keeps its row with ``status = insufficient_data``.
    """
    fit = _fit(daily_series(df, date, value, by), by)
    enough = F.col("n") >= K.MIN_ROWS_TREND
    shown = [F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r_squared")]
    return fit.select(
        *by, "n", *shown,
        F.when(enough, direction(F.col("slope"), F.col("mean"))).alias("direction"),
        "start_date", "end_date",
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
    )


def moving_averages(
    df: DataFrame, date: str, value: str, by: Sequence[str] = (), windows: Sequence[int] = K.MOVING_WINDOWS
) -> DataFrame:
    """Trailing means per date, NULL until a window is full."""
    series = daily_series(df, date, value, by)
    columns = []
    for size in windows:
        frame = Window.partitionBy(*by).orderBy("date").rowsBetween(-(size - 1), 0)
        full = F.count("value").over(frame) == size
        columns.append(F.when(full, F.avg("value").over(frame)).alias(f"moving_average_{size}"))
    return series.select(*by, "date", "value", *columns)


def autocorrelation(df: DataFrame, date: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, lag, acf) from lag 0 to min(n // 4, 30), for series of at least 20 dates.

    Sums run over the overlapping part and are divided by the sum over the whole series.
    A constant series has no autocorrelation and gives NULL.
    """
    series = daily_series(df, date, value, by)
    whole = Window.partitionBy(*by)
    ordered = Window.partitionBy(*by).orderBy("date")
    centred = series.withColumn("_d", F.col("value") - F.avg("value").over(whole))
    lags = range(K.MAX_ACF_LAG + 1)
    lagged = centred.select(
        *by, "_d", *[(F.lag("_d", k).over(ordered) if k else F.col("_d")).alias(f"_l{k}") for k in lags]
    )
    sums = lagged.groupBy(*by).agg(
        F.count("_d").alias("n"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags]
    )
    deepest = F.least(F.floor(F.col("n") / 4), F.lit(K.MAX_ACF_LAG))
    values = F.array(*[
        F.struct(F.lit(k).alias("lag"), F.when(F.col("_s0") > 0, F.col(f"_s{k}") / F.col("_s0")).alias("acf"))
        for k in lags
    ])
    long = sums.where(F.col("n") >= K.MIN_ROWS_ACF).select(*by, "n", deepest.alias("_max"), F.explode(values).alias("_a"))
    return long.where(F.col("_a.lag") <= F.col("_max")).select(*by, "n", "_a.lag", "_a.acf")


def seasonality(df: DataFrame, date: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether a seasonal lag stands out from 2 / sqrt(n)."""
    acf = autocorrelation(df, date, value, by)
    wanted = F.col("lag").isin(*[k for k in K.SEASONAL_LAGS if k < 30]) | ((F.col("lag") == 30) & (F.col("n") >= 30))
    hit = wanted & (F.abs("acf") > 2 / F.sqrt("n"))
    return acf.groupBy(*by).agg(
        F.max("n").alias("n"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("seasonal_pattern")
    )


def forecast(
    df: DataFrame, date: str, value: str, by: Sequence[str] = (),
    steps: int = K.FORECAST_STEPS, confidence: float = K.FORECAST_CONFIDENCE,
) -> DataFrame:
    """The next values on the fitted line with their prediction interval."""
    fit = _fit(daily_series(df, date, value, by), by).where(F.col("n") >= K.MIN_ROWS_TREND)
    n = F.col("n")
    sxx = n * (n * n - 1) / 12.0
    sse = F.greatest(F.col("_syy") - F.col("slope") ** 2 * sxx, F.lit(0.0))
    fit = fit.withColumn("_s", F.sqrt(sse / (n - 2))).withColumn("_t", t_q(F.lit(1 - (1 - confidence) / 2), (n - 2).cast("double")))
    steps_ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x0 = n - 1 + F.col("step")
    point = F.col("intercept") + F.col("slope") * x0
    half = F.col("_t") * F.col("_s") * F.sqrt(1 + 1 / n + (x0 - (n - 1) / 2.0) ** 2 / sxx)
    return steps_ahead.select(
        *by, "step", point.alias("forecast"), (point - half).alias("lower"), (point + half).alias("upper"),
        F.col("_s").alias("residual_error"),
    )
