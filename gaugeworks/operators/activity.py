"""Operational events: errors, operations, query log, pins and repeated attempts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.operators.questions import context_field, log_filter, within_hours


def error_summary(logs: DataFrame, hours: int | None = None, as_of: datetime | Column | None = None) -> DataFrame:
    """ERROR and CRITICAL rows per module and level, most first."""
    rows = logs.where(F.col("level").isin("ERROR", "CRITICAL"))
    if hours is not None:
        rows = rows.where(within_hours("ts", hours, as_of))
    counts = rows.groupBy("module", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "module", "level")


def operation_stats(
    logs: DataFrame, hours: int | None = None, as_of: datetime | Column | None = None,
    operation_path: str = "$.operation", duration_path: str = "$.duration_ms", context: str = "context",
) -> DataFrame:
    """Calls, mean and maximum duration per operation found in the JSON context."""
    rows = logs.where(F.col(context).isNotNull())
    if hours is not None:
        rows = rows.where(within_hours("ts", hours, as_of))
    fields = rows.select(
        context_field(context, operation_path).alias("operation"),
        context_field(context, duration_path).try_cast("double").alias("_ms"),
    ).where(F.col("operation").isNotNull())
    stats = fields.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("_ms"), 1).alias("avg_ms"), F.max(F.col("_ms").cast("long")).alias("max_ms")
    )
    return stats.orderBy(F.desc("calls"), "operation")


def query_activity(rows: DataFrame, confidence: str = "confidence", duration: str = "processing_time_ms", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, means that ignore missing values, and the number of low-confidence answers."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("average_confidence"),
        F.avg(duration).alias("average_processing_ms"),
        F.count_if(F.col(confidence) < K.LOW_CONFIDENCE).alias("low_confidence_count"),
    )


def recent_logs(logs: DataFrame, limit: int = 200, level: str | None = None, module: str | None = None, key: str = "id") -> DataFrame:
    return log_filter(logs, level=level, module=module).orderBy(F.desc("ts"), F.desc(key)).limit(limit)


def access_trail(
    logs: DataFrame, hours: int | None = 24, as_of: datetime | Column | None = None, user: str | None = None,
    action: str | None = None, limit: int = 200, key: str = "id",
) -> DataFrame:
    """Newest access events within the window."""
    rows = log_filter(logs, user=user, action=action)
    if hours is not None:
        rows = rows.where(within_hours("ts", hours, as_of))
    return rows.orderBy(F.desc("ts"), F.desc(key)).limit(limit)


def distinct_queries(log: DataFrame, key: str = "idempotency_key", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Each idempotency key once, its first row; rows without a key all stay.

    Keyless rows never meet in one task: only rows with a key are grouped.
    """
    keyed = log.where(F.col(key).isNotNull())
    rest = [c for c in log.columns if c != key]
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(key, "_f.*")
    return first.select(*log.columns).unionByName(log.where(F.col(key).isNull()))


def latest_per_user(
    pins: DataFrame, user: str = "username", created: str = "created_at", key: str = "id", n: int = K.PINNED_LIMIT
) -> DataFrame:
    """The latest n rows of each user with their place from oldest to newest.

    Map tasks keep n rows per user before the shuffle, however many a user has.
    """
    newest = Window.partitionBy(user).orderBy(F.desc(created), F.desc(key))
    kept = pins.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    oldest_first = Window.partitionBy(user).orderBy(F.desc("_r"))
    return kept.withColumn("place", F.row_number().over(oldest_first)).drop("_r")


def pin(pins: DataFrame, incoming: DataFrame, key: str = "idempotency_key", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Pins with new ones added; a key that is already pinned is not pinned again."""
    from gaugeworks.sources.ledger import new_rows

    return pins.unionByName(new_rows(incoming, pins, [key], list(order)))


def unpin(pins: DataFrame, key_value: int, user: str | None = None, key: str = "id") -> DataFrame:
    """Pins without the given one, which only its owner can remove when a user is named."""
    gone = F.col(key) == key_value
    return pins.where(~gone if user is None else ~(gone & (F.col("username") == user)))


def repeated_attempts(
    attempts: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "event_id",
    seconds: int = K.RATE_LIMIT_SECONDS, limit: int = K.RATE_LIMIT_ATTEMPTS, spans: int = 4,
) -> DataFrame:
    """Attempts that find at least ``limit`` attempts of the user in the window ending there, with their backoff.

    A window over a user would put all of a user's events in one task. Here time is cut into
    slices of ``spans`` windows and each row of a slice's last window also goes, as context
    only, to the next slice, so a task sees one slice of one user.
    """
    window_us = seconds * 1_000_000
    slice_us = window_us * spans
    rows = attempts.select(F.col(user), F.col(key), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    own = F.floor(F.col("_us") / F.lit(slice_us)).cast("long")
    spill = F.when((F.col("_us") + window_us) >= (own + 1) * slice_us, own + 1)
    spread = rows.withColumn("_own", own).withColumn("_slice", F.explode(F.array_compact(F.array(own, spill))))
    frame = Window.partitionBy(user, "_slice").orderBy("_us").rangeBetween(-(window_us - 1), 0)
    counted = spread.withColumn("attempts", F.count(F.lit(1)).over(frame)).where(F.col("_slice") == F.col("_own"))
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(float(K.RATE_LIMIT_BACKOFF_MAX)))
    return counted.where(F.col("attempts") >= limit).select(user, key, ts, "attempts", wait.alias("backoff_seconds"))
