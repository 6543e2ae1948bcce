"""Structured Streaming jobs that give the same rows as their batch twins on finished input.

Rows later than the watermark are dropped; with ``availableNow`` over a finished input no row
is late unless it is out of order by more than the delay.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeworks import constants as K
from gaugeworks.functions.coerce import event_time
from gaugeworks.functions.pii import redact
from gaugeworks.operators.questions import context_field
from gaugeworks.session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files.

    The name is given as a pattern that only it meets, since Spark takes a path without a pattern for a folder.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return file_stream(spark, f"{folder}/{{{name}}}", schema)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes everything that is there into a Parquet folder and stops."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    query.option("path", out).trigger(availableNow=True).start().awaitTermination()


def collect_available(df: DataFrame, label: str) -> DataFrame:
    """Runs the stream over the available input and reads back its rows from shared scratch space."""
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    run_available(df, out, checkpoint)
    return spark.read.schema(df.schema).parquet(out)


def intake(
    stream: DataFrame, target: str, ledger: str, keys: tuple[str, ...], order: tuple[str, ...], checkpoint: str
) -> StreamingQuery:
    """Drop-folder intake: each key is appended once, across batches, restarts and checkpoints.

    A batch owns the folder ``run=<id>/batch=<n>`` of the target. The run is the id that Spark keeps in the checkpoint: a
    batch that is run again after a failure overwrites its own rows, while a new checkpoint is a new run, which
    leaves the rows of others alone. Keys are checked against all other batches of all runs.
    """
    from gaugeworks.sources.ledger import new_rows

    spark = stream.sparkSession
    key_schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = json.loads(session.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        own = f"run={run}/batch={batch_id}"
        try:
            seen = session.read.schema(f"{key_schema}, run string, batch long").parquet(ledger)
            seen = seen.where((F.col("run") != run) | (F.col("batch") < batch_id))
        except Exception as error:  # the first batch finds no ledger folder
            if "PATH_NOT_FOUND" not in str(error):
                raise
            seen = session.createDataFrame([], key_schema)
        fresh = new_rows(batch, seen, list(keys), list(order))
        fresh.write.mode("overwrite").parquet(f"{target}/{own}")
        written = session.read.schema(fresh.schema).parquet(f"{target}/{own}")
        written.select(*keys).write.mode("overwrite").parquet(f"{ledger}/{own}")

    return (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def finished(stream_of, events: DataFrame, ts: str, after: str = "2 days") -> DataFrame:
    """The stream of a finished input plus one late marker row that closes its last windows.

    ``stream_of(folder)`` opens a Parquet folder as a stream with the same schema; ``events``
    is the input as a batch, from which only the last timestamp is taken. The marker's own
    window stays open, so it never shows up in the result.
    """
    folder = scratch_path(events.sparkSession, "marker")
    flush_marker(events, ts, after).write.parquet(folder)
    return stream_of(folder)


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    df = event_time(df, ts)
    return df.withWatermark(ts, delay) if df.isStreaming else df


def operation_windows(
    events: DataFrame, operation: str = "event_type", duration: str | None = None, ts: str = "ts",
    window: str = "1 hour", delay: str = "10 minutes", errors: str | None = "error",
) -> DataFrame:
    """Calls, mean and maximum duration and error count per tumbling window and operation."""
    rows = _timed(events, ts, delay)
    ms = F.col(duration) if duration else F.lit(None).cast("double")
    failed = F.col(operation) == errors if errors else F.lit(False)
    stats = rows.groupBy(F.window(ts, window).alias("w"), F.col(operation).alias("operation")).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"),
        F.count_if(failed).alias("errors"),
    )
    return stats.select(F.col("w.start").alias("window_start"), "operation", "calls", "avg_ms", "max_ms", "errors")


def flush_marker(events: DataFrame, ts: str, after: str = "2 days") -> DataFrame:
    """One row later than all others, which closes the last windows of a finished input."""
    last = events.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    fields = [F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    return last.select(*fields)


def attempt_windows(
    events: DataFrame, user: str = "user_id", ts: str = "ts", seconds: int = K.RATE_LIMIT_SECONDS, slide: int = 10,
    limit: int = K.RATE_LIMIT_ATTEMPTS, delay: str = "10 minutes",
) -> DataFrame:
    """Sliding windows in which a user reaches the limit.

    It approximates the exact per-row window of the batch report: windows start every
    ``slide`` seconds. Each input row is counted map-side into its windows.
    """
    rows = _timed(events, ts, delay)
    counts = rows.groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds").alias("w"), F.col(user)).agg(
        F.count(F.lit(1)).alias("attempts")
    )
    return counts.where(F.col("attempts") >= limit).select(F.col("w.start").alias("window_start"), user, "attempts")


def session_activity(events: DataFrame, session: str = "user_id", ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events per session, a session ending after a gap without events."""
    rows = _timed(events, ts, delay)
    grouped = rows.groupBy(F.session_window(ts, gap).alias("w"), F.col(session)).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), session, "n_events")


def deduplicated_log(log: DataFrame, key: str = "idempotency_key", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark delay; rows without a key pass through."""
    if not log.isStreaming:
        from gaugeworks.operators.activity import distinct_queries

        return distinct_queries(log, key)
    # Rows without a key never come to a state.
    timed = _timed(log, ts, delay)
    keyed = timed.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return keyed.unionByName(timed.where(F.col(key).isNull()))


def redacted_events(events: DataFrame, text: str, out: str = "redacted_text") -> DataFrame:
    """Stateless redaction with the counts per kind."""
    return redact(events, text, out=out)


def redaction_running_totals(events: DataFrame, text: str, out: str, checkpoint: str) -> StreamingQuery:
    """Totals per kind over everything seen so far; every batch leaves them as a table in its own folder, see ``latest_totals``."""
    counted = redact(events.select(text), text)
    kinds = [c for c in counted.columns if c.startswith("n_")]
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(k[2:]).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("_x"))
    totals = rows.select("_x.*").groupBy("kind").agg(F.sum("n").alias("total"))

    def put(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return totals.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The totals that the last finished batch left."""
    rows = spark.read.schema("kind string, total long, batch long").parquet(out)
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").select("kind", "total")


def live_operation_stats(logs: DataFrame, context: str = "context", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``operation_windows`` for logs whose operation and duration sit in a JSON context."""
    rows = logs.withColumn("operation", context_field(context, "$.operation"))
    rows = rows.withColumn("duration_ms", context_field(context, "$.duration_ms").try_cast("double"))
    # Rows without an operation still move the watermark, so they must not be dropped below it; the test holds the filter back.
    known = F.when(F.col("calls") > 0, F.col("operation")).isNotNull()
    return operation_windows(rows, "operation", "duration_ms", "ts", window, delay, None).where(known)
