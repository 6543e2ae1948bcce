"""Exact repeated attempts on a stream, with state, timers and expiry.

The sliding windows of ``monitors.attempt_windows`` start every few seconds and so approximate the batch report. Here every row gets
the number of attempts in the window that ends at it, as in ``activity.repeated_attempts``. Time is cut into slices of several
windows, and users are dealt to buckets by hash, so a state holds one bucket in one slice. A row of a slice's last window also goes, as context only, to the next slice. When the
watermark passes the end of a slice its timer fires, its rows are counted, and its state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks import constants as K
from gaugeworks.functions.coerce import event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that processors with timers need, for streams that start and end inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class SliceOfAttempts(StatefulProcessor):
    """Attempts of a bucket of users in one slice of time, kept until the slice is over.

    State is one value per batch of rows, a table in Arrow's format: values per row, or keys per user, cost far more than the rows.
    """

    def __init__(self, user: str, key: str, ts: str, window_us: int, slice_us: int, limit: int, most: int):
        self.names, self.window_us, self.slice_us, self.limit, self.most = (user, key, ts), window_us, slice_us, limit, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "part binary")
        self.due = handle.getValueState("due", "at long")

    # Names with a leading underscore would reach Python as positions.
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            part = pa.RecordBatch.from_pandas(frame[["who", "attempt_id", "is_known", "at_us", "is_own"]], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            self.rows.appendValue((sink.getvalue().to_pybytes(),))
        if not self.due.exists():
            at = -(-(int(key[1]) + 1) * self.slice_us // 1000)
            self.due.update((at,))
            self.handle.registerTimer(at)
        # Not a generator: the state of this key must be changed before the next key's turn.
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.concat([pa.ipc.open_stream(r[0]).read_pandas() for r in self.rows.get()], ignore_index=True)
        self.rows.clear()
        self.due.clear()
        us = held["at_us"].to_numpy()
        # Users and times as ranks, so that one sorted array of numbers holds all users one after another.
        _, place = np.unique(np.concatenate([us, us - self.window_us]), return_inverse=True)
        users = pd.factorize(held["who"])[0].astype(np.int64) * len(place)
        upto, before = users + place[:len(us)], users + place[len(us):]
        at = np.sort(upto)
        attempts = np.searchsorted(at, upto, "right") - np.searchsorted(at, before, "right")
        told = held["is_own"].to_numpy() & (attempts >= self.limit)
        user, id, ts = self.names
        return iter([pd.DataFrame({
            user: held["who"][told], id: held["attempt_id"][told].astype("Int64").where(held["is_known"][told]), ts: pd.to_datetime(held["at_us"][told], unit="us"),
            "attempts": attempts[told], "backoff_seconds": np.minimum(np.power(2.0, attempts[told] - 1), float(self.most)),
        })])

    def close(self) -> None:
        pass


def exact_attempts(
    events: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "event_id", seconds: int = K.RATE_LIMIT_SECONDS,
    limit: int = K.RATE_LIMIT_ATTEMPTS, spans: int = 4, delay: str = "10 minutes", buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of ``activity.repeated_attempts`` from a stream; ``key`` is a whole number.

    ``buckets`` share the users of a slice; a stream keeps the number that its checkpoint began with.
    Start it inside ``state_store``. A slice's rows come out when the watermark has passed its end.
    """
    window_us = seconds * 1_000_000
    slice_us = window_us * spans
    timed = event_time(events, ts).withWatermark(ts, delay)
    # Columns with a null would change their type on the way to Python; a text never does.
    who = F.coalesce(F.concat(F.lit("="), F.col(user).cast("string")), F.lit(""))
    id = F.col(key).cast("long")
    rows = timed.select(
        who.alias("who"), F.pmod(F.xxhash64(who), F.lit(buckets)).alias("bucket"), F.coalesce(id, F.lit(0)).alias("attempt_id"), id.isNotNull().alias("is_known"),
        F.col(ts), F.unix_micros(ts).alias("at_us"),
    )
    own = F.floor(F.col("at_us") / F.lit(slice_us)).cast("long")
    spill = F.when((F.col("at_us") + window_us) >= (own + 1) * slice_us, own + 1)
    spread = rows.withColumn("own_slice", own).withColumn("in_slice", F.explode(F.array_compact(F.array(own, spill))))
    spread = spread.withColumn("is_own", F.col("in_slice") == F.col("own_slice")).drop("own_slice")
    schema = T.StructType([
        T.StructField("who", T.StringType()), T.StructField(key, T.LongType()), T.StructField(ts, T.TimestampType()),
        T.StructField("attempts", T.LongType()), T.StructField("backoff_seconds", T.DoubleType()),
    ])
    processor = SliceOfAttempts("who", key, ts, window_us, slice_us, limit, K.RATE_LIMIT_BACKOFF_MAX)
    found = spread.groupBy("bucket", "in_slice").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    name = F.when(F.col("who") != "", F.substring("who", 2, 1 << 30)).cast(events.schema[user].dataType)
    return found.select(name.alias(user), key, ts, "attempts", "backoff_seconds")
