"""Queries: stored tables, keys, table comparison, operational events, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import activity, describe, report
from gaugeworks.plans.numbers import REGISTRY_SQL, registry_frame
from gaugeworks.plans.registry import query, table
from gaugeworks.plans.texts import PII_TOTALS_SQL
from gaugeworks.sources import diff, intake, ledger
from gaugeworks.sources.store import Store, list_analyses
from gaugeworks.session import scratch_path
from gaugeworks.streaming import attempts, monitors


def _events(spark, sf):
    return table(spark, sf, "events")


# Stored tables and keys.


@query("stored_facts", """
    SELECT event_type AS metric_name, count(*) AS n, sum(value) AS total, min(CAST(ts AS DATE)) AS first_date FROM events GROUP BY ALL""", "total", total=2)
def stored_facts(spark, sf):
    store = Store(spark, scratch_path(spark, "store"))
    rows = _events(spark, sf).select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value")
    )
    first = store.add_dataset(rows, "events", "events", "hash-1")
    again = store.add_dataset(rows, "events", "events", "hash-1")
    facts = store.facts(first).where(F.lit(first == again))
    return facts.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.sum("metric_value").alias("total"), F.min("date").alias("first_date"))


@query("dedupe_by_hash", "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedupe_by_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return intake.duplicates(docs, "text_hash", "doc_id")


@query("operation_keys", """
    SELECT doc_id, 'store_dataset:' || sha256('13:store_dataset' || length(source) || ':' || lower(source) || length(lang) || ':' || lower(lang)) AS operation_key FROM documents""")
def operation_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ledger.operation_key_column("store_dataset", "source", "lang").alias("operation_key"))


@query("anti_append", """
    SELECT o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice) AS r FROM (
            SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders))
    WHERE r = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""", "o_totalprice")
def anti_append(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    copies = orders.unionByName(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    stored = orders.where(F.col("o_orderstatus") == "F")
    return ledger.new_rows(copies, stored, ["o_orderkey"], ["o_totalprice"]).drop("o_orderstatus")


@query("table_diff", """
    SELECT o_orderkey, 'left_only' AS kind, CAST(NULL AS VARCHAR) AS "column" FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'changed', 'o_totalprice' FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT -1 - o_orderkey, 'right_only', NULL FROM orders WHERE o_orderpriority = '2-HIGH'""")
def table_diff(spark, sf):
    left = table(spark, sf, "orders")
    kept = left.where(F.col("o_orderpriority") != "1-URGENT")
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice") + 1e-12)
    right = kept.withColumn("o_totalprice", price)
    added = left.where(F.col("o_orderpriority") == "2-HIGH").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return diff.table_diff(left, right.unionByName(added), ["o_orderkey"]).select("o_orderkey", "kind", "column")


@query("table_diff_buckets", """
    SELECT o_orderkey, 'changed' AS kind, 'o_totalprice' AS "column" FROM orders WHERE o_orderkey % 1000 = 1
    UNION ALL SELECT NULL, 'right_column', 'added' FROM (SELECT count(*) FROM orders)""")
def table_diff_buckets(spark, sf):
    left = table(spark, sf, "orders")
    price = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 1000 == 1, 2.0).otherwise(0.0)
    right = left.withColumn("o_totalprice", price).withColumn("added", F.lit(1))
    return diff.table_diff(left, right, ["o_orderkey"], buckets=4096).select("o_orderkey", "kind", "column")


@query("listed_analyses", """
    SELECT o_orderkey AS analysis_id, o_custkey AS dataset_id, 'trend' AS analysis_type, o_orderpriority = '1-URGENT' AS has_interpretation,
           false AS has_insights, true AS has_recommendations FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25""")
def listed_analyses(spark, sf):
    orders = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "trend").otherwise("comparative")
    stored = orders.select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("dataset_id"), kind.alias("analysis_type"),
        F.lit("{}").alias("parameters"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("text")).alias("interpretation"),
        F.lit(None).cast("string").alias("insights"), F.lit("text").alias("recommendations"),
    )
    return list_analyses(stored, "trend", 25).drop("parameters", "ts")


@query("catalog", f"SELECT dataset_id, name, row_count FROM ({REGISTRY_SQL}) ORDER BY row_count DESC, dataset_id DESC")
def catalog(spark, sf):
    return registry_frame(spark, sf).select("dataset_id", "name", "row_count").orderBy(F.desc("row_count"), F.desc("dataset_id"))


# Operational events.

LOGS_SQL = """
    SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS level,
           'user_' || (user_id // 10) AS module, 'u' || user_id AS username, event_type AS action,
           '{"operation":"' || event_type || '","duration_ms":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS context, value FROM events"""


def _logs(spark, sf):
    k = F.get_json_object("props", "$.k")
    return _events(spark, sf).select(
        F.col("event_id").alias("id"), "ts",
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "CRITICAL").otherwise("INFO").alias("level"),
        F.concat(F.lit("user_"), F.floor(F.col("user_id") / 10).cast("string")).alias("module"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.col("event_type").alias("action"),
        F.concat(F.lit('{"operation":"'), F.col("event_type"), F.lit('","duration_ms":'), k, F.lit("}")).alias("context"), "value",
    )


def _last(logs):
    """The moment reports look back from: the last event, one value."""
    return logs.agg(F.max("ts")).first()[0]


@query("error_summary", f"""
    SELECT module, level, count(*) AS n FROM ({LOGS_SQL}) WHERE level IN ('ERROR', 'CRITICAL')
      AND ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR GROUP BY ALL ORDER BY n DESC, module, level""")
def error_summary(spark, sf):
    logs = _logs(spark, sf)
    return activity.error_summary(logs, 240, _last(logs))


@query("op_stats", f"""
    SELECT json_extract_string(context, '$.operation') AS operation, count(*) AS calls, round(avg(CAST(json_extract_string(context, '$.duration_ms') AS DOUBLE)), 1) AS avg_ms,
           max(CAST(json_extract_string(context, '$.duration_ms') AS BIGINT)) AS max_ms FROM ({LOGS_SQL}) GROUP BY 1""", "avg_ms")
def op_stats(spark, sf):
    return activity.operation_stats(_logs(spark, sf))


@query("query_summary", """
    SELECT event_type, count(*) AS n, avg(c) AS average_confidence, avg(ms) AS average_processing_ms, count(*) FILTER (c < 0.35) AS low_confidence_count
    FROM (SELECT event_type, CASE WHEN user_id < 100 THEN value / 50 END AS c, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ms FROM events) GROUP BY ALL""",
    "average_confidence average_processing_ms")
def query_summary(spark, sf):
    rows = _events(spark, sf).select(
        "event_type", F.when(F.col("user_id") < 100, F.col("value") / 50).alias("confidence"),
        F.get_json_object("props", "$.k").cast("double").alias("processing_time_ms"),
    )
    return activity.query_activity(rows, by=("event_type",))


@query("recent_logs", f"""
    SELECT id, ts, level, module FROM ({LOGS_SQL}) WHERE level = 'ERROR' AND contains(module, 'user_1') ORDER BY ts DESC, id DESC LIMIT 200""")
def recent_logs(spark, sf):
    return activity.recent_logs(_logs(spark, sf), level="ERROR", module="user_1").select("id", "ts", "level", "module")


@query("access_trail", f"""
    SELECT id, ts, username, action FROM ({LOGS_SQL}) WHERE action = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY ts DESC, id DESC LIMIT 200""")
def access_trail(spark, sf):
    logs = _logs(spark, sf)
    return activity.access_trail(logs, 24, _last(logs), action="purchase").select("id", "ts", "username", "action")


KEYED_SQL = "SELECT event_id AS id, ts, CASE WHEN event_type <> 'view' THEN event_type || ':' || user_id END AS idempotency_key FROM events"


def _keyed(spark, sf):
    key = F.when(F.col("event_type") != "view", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    return _events(spark, sf).select(F.col("event_id").alias("id"), "ts", key.alias("idempotency_key"))


@query("distinct_queries", f"""
    SELECT id, ts, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, id) AS r FROM ({KEYED_SQL}))
    WHERE idempotency_key IS NULL OR r = 1""")
def distinct_queries(spark, sf):
    return activity.distinct_queries(_keyed(spark, sf))


@query("latest_n_per_user", """
    SELECT username, id, created_at, CAST(row_number() OVER (PARTITION BY username ORDER BY r DESC) AS INTEGER) AS place FROM (
        SELECT user_id AS username, event_id AS id, ts AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""")
def latest_n_per_user(spark, sf):
    pins = _events(spark, sf).select(F.col("user_id").alias("username"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return activity.latest_per_user(pins)


def _attempts_sql(seconds: int, limit: int) -> str:
    return f"""
        SELECT user_id, event_id, ts, n AS attempts, CAST(least(pow(2, n - 1), 16) AS DOUBLE) AS backoff_seconds FROM (
            SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1000000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events)
        WHERE n >= {limit}"""


@query("rate_limit", _attempts_sql(21600, 5))
def rate_limit(spark, sf):
    return activity.repeated_attempts(_events(spark, sf), seconds=21600)


@query("rate_limit_minute", _attempts_sql(60, 2))
def rate_limit_minute(spark, sf):
    return activity.repeated_attempts(_events(spark, sf), limit=2)


# Reports.

_STAT_SQL = """
    SELECT CAST(substr(source, 4) AS BIGINT) AS dataset_id, lang AS metric_name, count(*) AS n, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median,
           coalesce(stddev_samp(n_chars), 0) AS std_dev, min(n_chars) AS min, max(n_chars) AS max FROM documents GROUP BY ALL"""


@query("report_overview", f"""
    WITH r AS ({REGISTRY_SQL}), s AS ({_STAT_SQL})
    SELECT 'title' AS section, 'title' AS key, 'Assessment Report: ' || (SELECT count(*) FROM r) || ' Datasets' AS value
    UNION ALL SELECT 'dataset', CAST(dataset_id AS VARCHAR), name || ' | survey | ' || row_count FROM r
    UNION ALL SELECT 'category_count', CAST(dataset_id AS VARCHAR) || '.' || metric_name, CAST(n AS VARCHAR) FROM s
    UNION ALL SELECT 'citation', CAST(dataset_id AS VARCHAR), 'Dataset: ' || name || ' (ID: ' || dataset_id || ', Type: survey, Records: ' || row_count || ')' FROM r
    UNION ALL SELECT 'statistic', CAST(dataset_id AS VARCHAR) || '.' || metric_name || '.n', n || '.0' FROM s""")
def report_overview(spark, sf):
    docs = table(spark, sf, "documents").withColumn("dataset_id", F.substring("source", 4, 20).cast("long"))
    stats = describe.usage_statistics(docs, "lang", "n_chars", ("dataset_id",)).withColumnRenamed("lang", "metric_name")
    counts = describe.category_counts(docs, "lang", ("dataset_id",)).withColumnRenamed("lang", "category")
    rows = report.report_rows(registry_frame(spark, sf), stats, counts).select("section", "key", "value")
    return rows.where((F.col("section") != "statistic") | F.col("key").endswith(".n"))


@query("report_rows")
def report_full(spark, sf):
    docs = table(spark, sf, "documents").withColumn("dataset_id", F.substring("source", 4, 20).cast("long"))
    stats = describe.usage_statistics(docs, "lang", "n_chars", ("dataset_id",)).withColumnRenamed("lang", "metric_name")
    insights = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.col("conv_id").alias("id"), F.lit("question").alias("question"), F.col("text").alias("answer")
    )
    return report.report_rows(registry_frame(spark, sf), stats, insights=insights)


# Streams over finished input.


def _event_stream(spark, sf):
    events = _events(spark, sf)
    stream = monitors.table_stream(spark, f"{sf}/events.parquet", events.schema)
    return monitors.finished(
        lambda folder: stream.unionByName(monitors.file_stream(spark, folder, events.schema)), events, "ts"
    )


@query("stream_op_stats", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS operation, count(*) AS calls, avg(value) AS avg_ms, max(value) AS max_ms,
           count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""", "avg_ms max_ms")
def stream_op_stats(spark, sf):
    return monitors.collect_available(monitors.operation_windows(_event_stream(spark, sf), "event_type", "value"), "op-stats")


@query("stream_attempts", """
    SELECT w AS window_start, user_id, count(*) AS attempts FROM (
        SELECT user_id, time_bucket(INTERVAL 3600 SECOND, ts) - to_seconds(3600 * unnest(range(0, 6))) AS w, ts FROM events) GROUP BY ALL HAVING count(*) >= 5""")
def stream_attempts(spark, sf):
    windows = monitors.attempt_windows(_event_stream(spark, sf), seconds=21600, slide=3600)
    return monitors.collect_available(windows, "attempts")


@query("stream_exact_attempts", _attempts_sql(21600, 5))
def stream_exact_attempts(spark, sf):
    with attempts.state_store(spark):
        return monitors.collect_available(attempts.exact_attempts(_event_stream(spark, sf), seconds=21600), "exact-attempts")


@query("stream_log_stats", f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, json_extract_string(context, '$.operation') AS operation, count(*) AS calls,
           avg(CAST(json_extract_string(context, '$.duration_ms') AS DOUBLE)) AS avg_ms, max(CAST(json_extract_string(context, '$.duration_ms') AS DOUBLE)) AS max_ms,
           0::BIGINT AS errors FROM ({LOGS_SQL}) GROUP BY ALL""", "avg_ms max_ms")
def stream_log_stats(spark, sf):
    events = _event_stream(spark, sf)
    k = F.get_json_object("props", "$.k")
    context = F.concat(F.lit('{"operation":"'), F.col("event_type"), F.lit('","duration_ms":'), k, F.lit("}"))
    return monitors.collect_available(monitors.live_operation_stats(events.select("ts", context.alias("context"))), "log-stats")


@query("stream_sessions", """
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n_events FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
            SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    return monitors.collect_available(monitors.session_activity(_event_stream(spark, sf)), "sessions")


@query("stream_dedup", f"SELECT idempotency_key, count(*) AS n FROM (SELECT DISTINCT ON (coalesce(idempotency_key, 'row:' || id)) * FROM ({KEYED_SQL})) GROUP BY ALL")
def stream_dedup(spark, sf):
    events = _events(spark, sf)
    stream = monitors.table_stream(spark, f"{sf}/events.parquet", events.schema)
    key = F.when(F.col("event_type") != "view", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    log = stream.select(F.col("event_id").alias("id"), "ts", key.alias("idempotency_key"))
    kept = monitors.collect_available(monitors.deduplicated_log(log, delay="60 days"), "dedup")
    return kept.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"))


@query("stream_redaction", PII_TOTALS_SQL)
def stream_redaction(spark, sf):
    docs = table(spark, sf, "documents")
    stream = monitors.table_stream(spark, f"{sf}/documents.parquet", docs.schema)
    base = scratch_path(spark, "redaction")
    monitors.redaction_running_totals(stream, "text", f"{base}/totals", f"{base}/checkpoint").awaitTermination()
    return monitors.latest_totals(spark, f"{base}/totals")


@query("stream_intake", """
    SELECT lang, count(*) AS n FROM (SELECT text, min(lang) AS lang FROM (SELECT text, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text) GROUP BY text) GROUP BY lang""")
def stream_intake(spark, sf):
    docs = table(spark, sf, "documents")
    stream = monitors.table_stream(spark, f"{sf}/documents.parquet", docs.schema).withColumn("content_key", F.sha2("text", 256))
    base = scratch_path(spark, "intake")
    monitors.intake(stream, f"{base}/rows", f"{base}/keys", ("content_key",), ("doc_id",), f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
