from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import activity, report
from gaugeworks.streaming import attempts as exact
from gaugeworks.streaming import monitors

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def attempts(spark):
    """One user makes a third of all attempts."""
    rng = np.random.default_rng(2)
    rows = [(i, 0 if rng.random() < 0.34 else int(rng.integers(1, 9)), START + timedelta(seconds=float(np.round(rng.random() * 1500, 3)))) for i in range(900)]
    rows += [(900 + i, 50, START + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 30, 60, 240, 240, 250, 299.999999, 300))]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


@pytest.mark.parametrize("spans", [1, 4])
def test_repeated_attempts_match_direct_count(attempts, spans):
    rows, df = attempts
    want = {}
    for i, user, ts in rows:
        n = sum(1 for _, u, t in rows if u == user and timedelta(0) <= ts - t < timedelta(seconds=60))
        if n >= 5:
            want[i] = (n, min(2.0 ** (n - 1), 16.0))
    got = {r["event_id"]: (r["attempts"], r["backoff_seconds"]) for r in activity.repeated_attempts(df, spans=spans).collect()}
    assert got == want and got


def test_logs(spark):
    rows = [(i, START + timedelta(hours=i), "ERROR" if i % 2 else "INFO", "mod_a" if i % 3 else "b", '{"operation":"op","duration_ms":%d}' % i) for i in range(10)]
    logs = spark.createDataFrame(rows + [(10, START, "CRITICAL", "b", "not json"), (11, START, "INFO", "b", None)], "id long, ts timestamp, level string, module string, context string")
    errors = [tuple(r) for r in activity.error_summary(logs, 24, START + timedelta(hours=9)).collect()]
    assert errors == [("mod_a", "ERROR", 3), ("b", "ERROR", 2), ("b", "CRITICAL", 1)]
    assert activity.error_summary(logs, 1, START + timedelta(hours=9)).count() == 1
    assert tuple(activity.operation_stats(logs).first()) == ("op", 10, 4.5, 9)
    assert [r["id"] for r in activity.recent_logs(logs, 2, level="ERROR", module="mod").collect()] == [7, 5]


def test_query_log(spark):
    rows = spark.createDataFrame([(0.2, 100), (0.9, None), (None, 300)], "confidence double, processing_time_ms int")
    row = activity.query_activity(rows).first()
    assert (row["n"], row["average_confidence"], row["average_processing_ms"], row["low_confidence_count"]) == (3, pytest.approx(0.55), 200.0, 1)
    assert tuple(activity.query_activity(rows.where("false")).first()) == (0, None, None, 0)
    log = spark.createDataFrame([(1, START, "k"), (2, START, "k"), (3, START, None), (4, START, None)], "id long, ts timestamp, idempotency_key string")
    assert sorted(r["id"] for r in activity.distinct_queries(log).collect()) == [1, 3, 4]


def test_pins(spark):
    pins = spark.createDataFrame([(i, "u", START + timedelta(minutes=i), f"k{i}") for i in range(25)], "id long, username string, created_at timestamp, idempotency_key string")
    kept = activity.latest_per_user(pins).orderBy("place").collect()
    assert [r["id"] for r in kept] == list(range(5, 25)) and kept[0]["place"] == 1
    again = activity.pin(pins, pins.limit(3).withColumn("id", F.col("id") + 100))
    assert again.count() == 25
    assert activity.unpin(pins, 3, "other").count() == 25 and activity.unpin(pins, 3, "u").count() == 24


def test_report(spark):
    datasets = spark.createDataFrame([(1, "Visits", "usage", 10), (2, "Survey", "survey", 5)], "dataset_id long, name string, dataset_type string, row_count long")
    themes = spark.createDataFrame([(2, "Theme 1: a", 3, ["a", "x@y.com"]), (9, "Theme 9", 1, ["z"])], "dataset_id long, theme_name string, frequency long, keywords array<string>")
    analyses = spark.createDataFrame([(i, 1, "trend", "mail a@b.com", None, None, START + timedelta(days=i)) for i in range(12)], "analysis_id long, dataset_id long, analysis_type string, interpretation string, insights string, recommendations string, ts timestamp")
    insights = spark.createDataFrame([(1, "who?", "call 555-123-4567")], "id long, question string, answer string")
    rows = report.report_rows(datasets, themes=themes, analyses=analyses, insights=insights).orderBy("section_no", "seq").collect()
    by = {}
    for r in rows:
        by.setdefault(r["section"], []).append(r["value"])
    assert by["title"] == ["Assessment Report: 2 Datasets"] and len(by["analysis"]) == 10 and set(by["analysis"]) == {"mail [EMAIL]"}
    assert by["theme"] == ["a, [EMAIL] (3)"] and by["pinned_insight"] == ["call [PHONE]"]
    assert by["citation"][0] == "Dataset: Visits (ID: 1, Type: usage, Records: 10)" and by["citation"][-1] == "Pinned Query Insights: 1 item(s) selected by user"


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.fixture(scope="module")
def event_folder(spark, attempts, tmp_path_factory):
    _, df = attempts
    folder = str(tmp_path_factory.mktemp("events") / "in")
    kinds = F.element_at(F.array(*map(F.lit, ("error", "view", "click"))), (F.col("event_id") % 3 + 1).cast("int"))
    df.withColumn("event_type", kinds).withColumn("value", F.col("event_id").cast("double")).repartition(3).write.parquet(folder)
    return folder, spark.read.parquet(folder)


@pytest.mark.parametrize("job", [
    lambda df: monitors.operation_windows(df, "event_type", "value", window="5 minutes"),
    lambda df: monitors.attempt_windows(df),
    lambda df: monitors.session_activity(df, gap="40 seconds"),
])
def test_stream_equals_batch(spark, event_folder, job):
    folder, batch = event_folder
    stream = monitors.file_stream(spark, folder, batch.schema, max_files=10)
    closed = monitors.finished(lambda extra: stream.unionByName(monitors.file_stream(spark, extra, batch.schema)), batch, "ts")
    same(monitors.collect_available(job(closed), "job"), job(batch))


def test_intake_is_exactly_once_across_runs(spark, tmp_path):
    folder, base = tmp_path / "drop", str(tmp_path / "out")
    schema = "k string, v long"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).coalesce(1).write.parquet(str(folder))

    def run(checkpoint="checkpoint"):
        stream = monitors.file_stream(spark, str(folder), spark.createDataFrame([], schema).schema, max_files=1)
        monitors.intake(stream, f"{base}/rows", f"{base}/keys", ("k",), ("v",), f"{base}/{checkpoint}").awaitTermination()
        return sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{base}/rows").collect())

    assert run() == [("a", 1), ("b", 3)]
    spark.createDataFrame([("b", 9), ("c", 4)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    assert run() == [("a", 1), ("b", 3), ("c", 4)] and run() == [("a", 1), ("b", 3), ("c", 4)]
    # A new checkpoint starts again at batch 0, sees all files and must neither lose nor repeat rows.
    spark.createDataFrame([("d", 5)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    assert run("another") == [("a", 1), ("b", 3), ("c", 4), ("d", 5)] and run() == [("a", 1), ("b", 3), ("c", 4), ("d", 5)]


def test_stream_redaction_and_dedup(spark, tmp_path):
    schema = "id long, ts timestamp, idempotency_key string, text string"
    rows = [(1, START, "k", "a@b.com"), (2, START, "k", "a@b.com c@d.com"), (3, START, None, "x"), (4, START, None, "y")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitors.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    kept = monitors.collect_available(monitors.deduplicated_log(stream), "dedup")
    assert kept.count() == 3 and kept.where("idempotency_key is null").count() == 2
    for more in ([], [(5, START, None, "z@y.org")]):
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        monitors.redaction_running_totals(stream, "text", str(tmp_path / "totals"), str(tmp_path / "cp")).awaitTermination()
        got = {r["kind"]: r["total"] for r in monitors.latest_totals(spark, str(tmp_path / "totals")).collect()}
        assert got == {"email": 3 + len(more), "phone": 0, "ssn": 0, "address": 0}


def test_stream_queries_read_tables_that_are_folders(spark, tmp_path):
    import __spark_entry__ as entry

    docs = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a@b.com", "en", "src1", 7), (2, "a@b.com", "de", "src1", 7), (3, "c@d.org x", "de", "src2", 9), (4, "plain", "fr", "src2", 5)]
    spark.createDataFrame(rows, docs).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    events = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(i, START + timedelta(minutes=i), 1, "view", 1.0, "{}") for i in range(3)]
    spark.createDataFrame(rows, events).repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path))
    assert sorted((r["lang"], r["n"]) for r in run("stream_intake").collect()) == [("de", 1), ("en", 1), ("fr", 1)]
    assert {r["kind"]: r["total"] for r in run("stream_redaction").collect()} == {"email": 3, "phone": 0, "ssn": 0, "address": 0}
    assert [r["calls"] for r in run("stream_op_stats").collect()] == [3]


def test_exact_attempts_equal_the_batch_report(spark, event_folder):
    folder, batch = event_folder
    stream = monitors.file_stream(spark, folder, batch.schema, max_files=10)
    closed = monitors.finished(lambda extra: stream.unionByName(monitors.file_stream(spark, extra, batch.schema)), batch, "ts")
    for seconds, limit in ((60, 2), (3600, 3)):
        with exact.state_store(spark):
            got = monitors.collect_available(exact.exact_attempts(closed, seconds=seconds, limit=limit), "exact")
        same(got, activity.repeated_attempts(batch, seconds=seconds, limit=limit).withColumn("ts", F.col("ts").cast("timestamp")))


def test_state_of_exact_attempts_does_not_grow_with_users(spark, tmp_path):
    """Ids beyond 2^53 stay exact beside a null one."""
    schema = "event_id long, ts timestamp, user_id long"
    rows = [(i, START, i) for i in range(3000)] + [(2**53 + 1, START, 7), (None, START, 7), (1, START, None), (2, START, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    closed = monitors.finished(lambda folder: monitors.file_stream(spark, str(tmp_path / "in"), batch.schema).unionByName(monitors.file_stream(spark, folder, batch.schema)), batch, "ts")
    found = exact.exact_attempts(closed, seconds=60, limit=2)
    with exact.state_store(spark):
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) < 1000
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()
    want = [(7, 7, 3), (7, 2**53 + 1, 3), (7, None, 3), (None, 1, 2), (None, 2, 2)]
    assert sorted(str((r["user_id"], r["event_id"], r["attempts"])) for r in got) == sorted(map(str, want))


QUICK = (
    "usage_stats", "circulation_rows", "data_dictionary", "group_stats", "trend_fit", "acf", "corr_pearson", "anova", "shape", "pii_redact",
    "intent_classify", "lexicon_sentiment", "knn_top5", "retrieval_metrics", "table_diff", "op_stats", "rate_limit", "latest_n_per_user",
)


@pytest.fixture(scope="module")
def database():
    from pathlib import Path

    db = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, database, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    result = database.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, result.fetchall())) == sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
