import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions.coerce import looks_like_period, to_day
from gaugeworks.operators import normalize
from gaugeworks.sources import diff, indexing, intake, ledger
from gaugeworks.sources import store as store_module
from gaugeworks.sources.store import Load, Store


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("line,mark", [("a\tb,c", "\t"), ("a|b|c,d", "|"), ("a;b;c,d", ";"), ("a;b,c", ","), ("a,b", ",")])
def test_delimiter(line, mark):
    assert intake.detect_delimiter([line]) == mark


def test_delimited_with_repeated_and_blank_names(spark, tmp_path):
    path = write(tmp_path, "x.csv", "a;a; ;c\n1;2;3;\n4;5;6;\n")
    df = intake.read_delimited(spark, path)
    assert df.columns == ["a", "a_2", "unnamed", "c"]
    assert intake.clean(df).columns == ["a", "a_2", "unnamed"]
    assert intake.read_file(spark, write(tmp_path, "x.tsv", "a\tb\n1\t2\n")).collect()[0]["b"] == 2
    with pytest.raises(ValueError):
        intake.read_file(spark, "x.xlsx")


def test_json_shapes(spark, tmp_path):
    rows = [{"id": 1, "who": {"name": "x"}}, {"id": 2, "who": {"name": "y"}}]
    listed = intake.read_json(spark, write(tmp_path, "a.json", json.dumps(rows)))
    assert listed.columns == ["id", "who.name"] and listed.count() == 2
    nested = intake.read_json(spark, write(tmp_path, "b.json", json.dumps({"meta": [{"k": 1}], "items": rows})))
    assert sorted(nested.columns) == ["id", "who.name"] and nested.count() == 2
    single = intake.read_json(spark, write(tmp_path, "c.json", json.dumps({"id": 7, "who": {"name": "z"}})))
    assert single.columns == ["id", "who.name"] and single.count() == 1


def test_chat_log_becomes_reference(spark, tmp_path):
    rows = [{"timestamp": "2024-01-01", "question_text": "where", "channel": "web"}] * 2
    df, kind = intake.ingest(spark, write(tmp_path, "chat.json", json.dumps(rows)))
    assert kind == "reference" and "response_text" in df.columns and "response_date" in df.columns


def test_cleaning_drops_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None), (2, None, None)], "a int, b string, c string")
    out = intake.clean(df)
    assert out.columns == ["a", "c"] and out.count() == 2


def test_validation(spark):
    rules = lambda df, kind, strict=True: {(r["rule"], r["column"]) for r in intake.validate(df, kind, strict).collect()}
    usage = spark.createDataFrame([("2024-01-01", "visits", None)], "date string, metric_name string, metric_value double")
    assert rules(usage, "usage") == {("empty_column", "metric_value")}
    assert rules(usage.where("false"), "usage") == {("empty_frame", None)}
    assert ("missing_column", "question") in rules(usage, "survey") and rules(usage, "survey", False) == {("empty_column", "metric_value")}
    twice = usage.select("date", "metric_name", F.lit(1).alias("x"), F.lit(2).alias("x"))
    assert ("duplicate_column", "x") in rules(twice, "survey", False)


def test_type_detection(spark):
    assert normalize.detect_type(["Date", "Room", "Bookings"], "libcal.csv") == "spaces"
    assert normalize.detect_type(["a"], "", True) == "usage" and normalize.detect_type(["a"]) == "survey"
    assert normalize.detect_type(["early"]) == "benchmark" and normalize.detect_type(["early"], whole_words=True) == "survey"
    assert normalize.source_of(["Date"], "libcal.csv") == "LibCal"
    manifest = spark.createDataFrame([("libcal.csv", ["Date", "Room"], False), ("x", ["a"], True)], "filename string, columns array<string>, has_numeric boolean")
    assert [r["dataset_type"] for r in normalize.detect_types(manifest).collect()] == ["spaces", "usage"]


def test_wide_periods(spark):
    df = spark.createDataFrame([("J1", "Requests", 1, 2), ("J2", "Searches", 3, 4)], ["Title", "Metric Type", "Jan 2026", "Feb 2026"])
    assert normalize.detect_type(df.columns) == "e_resource"
    rows = normalize.usage_rows(normalize.normalize(df, "e_resource"), 5).collect()
    assert len(rows) == 4 and {str(r["date"]) for r in rows} == {"2026-01-01", "2026-02-01"} and {r["category"] for r in rows} == {"J1", "J2"}
    assert looks_like_period("2024-05") and looks_like_period("Sept 2024") and not looks_like_period("Title")


def test_renames(spark):
    df = spark.createDataFrame([("2024-01-01", "north", 4)], "visit_date string, branch_group string, visits int")
    out = normalize.metric_columns(df, "usage")
    assert set(out.columns) == {"date", "category", "metric_value", "metric_name"}
    assert out.first()["metric_name"] == "General usage statistics"
    text = normalize.text_columns(spark.createDataFrame([("t", "d", "q")], "comment string, survey_time string, topic string"))
    assert text.columns == ["response_text", "response_date", "question"]


def test_circulation_counts(spark):
    df = spark.createDataFrame([("2024-01-01", "Book", "Student")] * 3 + [("2024-01-02", "DVD", "Faculty")], "checkout_date string, material_type string, patron_type string")
    rows = normalize.circulation_rows(df, 1)
    assert rows.count() == 4 and rows.first()["metric_value"] == 1.0
    packed = {(r["metric_name"], r["category"]): r["metric_value"] for r in normalize.circulation_rows(df, 1, True).collect()}
    assert packed == {("Book", "Student"): 3.0, ("DVD", "Faculty"): 1.0}
    wide = normalize.analysis_frame(rows, fill_zero=True).orderBy("date").collect()
    assert (wide[0]["Book"], wide[0]["DVD"], wide[1]["Book"]) == (3.0, 0.0, 0.0)


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-03-05",), ("03/05/2024",), ("Mar 2024",), ("nonsense",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(to_day("t")).collect()] == ["2024-03-05", "2024-03-05", "2024-03-01", "None", "None"]


def test_operation_keys(spark):
    assert ledger.operation_key("op", {"b": 1, "a": " X  y "}) == ledger.operation_key("op", {"a": "x Y", "b": 1})
    assert ledger.operation_key("op", "a") != ledger.operation_key("op", "b")
    df = spark.createDataFrame([("  Hash ", 'Na"me  é'), (None, "x")], "h string, n string")
    rows = df.select(ledger.operation_key_column("store_dataset", "h", "n").alias("k")).withColumn("i", ledger.key_to_id_column(F.col("k"))).collect()
    assert rows[0]["k"] == ledger.operation_key("store_dataset", "  Hash ", 'Na"me  é')
    assert rows[0]["i"] == ledger.key_to_id(rows[0]["k"]) > 0


def test_store_life_cycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("2024-01-01", "visits", 10.0, "a"), ("2024-01-02", "visits", 20.0, "b")], "date string, metric_name string, metric_value double, category string")
    first = store.add_dataset(df, "Visits", "usage", "h1", {"title": "T"}, datetime(2024, 1, 1))
    assert store.add_dataset(df, " visits", "usage", "h1") == first
    text = spark.createDataFrame([("2024-01-01", "How?", "Fine")], "response_date string, question string, response_text string")
    second = store.add_dataset(text, "Survey", "survey", "h2", as_of=datetime(2024, 1, 2))
    assert store.table("usage_statistics").count() == 2 and store.table("datasets").count() == 2
    assert [r["dataset_id"] for r in store.catalog().collect()] == [second, first]
    assert store.check_duplicate("h1").first()["name"] == "Visits"
    assert store.preview(first, 1).count() == 1 and json.loads(store.manifest().first()["manifest"])["type"] == "survey"
    store.add_provenance(first, "sentiment", "lexicon", {"k": 1}, datetime(2024, 1, 3))
    store.add_query(first, "why?", "u", datetime(2024, 1, 4))
    assert [r["kind"] for r in store.provenance(first).collect()] == ["transformation", "query"]
    a = store.add_analysis(first, "trend", {"c": 1}, {"slope": 2.0, "insights": "text"}, datetime(2024, 1, 5))
    store.add_analysis(first, "correlation", {}, {"r": 1.0}, datetime(2024, 1, 6))
    listed = store.analyses(first).collect()
    assert [r["analysis_type"] for r in listed] == ["correlation", "trend"] and listed[1]["has_insights"] and not listed[1]["has_interpretation"]
    assert store.analyses(first, "trend", 1).count() == 1 and json.loads(store.analysis(a).first()["statistical_results"]) == {"slope": 2.0}
    store.export(first, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    store.record("op", "k", "failed", error="no", as_of=datetime(2024, 1, 1))
    assert store.completed_result("op", "k") is None
    assert store.delete_dataset(first) and not store.delete_dataset(first)
    assert store.table("usage_statistics").count() == 0 and store.table("analyses").count() == 0 and store.table("datasets").count() == 1
    assert store.add_dataset(df, "Visits", "usage", "h1") == first and store.facts(first).count() == 2


def test_row_ids_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "COPIES", 3)
    rows = [(f"2024-01-{i % 9 + 1:02d}", "visits", float(i % 5), None) for i in range(60)] + [("2024-02-01", "x", 1.0, "c")] * 20
    df = spark.createDataFrame(rows, "date string, metric_name string, metric_value double, category string")
    ids = []
    for parts in (2, 3):
        store = Store(spark, str(tmp_path / f"s{parts}"))
        facts = store.facts(store.add_dataset(df.repartition(parts), "n", "usage", "h"))
        ids.append(sorted((r["id"], str(r["date"]), r["metric_value"]) for r in facts.collect()))
    assert ids[0] == ids[1] and len({i for i, _, _ in ids[0]}) == 80


def test_many_datasets_are_loaded_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    usage = spark.createDataFrame([("2024-01-01", "visits", 10.0)] * 3, "date string, metric_name string, metric_value double")
    text = spark.createDataFrame([("2024-01-01", "How?", "Fine")], "response_date string, question string, response_text string")
    first = store.add_dataset(usage, "old", "usage", "h0", as_of=datetime(2024, 1, 1))
    loads = [Load(usage, f"u{i}", "usage", f"h{i}") for i in range(1, 4)] + [Load(text, "s", "survey", "hs", {"title": "T", "keywords": ["k"]}), Load(usage.limit(0), "none", "usage", "he"), Load(usage, "old", "usage", "h0")]
    ids = store.add_datasets(loads, datetime(2024, 1, 2))
    assert len(set(ids)) == 6 and ids[-1] == first
    rows = {r["dataset_id"]: r for r in store.catalog().collect()}
    assert {i: rows[i]["row_count"] for i in ids} == dict(zip(ids, [3, 3, 3, 1, 0, 3], strict=True))
    assert rows[first]["upload_date"] == datetime(2024, 1, 1) and rows[ids[3]]["title"] == "T" and rows[ids[0]]["column_names"] == usage.columns
    assert store.completed_result("store_dataset", ledger.operation_key("store_dataset", "h1", "u1", "usage")) == {"dataset_id": ids[0], "idempotency_reused": True}
    again = {r["name"]: r["is_new"] for r in store.load(
        spark.createDataFrame([("u1", "usage", "h1"), ("v", "usage", "hv")], "name string, dataset_type string, file_hash string"),
        usage.withColumns({"name": F.lit("v"), "dataset_type": F.lit("usage"), "file_hash": F.lit("hv")}).withColumn("date", F.to_date("date")),
    ).collect()}
    assert again == {"u1": False, "v": True} and store.table("datasets").count() == 7
    assert store.table("usage_statistics").count() == 15 and store.delete_dataset(ids[1]) and store.table("datasets").count() == 6


def test_a_second_indexing_run_encodes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    usage = spark.createDataFrame([("2024-01-01", "visits", 10.0)], "date string, metric_name string, metric_value double")
    a, b = store.add_datasets([Load(usage, "a", "usage", "ha"), Load(usage, "b", "usage", "hb")])
    rows = [(f"p{i}", a, f"text {i}") for i in range(6)] + [("q", b, "other"), ("q", b, "other")]
    passages = spark.createDataFrame(rows, "passage_id string, dataset_id long, text string")
    encoded = []

    def encode(df):
        encoded.append(sorted(r["passage_id"] for r in df.collect()))
        return df.withColumn("embedding", F.array(F.char_length("text").cast("float")))

    both = spark.createDataFrame([(a,), (b,)], "dataset_id long")
    run = lambda df: {r["dataset_id"]: tuple(r)[1:] for r in indexing.index_run(store, df, encode, both).collect()}
    assert run(passages) == {a: (6, 0, 0), b: (1, 0, 0)} and run(passages) == {a: (0, 6, 0), b: (0, 1, 0)}
    changed = passages.where("dataset_id = %d and passage_id <> 'p0'" % a).withColumn("text", F.when(F.col("passage_id") == "p1", "longer text").otherwise(F.col("text")))
    assert run(changed) == {a: (1, 4, 1), b: (0, 0, 1)}
    assert encoded == [["p0", "p1", "p2", "p3", "p4", "p5", "q"], [], ["p1"]]
    got = {r["passage_id"]: r["embedding"] for r in store.table("passages").collect()}
    assert got == {"p1": [11.0], "p2": [6.0], "p3": [6.0], "p4": [6.0], "p5": [6.0]}
    assert {r["dataset_id"]: r["indexing_status"] for r in store.table("datasets").collect()} == {a: "completed", b: "pending"}


def test_half_written_load_is_repeated_not_doubled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("2024-01-01", "visits", 10.0)], "date string, metric_name string, metric_value double")
    key = ledger.operation_key("store_dataset", "h", "n", "usage")
    store.replace_datasets("usage_statistics", normalize.usage_rows(df, ledger.key_to_id(key)))
    assert store.facts(store.add_dataset(df, "n", "usage", "h")).count() == 1


def test_file_hashes(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        write(tmp_path, name, text)
    hashes = intake.file_hashes(spark, str(tmp_path))
    assert [r["copies"] for r in intake.duplicates(hashes, "file_hash", "path").collect()] == [2]


def test_new_rows(spark):
    stored = spark.createDataFrame([("a",)], "k string")
    incoming = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in ledger.new_rows(incoming, stored, ["k"], ["v"]).collect()] == [("b", 2)]


def test_table_diff(spark):
    left = spark.createDataFrame([(1, 1.0, "x"), (2, None, ""), (3, 5.0, "z"), (None, 1.0, "n")], "k int, v double, t string")
    right = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, float("nan"), None), (4, 5.0, "z"), (None, 2.0, "n")], "k int, v double, t string")
    got = {(r["k"], r["kind"], r["column"]) for r in diff.table_diff(left, right, ["k"]).collect()}
    assert got == {(3, "left_only", None), (4, "right_only", None), (None, "changed", "v")}
    assert diff.tables_equivalent(left, left.select("t", "v", "k")) and not diff.tables_equivalent(left, right)
    numbers, texts = spark.createDataFrame([(1, 0.0)], "k int, v double"), spark.createDataFrame([(1, "000")], "k int, v string")
    assert diff.tables_equivalent(numbers, texts, ["k"])


def test_columns_on_one_side_and_buckets(spark):
    left = spark.createDataFrame([(1, 2, 3), (2, 2, 3)], "k int, a int, b int")
    right = spark.createDataFrame([(1, 2), (2, 5)], "k int, a long")
    for buckets in (None, 4):
        got = {tuple(r) for r in diff.table_diff(left, right, ["k"], buckets=buckets).collect()}
        assert got == {(2, "changed", "a", "2", "5"), (None, "left_column", "b", None, None)}
    many = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("t"))
    other = many.where("k <> 5").withColumn("v", F.when(F.col("k") == 77, 1.25).when(F.col("k") == 78, F.col("v") + 1e-12).otherwise(F.col("v"))).withColumn("t", F.coalesce("t", F.lit("")))
    got = sorted((r["k"], r["kind"]) for r in diff.table_diff(many, other, ["k"], buckets=64).collect())
    assert got == [(5, "left_only"), (77, "changed")]
    assert diff.differing_buckets(many, other, ["k"], ["v", "t"], 64).count() <= 3


ROWS = st.lists(st.tuples(st.sampled_from(["2024-01-01", "2024-12-31"]), st.text(alphabet="abc \",;é\n", min_size=1, max_size=12), st.integers(0, 10000)), min_size=1, max_size=12)


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(ROWS)
def test_round_trip(spark, tmp_path_factory, rows):
    df = spark.createDataFrame([(d, t.strip() or "x", float(v)) for d, t, v in rows], "date string, metric_name string, metric_value double")
    assert diff.tables_equivalent(df, df)
    assert diff.round_trips(df, str(tmp_path_factory.mktemp("rt") / "csv"))


def test_a_comparison_carries_the_rows_to_be_encoded_and_no_others(spark):
    from gaugeworks.sources import indexing

    schema = "passage_id string, dataset_id long, text string"
    new = spark.createDataFrame([("a", 1, "same"), ("b", 1, "now"), ("c", 1, "first"), (None, 1, "nameless")], schema)
    old = spark.createDataFrame([("a", 1, "same"), ("b", 1, "then"), ("d", 1, "gone"), ("z", 2, "not asked")], schema)
    found = indexing.changes(new, old, spark.createDataFrame([(1,)], "dataset_id long"), carried=True).collect()
    assert {(r["passage_id"], r["kind"], r["row"] and r["row"]["text"]) for r in found} == {
        ("a", "same", None), ("b", "changed", "now"), ("c", "new", "first"), ("d", "removed", None), (None, "new", None),
    }
