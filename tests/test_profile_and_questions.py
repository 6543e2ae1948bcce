import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.text import normalized_key, token_estimate
from gaugeworks.operators import cells, profile, questions


def test_text_profile(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "How?", "good", "en", "positive"), ("2024-01-02", "How?", "bad", "es", "negative"), ("2024-01-03", "How?", "ok", "en", "neutral")],
        "response_date string, question string, response_text string, language string, expected_sentiment string")
    row = profile.dataset_profile(df, "survey").first()
    assert "response_text" in row["text_columns"] and "response_date" not in row["text_columns"]
    # Hints match inside words, so "sentiment" counts as a date name for holding "time".
    assert row["date_columns"] == ["response_date", "expected_sentiment"] and "en" in row["languages"] and "positive" in row["sentiment_labels"]
    assert row["warnings"] == ["This dataset is small, so patterns may be anecdotal."]


@pytest.mark.parametrize("kind", ["int", "double"])
def test_coded_missing(spark, kind):
    df = spark.createDataFrame([(100, "NY"), (-666, "-888")], "metric_value int, state string").withColumn("metric_value", F.col("metric_value").cast(kind))
    rates = {r["column"]: r["rate"] for r in profile.coded_missing_rates(df).collect()}
    assert rates == {"metric_value": 0.5, "state": 0.5}
    warnings = profile.dataset_profile(df, "usage").first()["warnings"]
    assert warnings[0] == "Coded missing values appear in: metric_value (50%), state (50%)."


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([(None, "n/a"), (None, " NULL ")], "a string, b string")
    assert [r["column"] for r in profile.missing_columns(df).orderBy("position").collect()] == ["a", "b"]
    empty = profile.dataset_profile(df.where("false"), "survey").first()
    assert empty["row_count"] == 0 and "No obvious text response column was detected." in empty["warnings"]
    assert profile.dataset_profile(spark.createDataFrame([("x",)], "a string"), "usage").first()["warnings"][0] == "No obvious numeric metric column was detected."


def test_registry_profiles_equal_those_of_single_tables(spark):
    long = "positive " * 20
    tables = [
        (spark.createDataFrame([(1, "en", long), (2, "en", long), (None, "es", "bad")], "id int, language string, sentiment string"), 7, "a", "survey"),
        (spark.createDataFrame([(1.5, -666.0, None), (float("nan"), 2.0, None)], "value double, other float, gone string"), 3, "b", "usage"),
        (spark.createDataFrame([], "x string, when date"), 5, "c", "circulation"),
        (spark.createDataFrame([([1, 2], {"k": "v"}, True)], "list array<int>, m map<string,string>, `yes.no` boolean"), 9, "d", "other"),
        (spark.createDataFrame([("n/a", "de"), ("NA", "de")], "lang string, language string"), 11, "e", "survey"),
    ]
    together = cells.registry(tables)
    got = {r.dataset_id: r for r in profile.registry_profiles(together).collect()}
    facts = profile.data_dictionary(together.cells()).collect()
    matrix = profile.registry_capabilities(together).collect()
    for df, i, name, kind in tables:
        assert got[i] == profile.dataset_profile(df, kind, name, i).first()
        assert [tuple(r)[1:] for r in sorted(facts) if r.dataset_id == i] == sorted(tuple(r) for r in profile.data_dictionary(df).collect())
        assert sorted(tuple(r)[2:] for r in matrix if r.dataset_id == i) == sorted(tuple(r) for r in profile.capability_matrix(df, kind).collect())
    assert got[7].languages == ["en", "es"] and got[7].sentiment_labels == [long, "bad"]
    # The first column with a hint holds nothing but missing values, so the next one counts.
    assert got[11].languages == ["de"] and got[5].row_count == 0


def test_registry_cells_are_exploded_once(spark):
    tables = [(spark.range(5).toDF("a"), 1, "a", "usage"), (spark.range(3).selectExpr("id b", "id c"), 2, "b", "usage")]
    plan = profile.registry_profiles(cells.registry(tables))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("variant_explode") >= 1 and "CartesianProduct" not in plan
    assert "reason" in profile.classify_datasets(cells.registry(tables).datasets).columns


def test_dictionary(spark):
    long = "y" * 200
    df = spark.createDataFrame([(1, 2.5, "b", long), (2, None, "a", long + "1"), (2, float("nan"), None, long)], "id int, score double, kind string, body string")
    rows = {r["column"]: r for r in profile.data_dictionary(df).collect()}
    assert (rows["score"]["missing_count"], rows["score"]["missing_pct"], rows["score"]["unique_count"]) == (2, 66.67, 1)
    assert rows["kind"]["examples"] == ["a", "b"] and rows["kind"]["role"] == "category" and rows["score"]["role"] == "numeric measure"
    assert rows["body"]["unique_count"] == 2 and all(len(e) == 80 for e in rows["body"]["examples"])


def test_capabilities(spark):
    df = spark.createDataFrame([("2024-01-01", "a" if i % 2 else "b", float(i), float(i * i)) for i in range(12)], "date string, grp string, x double, y double")
    got = {r["analysis"]: r["available"] for r in profile.capability_matrix(df, "usage").collect()}
    assert got == {"qualitative_sentiment": False, "qualitative_themes": False, "correlation": True, "trend": True, "comparative": True, "distribution": True, "rag_query": True}
    few = {r["analysis"]: r["reason"] for r in profile.capability_matrix(df.limit(5), "survey").collect()}
    assert few["qualitative_themes"] == "Only 5 rows — need at least 10 for meaningful analysis."
    sparse = df.withColumn("z", F.when(F.col("x") < 3, F.col("x")))
    assert profile.capability_summary(sparse, "usage").first()["warning"] == "Columns with >50% missing values: z"


def test_metadata(spark):
    df = spark.createDataFrame([("2024-02-01", "R1", 3), ("2024-01-01", "R2", 4)], "Date string, Room string, Bookings int")
    row = profile.metadata_suggestions(df, "spaces", "/x/libcal_export-2024.csv").first()
    assert row["source"] == "LibCal" and row["title"] == "Libcal Export 2024" and "2024-01-01 to 2024-02-01" in row["description"]
    assert profile.data_dictionary(df).orderBy("position").first()["role"] == "date/time"


def test_registry(spark):
    df = spark.createDataFrame([(1, "a", "survey", "t", "d", "s", "u", "e", "completed"), (2, "b", "usage", "t", None, "", None, "e", None), (3, "c", "usage", "t", "d", "s", None, None, "failed")],
        "dataset_id long, name string, dataset_type string, title string, description string, source string, usage_notes string, ethical_considerations string, indexing_status string")
    assert [r["missing_fields"] for r in profile.metadata_gaps(df).orderBy("dataset_id").collect()] == ["complete", "description, source, usage_notes", "usage_notes, ethical_considerations"]
    assert tuple(profile.registry_rollup(df).first()) == (3, 1, 1, 1, 1, 2)


INTENTS = [("What data do I have?", "data_inventory"), ("main themes", "qualitative"), ("average visits", "quantitative"), ("executive summary", "reporting"), ("any null values", "data_quality"), ("hello", "retrieval")]


def test_intents(spark):
    df = spark.createDataFrame(INTENTS, "text string, want string")
    assert questions.classify_questions(df).where(F.col("intent") != F.col("want")).count() == 0


def test_targets(spark):
    profiles = spark.createDataFrame([("Gate Counts", "spaces", False, True), ("Comments", "survey", True, False)], "name string, dataset_type string, has_text boolean, has_numeric boolean")
    asked = spark.createDataFrame([(1, "themes in gate counts"), (2, "total loans"), (3, "sentiment"), (4, "hi")], "id long, text string")
    rows = questions.target_datasets(asked, profiles, "id").collect()
    assert {(r["id"], r["dataset_name"]) for r in rows} == {(1, "Gate Counts"), (1, "Comments"), (2, "Gate Counts"), (3, "Comments"), (4, "Gate Counts"), (4, "Comments")}
    assert len(rows) == 6


def test_targets_of_unknown_types_and_names_that_change_length(spark):
    profiles = spark.createDataFrame([("İdare", "robotics", False, False), ("Plain", None, False, False)], "name string, dataset_type string, has_text boolean, has_numeric boolean")
    asked = spark.createDataFrame([(1, "themes in robotics"), (2, "themes of İdare"), (3, "themes")], "id long, text string")
    rows = questions.target_datasets(asked, profiles, "id").where(F.col("intent") == "qualitative").collect()
    assert {(r["id"], r["dataset_name"]) for r in rows} == {(1, "İdare"), (2, "İdare")}


def test_values_are_tested_beyond_their_heads(spark):
    long = "x" * 100
    facts = profile.column_facts(spark.createDataFrame([(f"{long} 2024-05-01",), (f"{long} 3/4",), (long,), ("0" * 90 + "7",)], "v string")).first()
    assert (facts["dateish_count"], facts["number_count"], facts["n_rows"]) == (2, 1, 4)


def test_evidence(spark):
    df = spark.createDataFrame([(0.7, 3, "retrieval", "q"), (0.7, 2, "retrieval", "overview"), (0.1, 5, "retrieval", "q"), (0.0, 0, "data_quality", "q")], "confidence double, citations int, intent string, question string")
    rows = questions.assess_evidence(df).collect()
    bare = questions.assess_evidence(df, has_profiles=False).collect()
    assert (bare[3]["label"], bare[3]["score"]) == ("Low", 0.0) and bare[0]["label"] == "High"
    assert [r["label"] for r in rows] == ["High", "Medium", "Low", "High"] and rows[3]["score"] == 1.0 and "Broad" in rows[1]["reason"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  A\t b  C ", "A" * 1000), (None, None)], "t string, u string")
    rows = df.select(normalized_key("t").alias("k"), token_estimate("u").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("a b c", 250), ("", None)]


def test_edge_cases(spark):
    df = spark.createDataFrame([(f"2024-01-{i + 1:02d}", float(i) if i else float("nan"), 1.0 if i else None) for i in range(9)] + [("2024-02-01", 500.0, 1.0)], "date string, x double, flat double")
    rows = {r["column"]: r for r in profile.numeric_edge_cases(df).collect()}
    assert (rows["x"]["outliers"], rows["x"]["missing_pct"]) == (1, 10.0) and rows["flat"]["outliers"] == 0
    assert rows["date"]["outliers"] is None and rows["date"]["trend_ready"] and rows["date"]["position"] == 0
