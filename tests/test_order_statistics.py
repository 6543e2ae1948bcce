import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import describe, ordered

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, and a third of that group's rows on one value."""
    rng = np.random.default_rng(7)
    group = np.where(rng.random(6000) < 0.34, "hot", rng.choice(list("abcdefgh"), 6000))
    value = np.round(rng.normal(0, 50, 6000), 2)
    value = np.where((group == "hot") & (rng.random(6000) < 0.33), 1.5, value)
    frame = pd.DataFrame({"g": group, "v": value})
    return frame, spark.createDataFrame(frame).repartition(8).cache()


@pytest.mark.parametrize("per_slice", [3, 60, 100_000])
def test_quantiles_match_numpy(skewed, per_slice):
    frame, df = skewed
    got = {r["g"]: r["q"] for r in ordered.quantiles(df, "v", PROBS, ["g"], per_slice).collect()}
    for g, part in frame.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], PROBS))
    whole = ordered.quantiles(df, "v", PROBS, (), per_slice).first()["q"]
    assert np.allclose(whole, np.quantile(frame["v"], PROBS))


def test_average_ranks_match_pandas(skewed):
    frame, df = skewed
    got = ordered.average_ranks(df, "v", ["g"], 40).toPandas().set_index(["g", "v"])["avg_rank"]
    want = frame.assign(r=frame.groupby("g")["v"].rank()).drop_duplicates(["g", "v"]).set_index(["g", "v"])["r"]
    assert np.allclose(got.sort_index(), want.sort_index())


def test_positions_are_complete(spark):
    df = spark.range(0, 1000).withColumn("k", F.col("id") * 3)
    got = ordered.positions(df, "k", per_slice=50).orderBy("k").collect()
    assert [r["position"] for r in got] == list(range(1, 1001))


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    for per_slice in (1, 100):
        got = {r["g"]: r["q"][0] for r in ordered.quantiles(df, "v", [0.5], ["g"], per_slice).collect()}
        assert got == {None: 2.0, "a": 5.0}


def test_running_totals_do_not_depend_on_slices(skewed):
    _, df = skewed
    counts = ordered.value_counts(df, "v", ["g"])
    tables = [ordered.running_before(counts, "v", ["n"], ["g"], k).toPandas().sort_values(["g", "v"]).reset_index(drop=True) for k in (1, 7, 100_000)]
    for table in tables[1:]:
        pd.testing.assert_frame_equal(tables[0], table[tables[0].columns])


def test_large_groups_are_not_sorted_by_one_task(skewed):
    _, df = skewed
    slices = ordered.sliced(ordered.value_counts(df, "v"), "v", per_slice=50).groupBy("_slice").count().toPandas()
    assert len(slices) > 30 and slices["count"].max() < 600


def test_metric_summary(spark):
    df = spark.createDataFrame(
        [("visits", 100.0, "library"), ("visits", 150.0, "library"), ("checkouts", 50.0, "circulation"), ("checkouts", 75.0, "circulation"),
         ("single", 4.0, ""), ("nothing", None, None)], "metric_name string, metric_value double, category string")
    rows = {r["metric_name"]: r for r in describe.usage_statistics(df).collect()}
    assert set(rows) == {"visits", "checkouts", "single"}
    assert (rows["visits"]["n"], rows["visits"]["mean"], rows["visits"]["median"], rows["visits"]["min"], rows["visits"]["max"]) == (2, 125, 125, 100, 150)
    assert rows["checkouts"]["median"] == 62.5
    assert rows["single"]["std_dev"] == 0.0
    assert {r["category"]: r["n"] for r in describe.category_counts(df).collect()} == {"library": 2, "circulation": 2}
    groups = {r["metric_name"]: r["std_dev"] for r in describe.group_statistics(df, "metric_value", "metric_name").collect()}
    assert groups["single"] is None
    assert describe.describe(df.where("metric_value > 1000"), "metric_value").count() == 0


def test_benchmark(spark):
    df = spark.createDataFrame([("Our Library", 100.0), ("Peer A", 150.0), ("Peer B", 75.0), ("Peer C", None)], "institution string, visits double")
    row = describe.benchmark_summary(df, "institution", "visits", "our library").first()
    assert (row["n"], row["max"]) == (3, 150)
    assert (row["target"]["rank"], row["target"]["metric_value"], row["target"]["percentile"]) == (2, 100, 50.0)
    assert describe.benchmark_summary(df, "institution", "visits", "nobody").first()["target"] is None
    assert [r["institution"] for r in describe.top_performers(df, "institution", "visits", 2).collect()] == ["Peer A", "Our Library"]


def test_benchmark_ties_and_copies(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("a", 1.0), ("c", 2.0)], "i string, v double")
    got = [(r["institution"], r["rank"], r["copies"]) for r in describe.benchmark_ranking(df, "i", "v").orderBy("rank").collect()]
    assert got == [("c", 1, 1), ("a", 2, 2), ("b", 4, 1)]


def test_sentiment_distribution(spark):
    df = spark.createDataFrame([("positive",), ("neutral",), (None,), ("positive",)], "category string")
    row = describe.sentiment_distribution(df).first()
    assert (row["total"], row["processed"], row["skipped"]) == (4, 3, 1)
    assert row["positive"] == pytest.approx(2 / 3) and row["negative"] == 0


def test_chart_sums_drop_missing_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    assert [tuple(r) for r in describe.chart_sums(df, "k", "v").collect()] == [("a", 3)]
    assert [tuple(r) for r in describe.chart_sums(df, "k").collect()] == [("a", 2)]
