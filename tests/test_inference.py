from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.concordance import concordance
from gaugeworks.operators import compare, correlation, findings, shape, trend


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 400
    frame = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n)),
        "x": rng.integers(0, 12, n).astype(float), "y": np.round(rng.normal(size=n), 1), "z": rng.exponential(size=n),
    })
    frame["y"] += frame["x"] * 0.1
    frame.loc[frame["g"] == "a", "z"] += 1.0
    return frame, spark.createDataFrame(frame).cache()


def tau_b(x, y):
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())


def pairs(df):
    return {(r["variable1"], r["variable2"]): r for r in df.collect()}


def test_pearson(numbers):
    frame, df = numbers
    got = pairs(correlation.pearson(df, ["x", "y", "z"]))
    for a, b in combinations(["x", "y", "z"], 2):
        assert got[a, b]["correlation"] == pytest.approx(np.corrcoef(frame[a], frame[b])[0, 1])
        assert got[a, b]["n"] == len(frame)


def test_rank_correlations(numbers):
    frame, df = numbers
    rho = pairs(correlation.spearman(df, ["x", "y"], per_slice=16))["x", "y"]
    assert rho["correlation"] == pytest.approx(np.corrcoef(frame["x"].rank(), frame["y"].rank())[0, 1])
    tau = pairs(correlation.kendall(df, ["x", "y"], per_slice=16))["x", "y"]
    assert tau["correlation"] == pytest.approx(tau_b(frame["x"].to_numpy(), frame["y"].to_numpy()))


def test_kendall_over_levels_of_slices(spark):
    rnd = np.random.default_rng(5)
    x, y = rnd.integers(0, 40, 900).astype(float), rnd.normal(size=900).round(1)
    x[:300], y[200:500], x[0], x[1] = 7.0, -0.5, 0.0, -0.0
    frame = pd.DataFrame({"x": x, "y": y, "g": np.where(rnd.random(900) < 0.8, "hot", None)})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "x double, y double, g string").repartition(5)
    for size in (7, 60, 100_000):
        assert correlation.kendall(df, ["x", "y"], per_slice=size).first()["correlation"] == pytest.approx(tau_b(x, y))
    for r in correlation.kendall(df, ["x", "y"], ["g"], per_slice=9).collect():
        part = frame[frame["g"].isna() if r["g"] is None else frame["g"] == r["g"]]
        assert r["correlation"] == pytest.approx(tau_b(part["x"].to_numpy(), part["y"].to_numpy()))
    assert correlation._levels(df, 7)[0] >= 1


def test_concordance_equals_pairs():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 40, 70):
        x, y, w = rnd.integers(0, 9, n), rnd.integers(0, 11, n), rnd.integers(1, 4, n)
        assert concordance(x, y, w) == sum(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))


def test_kendall_by_group_equals_single_runs(numbers):
    frame, df = numbers
    rows = correlation.kendall(df, ["x", "y"], ["g"], per_slice=16).collect()
    for r in rows:
        part = frame[frame["g"] == r["g"]]
        assert r["correlation"] == pytest.approx(tau_b(part["x"].to_numpy(), part["y"].to_numpy()))


def test_constant_and_short_columns(spark):
    constant = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, b double")
    row = correlation.pearson(constant, ["a", "b"]).first()
    assert row["correlation"] is None and row["status"] == "constant_column"
    assert correlation.pearson(constant.limit(5), ["a", "b"]).first()["status"] == "insufficient_data"
    perfect = constant.withColumn("b", F.col("a") * 2)
    assert correlation.pearson(perfect, ["a", "b"]).first()["p_value"] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        correlation.correlate(constant, ["a"])
    with pytest.raises(ValueError):
        correlation.correlate(constant, ["a", "b"], "other")


def test_matrix_and_top(numbers):
    _, df = numbers
    table = correlation.pearson(df, ["x", "y", "z"])
    cells = {(r["row"], r["column"]): r["correlation"] for r in correlation.matrix(table, ["x", "y", "z"]).collect()}
    assert len(cells) == 9 and cells["x", "x"] == 1.0 and cells["x", "y"] == cells["y", "x"]
    top = correlation.top_correlations(table, 2).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and abs(top[0]["correlation"]) >= abs(top[1]["correlation"])


def series(spark, values):
    rows = [(f"2024-01-{i + 1:02d}" if i < 31 else f"2024-02-{i - 30:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "d string, v double")


def test_trend_line_and_forecast(spark):
    df = series(spark, [10 + 2 * i for i in range(12)])
    row = trend.trend_fit(df, "d", "v").first()
    assert (row["slope"], row["intercept"], row["direction"]) == (pytest.approx(2), pytest.approx(10), "increasing")
    ahead = trend.forecast(df, "d", "v").orderBy("step").collect()
    assert [round(r["forecast"], 6) for r in ahead] == [34 + 2 * i for i in range(7)]
    assert trend.trend_fit(series(spark, [1, 2, 3]), "d", "v").first()["status"] == "insufficient_data"
    flat = trend.trend_fit(series(spark, [5] * 12), "d", "v").first()
    assert flat["direction"] == "stable" and flat["r_squared"] is None


def test_forecast_interval_matches_formula(spark):
    y = np.array([3, 5, 4, 6, 8, 7, 9, 9, 11, 10, 12, 15], float)
    n, x = len(y), np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    s = np.sqrt(np.sum((y - intercept - slope * x) ** 2) / (n - 2))
    t = 2.2281388519649385
    half = t * s * np.sqrt(1 + 1 / n + (n - x.mean()) ** 2 / np.sum((x - x.mean()) ** 2))
    row = trend.forecast(series(spark, y), "d", "v").where("step = 1").first()
    assert row["upper"] - row["forecast"] == pytest.approx(half) and row["forecast"] - row["lower"] == pytest.approx(half)


def test_several_rows_per_date_are_summed(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 2.0), ("bad", 9.0), (None, 1.0)], "d string, v double")
    assert [r["value"] for r in trend.daily_series(df, "d", "v").collect()] == [3.0]


def test_moving_average_waits_for_full_window(spark):
    rows = trend.moving_averages(series(spark, range(10)), "d", "v").orderBy("date").collect()
    assert [r["moving_average_7"] for r in rows[:6]] == [None] * 6 and rows[6]["moving_average_7"] == 3.0
    assert all(r["moving_average_30"] is None for r in rows)


def test_weekly_pattern_is_seasonal(spark):
    weekly = series(spark, [10 if i % 7 == 0 else 0 for i in range(56)])
    assert trend.seasonality(weekly, "d", "v").first()["seasonal_pattern"] is True
    values = np.array([10 if i % 7 == 0 else 0 for i in range(56)], float)
    d = values - values.mean()
    acf = {r["lag"]: r["acf"] for r in trend.autocorrelation(weekly, "d", "v").collect()}
    assert len(acf) == 15 and acf[7] == pytest.approx((d[7:] * d[:-7]).sum() / (d * d).sum())
    assert trend.autocorrelation(series(spark, range(15)), "d", "v").count() == 0


def test_t_test_example(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("b", v) for v in (3.0, 4.0, 5.0, 6.0, 7.0)]
    row = compare.t_test(spark.createDataFrame(rows, "g string, v double"), "v", "g").first()
    assert row["test_statistic"] == pytest.approx(-2.0) and row["p_value"] == pytest.approx(0.0805, abs=1e-4)
    assert row["effect_size"] == pytest.approx(-1.2649, abs=1e-4) and row["effect_size_interpretation"] == "large"


def test_anova_example(spark):
    data = {"a": (6, 8, 4, 5, 3, 4), "b": (8, 12, 9, 11, 6, 8), "c": (13, 9, 11, 8, 7, 12)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    row = compare.anova(df, "v", "g").first()
    assert row["test_statistic"] == pytest.approx(9.2647, abs=1e-4) and row["p_value"] == pytest.approx(0.002399, abs=1e-5)
    post = {(r["group1"], r["group2"]): r for r in compare.anova_pairs(df, "v", "g").collect()}
    assert set(post) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert post["a", "b"]["mean_difference"] == pytest.approx(-4) and post["a", "b"]["bonferroni_alpha"] == pytest.approx(0.05 / 3)
    assert not post["b", "c"]["significant"]


def test_rank_tests_against_direct_counts(numbers):
    frame, df = numbers
    two = df.where(F.col("g").isin("a", "b"))
    row = compare.mann_whitney(two, "y", "g", per_slice=20).first()
    a, b = (frame.loc[frame["g"] == g, "y"].to_numpy() for g in "ab")
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert row["test_statistic"] == pytest.approx(u)
    h = compare.kruskal_wallis(df, "z", "g", per_slice=20).first()
    ranks = frame["z"].rank()
    n = len(frame)
    want = 12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for _, r in ranks.groupby(frame["g"])) - 3 * (n + 1)
    assert h["test_statistic"] == pytest.approx(want) and h["significant"]


def test_post_hoc_ranks_inside_each_pair(numbers):
    frame, df = numbers
    rows = compare.kruskal_pairs(df, "z", "g", per_slice=20).collect()
    assert len(rows) == 6
    for r in rows:
        a, b = (frame.loc[frame["g"] == r[k], "z"].to_numpy() for k in ("group1", "group2"))
        assert r["u_statistic"] == pytest.approx((a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum())


def test_comparison_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, v double")
    assert compare.anova(df, "v", "g").first()["status"] == "insufficient_data"
    many = df.unionByName(df).unionByName(df)
    assert compare.t_test(many, "v", "g").first()["status"] == "needs_two_groups"
    assert compare.compare(many, "v", "g").first()["test_type"] == "anova"
    assert compare.compare(many.where("g <> 'c'"), "v", "g").first()["test_type"] == "t-test"
    assert compare.anova(many.where("g <> 'c'"), "v", "g").first()["status"] == "needs_three_groups"
    with pytest.raises(ValueError):
        compare.compare(df, "v", "g", "z-test")


def test_shape_and_outliers(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100])], "id int, v double")
    row = shape.distribution(df, "v").first()
    x = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100], float)
    d = x - x.mean()
    assert row["skewness"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert row["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert (row["q1"], row["q2"], row["q3"]) == tuple(np.percentile(x, [25, 50, 75]))
    out = shape.iqr_outliers(df, "v", "id").collect()
    assert [r["id"] for r in out] == [9] and out[0]["severity"] == pytest.approx((100 - (7.75 + 1.5 * 4.5)) / 4.5)
    flat = spark.createDataFrame([(i, 5.0) for i in range(11)] + [(11, 6.0)], "id int, v double")
    assert shape.iqr_outliers(flat, "v", "id").first()["severity"] == 0.0
    assert shape.outlier_counts(flat, ["v"]).first()["outliers"] == 0
    assert shape.z_outliers(flat.where("v = 5"), "v", "id").count() == 0
    assert [r["id"] for r in shape.z_outliers(flat, "v", "id").collect()] == [11]


def test_normality_by_size(spark):
    rng = np.random.default_rng(5)
    small = spark.createDataFrame([("n", float(v)) for v in rng.normal(size=300)] + [("e", float(v)) for v in rng.exponential(size=300)], "g string, v double")
    got = {r["g"]: r for r in shape.normality(small, "v", ["g"]).collect()}
    assert got["n"]["is_normal"] and not got["e"]["is_normal"] and got["n"]["test_name"] == "Shapiro-Wilk"
    x = np.sort(np.round(rng.normal(size=6000), 3))
    large = spark.createDataFrame([(float(v),) for v in x], "v double")
    row = shape.normality(large, "v").first()
    from gaugeworks.functions.tails import normal_cdf

    cdf = normal_cdf((x - x.mean()) / x.std(ddof=1))
    i = np.arange(1, len(x) + 1)
    assert row["test_name"] == "Kolmogorov-Smirnov"
    assert row["statistic"] == pytest.approx(max((i / len(x) - cdf).max(), (cdf - (i - 1) / len(x)).max()))
    assert shape.recommend_comparison(small, "v", "g").first()["recommended_test"] == "mann-whitney"


def test_findings(spark):
    pairs_df = spark.createDataFrame([("a", "b", 0.9, True), ("a", "c", -0.8, True), ("b", "c", 0.1, False)], "variable1 string, variable2 string, correlation double, significant boolean")
    trends = spark.createDataFrame([("visits", 1.5, "increasing", True), ("loans", 0.0, "stable", False)], "metric string, slope double, direction string, seasonal_pattern boolean")
    points = findings.data_points(correlations=pairs_df, trends=trends).collect()
    assert len(points) == 5
    text = {r["pattern"] for r in findings.patterns(pairs_df, trends).collect()}
    assert text == {"Strong correlations detected between 2 variable pairs", "Increasing trend detected", "Seasonal pattern detected in time series"}
    assert findings.correlation_priority(pairs_df).first()["priority"] == "medium"
    level = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert level(findings.trend_priority(lit("decreasing"), lit(0.6))) == "high"
    assert level(findings.trend_priority(lit("stable"), lit(0.9))) == "low"
    assert level(findings.comparison_priority(lit(True), lit(0.9))) == "high"
    assert level(findings.comparison_priority(lit(True), lit(None).cast("double"))) == "medium"
    assert level(findings.distribution_priority(lit(6), lit(100))) == "medium"
