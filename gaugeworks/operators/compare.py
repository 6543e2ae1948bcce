"""Group comparisons: t-test, Mann-Whitney, ANOVA, Kruskal-Wallis and their post-hoc pairs.

Everything is computed from one row per group (moment tests) or one row per distinct value
and group (rank tests). Groups are taken in ascending order of their label, which fixes the
sign of differences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import attach
from gaugeworks.functions.tails import chi2_p, f_p, t_p, z_p
from gaugeworks.functions.text import measure
from gaugeworks.operators import ordered
from gaugeworks.session import ensure_checkpoint_dir

TESTS = ("t-test", "mann-whitney", "anova", "kruskal-wallis")


def _rows(df: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    data = df.select(*by, F.col(group).cast("string").alias("group"), measure(value).alias("_v"))
    return data.where(F.col("group").isNotNull() & F.col("_v").isNotNull())


def _groups(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "group").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("var")
    )


def effect_label(d: Column) -> Column:
    """negligible, small, medium or large by the absolute effect size; undefined when missing."""
    size = F.abs(d)
    return (
        F.when(d.isNull(), "undefined").when(size < 0.2, "negligible").when(size < 0.5, "small")
        .when(size < 0.8, "medium").otherwise("large")
    )


def _pair_columns(df: DataFrame) -> DataFrame:
    """t statistic, degrees of freedom and Cohen's d from n1, mean1, var1, n2, mean2, var2."""
    n1, n2 = F.col("n1"), F.col("n2")
    dof = (n1 + n2 - 2).cast("double")
    part = lambda n, var: F.when(n > 1, (n - 1) * var).otherwise(0.0)
    pooled = F.sqrt((part(n1, F.col("var1")) + part(n2, F.col("var2"))) / F.when(dof > 0, dof))
    diff = F.col("mean1") - F.col("mean2")
    return (
        df.withColumn("_dof", dof)
        .withColumn("_sp", pooled)
        .withColumn("mean_difference", diff)
        .withColumn("t_statistic", F.when(F.col("_sp") > 0, diff / (F.col("_sp") * F.sqrt(1 / n1 + 1 / n2))))
        .withColumn("effect_size", F.when(F.col("_sp") > 0, diff / F.col("_sp")))
    )


def _status(test: str) -> Column:
    two = test in ("t-test", "mann-whitney")
    wrong = F.col("n_groups") != 2 if two else F.col("n_groups") < 3
    return (
        F.when(F.col("n_observations") < K.MIN_ROWS_COMPARISON, "insufficient_data")
        .when(F.col("n_groups") < 2, "insufficient_groups")
        .when(wrong, "needs_two_groups" if two else "needs_three_groups")
        .otherwise("ok")
    )


def _result(table: DataFrame, by: Sequence[str], test: str) -> DataFrame:
    """Common result shape; a test that does not apply keeps its row with a status."""
    ok = F.col("status") == "ok"
    if "effect_size" not in table.columns:
        table = table.withColumn("effect_size", F.lit(None).cast("double"))
    label = effect_label(F.col("effect_size")) if test == "t-test" else F.lit(None).cast("string")
    return table.select(
        *by, F.lit(test).alias("test_type"), "n_groups", "n_observations",
        F.when(ok, F.col("test_statistic")).alias("test_statistic"),
        F.when(ok, F.col("p_value")).alias("p_value"),
        F.when(ok, F.col("p_value") < K.ALPHA).alias("significant"),
        F.when(ok, F.col("effect_size")).alias("effect_size"),
        F.when(ok, label).alias("effect_size_interpretation"),
        "status",
    )


def t_test(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Pooled two-sample t-test with Cohen's d."""
    groups = _groups(_rows(df, value, group, by), by)
    stats = F.struct("n", "mean", "var")
    pair = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_observations"),
        F.min_by(stats, "group").alias("_a"), F.max_by(stats, "group").alias("_b"),
    )
    pair = pair.select(
        *by, "n_groups", "n_observations",
        *[F.col(f"_{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("n", "mean", "var")],
    )
    table = _pair_columns(pair).withColumn("test_statistic", F.col("t_statistic")).withColumn("status", _status("t-test"))
    return _result(table.withColumn("p_value", t_p(F.col("t_statistic"), F.col("_dof"))), by, "t-test")


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance."""
    return _anova(_groups(_rows(df, value, group, by), by), by)


def _anova(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = groups.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"))
    deviation = F.col("n") * (F.col("mean") - F.col("_m")) ** 2
    within = F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)
    table = attach(groups, totals, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_observations"),
        F.sum(deviation).alias("_ssb"), F.sum(within).alias("_ssw"),
    )
    if not by:
        table = table.where(F.col("n_groups") > 0)
    d1 = (F.col("n_groups") - 1).cast("double")
    d2 = (F.col("n_observations") - F.col("n_groups")).cast("double")
    f = F.when((d1 > 0) & (d2 > 0) & (F.col("_ssw") > 0), (F.col("_ssb") / d1) / (F.col("_ssw") / d2))
    table = table.withColumn("test_statistic", f).withColumn("status", _status("anova"))
    return _result(table.withColumn("p_value", f_p(F.col("test_statistic"), d1, d2)), by, "anova")


def _label_pairs(groups: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per pair of group labels g1 < g2; pairing labels is the operator's result."""
    left = groups.select(*by, F.lit(1).alias("_on"), F.col("group").alias("group1"), *[F.col(c).alias(f"{c}1") for c in columns])
    right = groups.select(
        *[F.col(b).alias(f"_r_{b}") for b in by], F.lit(1).alias("_on2"),
        F.col("group").alias("group2"), *[F.col(c).alias(f"{c}2") for c in columns],
    )
    same = F.col("_on") == F.col("_on2")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    return left.join(right, same & (F.col("group1") < F.col("group2"))).drop("_on", "_on2", *[f"_r_{b}" for b in by])


def _bonferroni(table: DataFrame) -> DataFrame:
    k = F.col("n_groups")
    alpha = K.ALPHA / (k * (k - 1) / 2)
    return table.withColumn("bonferroni_alpha", alpha).withColumn("significant", F.col("p_value") < alpha)


def anova_pairs(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairwise t-tests with Bonferroni correction, for the analyses that ANOVA finds significant."""
    groups = _groups(_rows(df, value, group, by), by)
    found = _anova(groups, by).where(F.col("significant")).select(*by, "n_groups")
    pairs = attach(_pair_columns(_label_pairs(groups, by, ("n", "mean", "var"))), found, by)
    pairs = _bonferroni(pairs.withColumn("p_value", t_p(F.col("t_statistic"), F.col("_dof"))))
    return pairs.select(
        *by, "group1", "group2", "mean_difference", "t_statistic", "p_value", "significant",
        "bonferroni_alpha", "effect_size",
    )


def _cells(df: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    """Rows per (by, group, value)."""
    return _rows(df, value, group, by).groupBy(*by, "group", "_v").agg(F.count(F.lit(1)).alias("n"))


def _rank_sums(cells: DataFrame, by: Sequence[str], per_slice: int) -> tuple[DataFrame, DataFrame]:
    """Rank sum and size per group, and the tie term and size per analysis."""
    values = cells.groupBy(*by, "_v").agg(F.sum("n").alias("t"))
    placed = ordered.running_before(values, "_v", ["t"], by, per_slice)
    ranks = placed.select(*by, "_v", (F.col("t_before") + (F.col("t") + 1) / 2.0).alias("_rank"))
    sums = attach(cells, ranks, [*by, "_v"]).groupBy(*by, "group").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_rank")).alias("r")
    )
    t = F.col("t").cast("double")
    ties = placed.groupBy(*by).agg(F.sum(t * t * t - t).alias("_ties"))
    return sums, ties


def _mann_whitney_columns(df: DataFrame) -> DataFrame:
    """U of the first group and the z score of the larger U, with tie and continuity correction."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    largest = F.greatest(u1, n1 * n2 - u1)
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.when(sigma > 0, (largest - n1 * n2 / 2 - 0.5) / sigma)
    return df.withColumn("u_statistic", u1).withColumn("_z", F.greatest(z, F.lit(0.0)))


def mann_whitney(df: DataFrame, value: str, group: str, by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE) -> DataFrame:
    """Two-sided rank-sum test, always with the normal approximation; reports U of the first group."""
    sums, ties = _rank_sums(_cells(df, value, group, by), by, per_slice)
    stats = F.struct("n", "r")
    pair = sums.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_observations"),
        F.min_by(stats, "group").alias("_a"), F.max_by(stats, "group").alias("_b"),
    )
    pair = pair.select(
        *by, "n_groups", "n_observations", F.col("_a.n").alias("n1"), F.col("_a.r").alias("r1"),
        F.col("_b.n").alias("n2"), F.col("_b.r").alias("r2"),
    )
    table = _mann_whitney_columns(attach(pair, ties, by)).withColumn("test_statistic", F.col("u_statistic"))
    table = table.withColumn("status", _status("mann-whitney"))
    return _result(table.withColumn("p_value", z_p(F.col("_z"))), by, "mann-whitney")


def kruskal_wallis(df: DataFrame, value: str, group: str, by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE) -> DataFrame:
    """Rank-based analysis of variance, corrected for ties."""
    return _kruskal(*_rank_sums(_cells(df, value, group, by), by, per_slice), by)


def _kruskal(sums: DataFrame, ties: DataFrame, by: Sequence[str]) -> DataFrame:
    table = sums.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_observations"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_rr"),
    )
    n = F.col("n_observations").cast("double")
    correction = 1 - F.try_divide(F.col("_ties"), n * n * n - n)
    h = F.when(correction > 0, (12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)) / correction)
    table = attach(table, ties, by).withColumn("test_statistic", h).withColumn("status", _status("kruskal-wallis"))
    table = table.withColumn("p_value", chi2_p(F.col("test_statistic"), (F.col("n_groups") - 1).cast("double")))
    return _result(table, by, "kruskal-wallis")


def kruskal_pairs(df: DataFrame, value: str, group: str, by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE) -> DataFrame:
    """Pairwise Mann-Whitney tests with Bonferroni correction, for analyses Kruskal-Wallis finds significant.

    Ranks are taken anew inside each pair, over distinct values rather than rows.
    """
    cells = _cells(df, value, group, by)
    sums, ties = _rank_sums(cells, by, per_slice)
    found = _kruskal(sums, ties, by).where(F.col("significant")).select(*by, "n_groups")
    pairs = attach(_label_pairs(sums, by, ("n",)), found, by).select(*by, "group1", "group2", "n_groups")
    # A few rows that close the first pass over the data; without the cut every branch below
    # would run that pass again.
    ensure_checkpoint_dir(df.sparkSession)
    pairs = pairs.checkpoint()
    found = pairs.select(*by, "n_groups").distinct()
    sides = pairs.withColumn("group", F.explode(F.array("group1", "group2"))).drop("n_groups")
    both = attach(sides, cells, [*by, "group"])
    keys = [*by, "group1", "group2"]
    pair_sums, pair_ties = _rank_sums(both, keys, per_slice)
    first = F.col("group") == F.col("group1")
    wide = pair_sums.groupBy(*keys).agg(
        F.sum(F.when(first, F.col("n"))).alias("n1"), F.sum(F.when(first, F.col("r"))).alias("r1"),
        F.sum(F.when(~first, F.col("n"))).alias("n2"),
    )
    table = _mann_whitney_columns(attach(attach(wide, pair_ties, keys), found, by))
    table = _bonferroni(table.withColumn("p_value", z_p(F.col("_z"))))
    return table.select(*keys, "u_statistic", "p_value", "significant", "bonferroni_alpha")


_RUN = {"t-test": t_test, "mann-whitney": mann_whitney, "anova": anova, "kruskal-wallis": kruskal_wallis}


def compare(df: DataFrame, value: str, group: str, test: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The named test, or per analysis the t-test for two groups and ANOVA for more."""
    if test is not None:
        if test not in TESTS:
            raise ValueError(f"test must be one of {', '.join(TESTS)}")
        return _RUN[test](df, value, group, by)
    two = t_test(df, value, group, by).where(F.col("n_groups") <= 2)
    more = anova(df, value, group, by).where(F.col("n_groups") > 2)
    return two.unionByName(more)
