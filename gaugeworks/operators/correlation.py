"""Correlation of numeric columns over complete rows, for all pairs and groups in one job."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.concordance import concordance
from gaugeworks.functions.joins import attach, union_all
from gaugeworks.functions.tails import t_p, z_p
from gaugeworks.functions.text import measure
from gaugeworks.operators import ordered

# At most so many times is a grid of slices cut into slices again.
MOST_LEVELS = 4


def _complete(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*by, *[measure(c).alias(c) for c in columns]).dropna(subset=list(columns))


def _finish(pairs: DataFrame, by: Sequence[str], p_value: Column) -> DataFrame:
    enough = F.col("n") >= K.MIN_ROWS_CORRELATION
    table = pairs.withColumn("correlation", F.when(enough, F.nanvl("correlation", F.lit(None).cast("double"))))
    table = table.withColumn("p_value", F.when(enough, p_value))
    return table.select(
        *by, "variable1", "variable2", "n", "correlation", "p_value",
        (F.col("p_value") < K.ALPHA).alias("significant"),
        F.when(~enough, "insufficient_data").when(F.col("correlation").isNull(), "constant_column").otherwise("ok").alias("status"),
    )


def _moments(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """One aggregate over the rows for every pair, then one row per pair."""
    # Written out, because corr fails on a constant column where ANSI arithmetic is on.
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    cells = [F.struct(F.lit(a).alias("variable1"), F.lit(b).alias("variable2"), r(a, b).alias("correlation")) for a, b in pairs]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("_p"))
    return wide.select(*by, "n", F.inline("_p"))


def _student_p() -> Column:
    r = F.greatest(F.least(F.col("correlation"), F.lit(1.0)), F.lit(-1.0))
    rest = 1 - r * r
    t = F.when(rest > 0, r * F.sqrt((F.col("n") - 2) / rest))
    return F.when(rest <= 0, F.lit(0.0)).otherwise(t_p(t, (F.col("n") - 2).cast("double")))


def pearson(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """r and its two-sided p-value for every pair of columns."""
    pairs = list(combinations(columns, 2))
    return _finish(_moments(_complete(df, columns, by), pairs, by), by, _student_p())


def ranked_columns(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE
) -> DataFrame:
    """Complete rows with each value replaced by its average rank within the group."""
    rows = _complete(df, columns, by)
    out = rows
    for column in columns:
        ranks = ordered.average_ranks(rows, column, by, per_slice).select(*by, column, "avg_rank")
        out = attach(out, ranks, [*by, column]).withColumn(column, F.col("avg_rank")).drop("avg_rank")
    return out


def spearman(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE
) -> DataFrame:
    """Pearson correlation of average ranks with the t approximation of its p-value."""
    pairs = list(combinations(columns, 2))
    return _finish(_moments(ranked_columns(df, columns, by, per_slice), pairs, by), by, _student_p())


def _ties(rows: DataFrame, column: str, by: Sequence[str], tag: str) -> DataFrame:
    t = F.col("n").cast("double")
    return ordered.value_counts(rows, column, by).groupBy(*by).agg(
        F.sum(t).alias(f"_n{tag}"),
        F.sum(t * (t - 1)).alias(f"_t2{tag}"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_tv{tag}"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"_t3{tag}"),
    )


def _cut_into_slices(points: DataFrame, axis: str, by: Sequence[str], size: int) -> DataFrame:
    """``points`` with ``<axis>_slice``, which rises with the axis; a slice has about ``size`` points or one value.

    Cut points are those of a hash sample of the points. A value that the sample holds more than once is frequent and becomes a
    slice of its own.
    """
    sample = points.where(F.pmod(F.xxhash64("_x", "_y"), F.lit(size)) == 0).groupBy(*by, axis).agg(F.count(F.lit(1)).alias("_times"))
    own = F.sort_array(F.collect_list(F.when(F.col("_times") > 1, F.col(axis)))).alias("_own")
    cuts = sample.groupBy(*by).agg(F.sort_array(F.collect_list(axis)).alias("_cut"), own)
    tagged = attach(points, ordered.headed(cuts), by, "left")
    alone = F.coalesce(F.array_contains("_own", F.col(axis)), F.lit(False))
    number = 2 * ordered.slot(F.col(axis)) + F.when(alone, 0).otherwise(1)
    return tagged.withColumns({f"{axis}_slice": number, f"{axis}_alone": alone}).drop("_cut", "_own", "_block", "_head")


def _counted(by: Sequence[str], groups: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Concordance of the points of every group of ``keys``, summed by ``by``."""

    def count(table: pa.Table) -> pa.Table:
        columns = [np.asarray(table.column(c)) for c in (x, y, "w")]
        head = table.slice(0, 1).select(list(by))
        return head.append_column("_part", pa.array([concordance(*columns)]))

    kinds = ", ".join(f"`{c}` {t}" for c, t in groups.select(*by).dtypes)
    found = groups.groupBy(*keys).applyInArrow(count, f"{kinds}{', ' if kinds else ''}_part double")
    return found.groupBy(*by).agg(F.sum("_part").alias("_part"))


def _levels(rows: DataFrame, size: int) -> tuple[int, int]:
    """How often points are cut into slices, and of how many points, until the grid of slices is small.

    Taken from the optimizer's estimate of the bytes, so it needs no job; the result does not depend on it.
    """
    points = min(int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 16, 10**13)
    size = max(size, 3 * isqrt(points))
    levels, left = 0, points
    while left > size and levels < MOST_LEVELS:
        levels, left = levels + 1, min(left, (left // size + 1) ** 2)
    return levels, size


def _kendall_pair(rows: DataFrame, a: str, b: str, by: Sequence[str], size: int) -> DataFrame:
    """Concordant minus discordant pairs without forming a pair.

    Points are cut into slices of x and of y. Pairs inside a slice of x are counted there by merging; pairs of two slices of x but
    one of y inside that; all others are the pairs of the coarse grid of slices, whose cells are points again. Frequent values are
    slices of their own, inside which no pair counts along that axis.
    """
    points = rows.groupBy(*by, F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    levels, size = _levels(rows, size)
    parts = []
    for _ in range(levels):
        cut = _cut_into_slices(_cut_into_slices(points, "_x", by, size), "_y", by, size)
        parts.append(_counted(by, cut.where("NOT _x_alone"), "_x", "_y", [*by, "_x_slice"]))
        parts.append(_counted(by, cut.where("NOT _y_alone"), "_x_slice", "_y", [*by, "_y_slice"]))
        points = cut.groupBy(*by, F.col("_x_slice").alias("_x"), F.col("_y_slice").alias("_y")).agg(F.sum("w").alias("w"))
    parts.append(_counted(by, points, "_x", "_y", by) if by else _counted(by, points.withColumn("_all", F.lit(0)), "_x", "_y", ["_all"]))
    score = union_all(parts).groupBy(*by).agg(F.sum("_part").alias("_s"))
    return attach(attach(_ties(rows, a, by, "x"), _ties(rows, b, by, "y"), by), score, by)


def kendall(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), per_slice: int = ordered.PER_SLICE
) -> DataFrame:
    """tau-b with the normal approximation of its p-value."""
    rows = _complete(df, columns, by).withColumns({c: F.col(c) + F.lit(0.0) for c in columns})
    parts = []
    for a, b in combinations(columns, 2):
        part = _kendall_pair(rows, a, b, by, per_slice)
        n = F.col("_nx")
        all_pairs = n * (n - 1)
        tau = F.when(
            (all_pairs > F.col("_t2x")) & (all_pairs > F.col("_t2y")),
            2 * F.col("_s") / F.sqrt((all_pairs - F.col("_t2x")) * (all_pairs - F.col("_t2y"))),
        )
        base = (n * (n - 1) * (2 * n + 5) - F.col("_tvx") - F.col("_tvy")) / 18
        mixed = F.when(n > 1, F.col("_t2x") * F.col("_t2y") / (2 * n * (n - 1)))
        third = F.when(n > 2, F.col("_t3x") * F.col("_t3y") / (9 * n * (n - 1) * (n - 2))).otherwise(0.0)
        variance = base + mixed + third
        part = part.select(
            *by, F.lit(a).alias("variable1"), F.lit(b).alias("variable2"),
            n.cast("long").alias("n"), tau.alias("correlation"),
            F.when(variance > 0, F.col("_s") / F.sqrt(variance)).alias("_zscore"),
        )
        parts.append(part)
    return _finish(union_all(parts), by, z_p(F.col("_zscore")))


_METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlate(df: DataFrame, columns: Sequence[str], method: str = "pearson", by: Sequence[str] = ()) -> DataFrame:
    if method not in _METHODS:
        raise ValueError(f"method must be one of {', '.join(_METHODS)}")
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    return _METHODS[method](df, columns, by)


def matrix(pairs: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Both triangles and the diagonal in long form: by, row, column, correlation, p_value."""
    keep = [*by, "row", "column", "correlation", "p_value"]
    upper = pairs.withColumnsRenamed({"variable1": "row", "variable2": "column"}).select(*keep)
    lower = pairs.withColumnsRenamed({"variable2": "row", "variable1": "column"}).select(*keep)
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    groups = pairs.select(*by).distinct() if by else pairs.agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    diagonal = groups.select(*by, names.alias("row"))
    diagonal = diagonal.select(*by, "row", F.col("row").alias("column"), F.lit(1.0).alias("correlation"), F.lit(0.0).alias("p_value"))
    return union_all([upper, lower, diagonal])


def top_correlations(pairs: DataFrame, k: int = K.TOP_CORRELATIONS, by: Sequence[str] = ()) -> DataFrame:
    """The k strongest pairs by absolute value, per group."""
    order = [F.desc_nulls_last(F.abs("correlation")), F.col("variable1"), F.col("variable2")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def significant_correlations(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("significant"))
