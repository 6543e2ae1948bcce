"""Order statistics that no single task has to hold.

Ranks, positions, running totals and exact quantiles all need a global order inside a
group, and a group may hold a third of all rows. A window over the whole group would
sort it in one task, and the built-in exact percentile would keep all of its distinct
values in one map. The distinct values of each group are cut into slices: totals of the
slices below come from a small table, and only the inside of a slice is sorted.

The cut points are the values whose hash falls into one of ``PER_SLICE`` remainders. That is a
function of the data alone, so every evaluation and every retried task sees the same slices,
and a group has as many of them as it has distinct values for; a small one has a single slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.joins import attach

# Distinct values that a slice holds on average.
PER_SLICE = 100_000


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "n") -> DataFrame:
    """Distinct non-null values per group with their row counts."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def _cuts(counts: DataFrame, key: str, by: Sequence[str], sums: Sequence[str], per_slice: int) -> DataFrame:
    """Sorted cut points of each group that has any, and how many of them make a block of the search."""
    # The first test is always true for counts and weights. Reading the sums here keeps this branch's
    # shuffle equal to that of the other branches, so that Spark reuses it.
    chosen = counts.where(F.least(F.lit(0), *[F.col(m) for m in sums]) >= 0).where(F.pmod(F.xxhash64(key), F.lit(per_slice)) == 0)
    return headed(chosen.groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("_cut")))


def headed(cuts: DataFrame) -> DataFrame:
    """Sorted cut points ``_cut`` with the heads of their blocks, for ``slot``."""
    cuts = cuts.withColumn("_block", F.greatest(F.ceil(F.sqrt(F.size("_cut").cast("double"))), F.lit(1)).cast("int"))
    return cuts.withColumn("_head", F.filter("_cut", lambda c, i: i % F.col("_block") == 0))


def slot(key: Column) -> Column:
    """Number of cut points up to the key: first among the heads of blocks, then inside the block."""
    head = F.size(F.filter("_head", lambda c: c <= key))
    block = F.slice("_cut", (head - 1) * F.col("_block") + 1, F.col("_block"))
    inside = F.size(F.filter(block, lambda c: c <= key))
    return F.when(F.col("_cut").isNull() | (head == 0), F.lit(0)).otherwise((head - 1) * F.col("_block") + inside)


def sliced(
    counts: DataFrame, key: str, by: Sequence[str] = (), sums: Sequence[str] = ("n",), per_slice: int = PER_SLICE
) -> DataFrame:
    """Adds ``_slice``: slices follow the order of the key, which is distinct within each group."""
    tagged = attach(counts, _cuts(counts, key, by, sums, per_slice), by, "left")
    return tagged.withColumn("_slice", slot(F.col(key))).drop("_cut", "_head", "_block")


def running_before(
    counts: DataFrame,
    key: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    per_slice: int = PER_SLICE,
) -> DataFrame:
    """Adds ``<m>_before`` and ``<m>_all`` for each summed column m.

    ``<m>_before`` totals m over the smaller keys of the group, ``<m>_all`` over the group.
    Needs one row per (by, key) and sums that are never negative.
    """
    tagged = sliced(counts, key, by, sums, per_slice)
    totals = tagged.groupBy(*by, "_slice").agg(*[F.sum(m).alias(f"_t_{m}") for m in sums])
    lower = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    base = totals.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{m}").over(lower), F.lit(0)).alias(f"_b_{m}") for m in sums],
        *[F.sum(f"_t_{m}").over(whole).alias(f"{m}_all") for m in sums],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_i_{m}") for m in sums])
    joined = attach(local, base, [*by, "_slice"])
    for m in sums:
        joined = joined.withColumn(f"{m}_before", F.col(f"_b_{m}") + F.col(f"_i_{m}"))
    return joined.drop("_slice", *[f"_b_{m}" for m in sums], *[f"_i_{m}" for m in sums])


def average_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), per_slice: int = PER_SLICE
) -> DataFrame:
    """One row per (by, value): n, n_before, n_all and the average rank of the value."""
    ranked = running_before(value_counts(df, value, by), value, ["n"], by, per_slice)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def positions(df: DataFrame, key: str, by: Sequence[str] = (), out: str = "position", per_slice: int = PER_SLICE) -> DataFrame:
    """Adds the 1-based position of each row by a key that is unique within its group."""
    one = df.withColumn("_one", F.lit(1).cast("long") + F.when(F.col(key).isNull(), 0).otherwise(0))
    placed = running_before(one, key, ["_one"], by, per_slice)
    return placed.withColumn(out, F.col("_one_before") + 1).drop("_one", "_one_before", "_one_all")


def placed_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), per_slice: int = PER_SLICE
) -> DataFrame:
    """Distinct values with n, n_before, n_all and the mean of the group.

    Statistics of a group are sums over these rows, so quantiles and central moments come
    from one pass and the moments are taken around the exact mean.
    """
    data = df.select(*by, value).where(F.col(value).isNotNull())
    counts = value_counts(data, value, by)
    placed = running_before(counts, value, ["n"], by, per_slice)
    means = counts.groupBy(*by).agg((F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"))
    return attach(placed, means, by)


def moment(value: str, power: int) -> Column:
    """Sum of the powers of the distances to the group mean, over ``placed_counts`` rows."""
    return F.sum(F.col("n") * F.pow(F.col(value) - F.col("mean"), F.lit(float(power))))


def sample_deviation(value: str) -> Column:
    size = F.max("n_all")
    return F.when(size > 1, F.sqrt(moment(value, 2) / (size - 1)))


def quantile(value: str, p: float) -> Column:
    """Aggregate over ``placed_counts`` rows: the quantile with linear interpolation.

    A value covers the ranks n_before .. n_before + n - 1, counted from 0.
    """
    at = (F.col("n_all") - 1) * F.lit(float(p))
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")
    low = F.max(F.when((F.floor(at) >= first) & (F.floor(at) < last), F.col(value)))
    high = F.max(F.when((F.ceil(at) >= first) & (F.ceil(at) < last), F.col(value)))
    return (low + (high - low) * F.max(at - F.floor(at))).cast("double")


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    per_slice: int = PER_SLICE,
) -> DataFrame:
    """Exact quantiles with linear interpolation: by, and ``q`` as an array in the order of probs."""
    placed = placed_counts(df, value, by, per_slice)
    table = placed.groupBy(*by).agg(F.array(*[quantile(value, p) for p in probs]).alias("q"))
    return table if by else table.where(F.col("q")[0].isNotNull())
