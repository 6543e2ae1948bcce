"""Comparison of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = T.NumericType


def _differs(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType, tolerance: float) -> Column:
    """Numbers within the tolerance are equal, text compares as number against a number, NULL equals ''."""
    l_num, r_num = isinstance(left_type, NUMERIC), isinstance(right_type, NUMERIC)
    if l_num or r_num:
        a = F.nanvl(left.try_cast("double"), F.lit(None).cast("double"))
        b = F.nanvl(right.try_cast("double"), F.lit(None).cast("double"))
        near = F.abs(a - b) <= tolerance
        same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near | (a == b))
        return ~same
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return blank(left) != blank(right)


def _plain(column: Column, own: T.DataType, other: T.DataType) -> Column:
    """A value such that values which compare as equal without a tolerance are the same."""
    if isinstance(own, NUMERIC) or isinstance(other, NUMERIC):
        return F.nanvl(column.try_cast("double"), F.lit(None).cast("double")) + F.lit(0.0)
    return F.coalesce(column.cast("string"), F.lit(""))


def _checksums(rows: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int, tag: str) -> DataFrame:
    """Per bucket of keys: number of rows, and sum and exclusive or of their hashes."""
    values = [_plain(F.col(c), rows.schema[c].dataType, other.schema[c].dataType) for c in columns]
    # A hash skips nulls, so they are told by a flag each.
    sign = F.xxhash64(*[F.col(k).cast("string") for k in keys], *values, *[v.isNull() for v in values])
    hashed = rows.select(_bucket(keys, buckets).alias("_b"), sign.alias("_h"))
    return hashed.groupBy("_b").agg(
        F.count(F.lit(1)).alias(f"{tag}n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias(f"{tag}s"), F.bit_xor("_h").alias(f"{tag}x"),
    )


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets))


def differing_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """Numbers of the key buckets whose rows are not the same on both sides; only sums meet, not rows."""
    a, b = _checksums(left, right, keys, columns, buckets, "l"), _checksums(right, left, keys, columns, buckets, "r")
    same = F.lit(True)
    for part in "nsx":
        same = same & F.col(f"l{part}").eqNullSafe(F.col(f"r{part}"))
    return a.join(b, "_b", "full").where(~same).select("_b")


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-9, buckets: int | None = None) -> DataFrame:
    """(keys, kind, column, left_value, right_value): rows on one side only, changed values, and columns on one side only.

    Columns are matched by name; one that only a side has is a row with null keys. Keys must be unique on each side. With
    ``buckets``, sums of hashes are compared by key bucket first, and only the rows of buckets that differ are joined: two large tables
    that hardly differ are scanned twice and hardly shuffled.
    """
    columns = [c for c in left.columns if c in set(right.columns) and c not in keys]
    whole = (left, right)
    if buckets:
        # At most one row a bucket.
        odd = F.broadcast(differing_buckets(left, right, keys, columns, buckets))
        left, right = (side.withColumn("_b", _bucket(keys, buckets)).join(odd, "_b", "left_semi").drop("_b") for side in whole)
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in columns])
    b = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = a.join(b, condition, "full_outer")
    key_columns = [F.when(F.col("_l"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys]

    def entry(kind, column=None, l=None, r=None):
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column"),
            text(l).alias("left_value"), text(r).alias("right_value"),
        )

    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    found = [F.when(F.col("_r").isNull(), entry("left_only")), F.when(F.col("_l").isNull(), entry("right_only"))]
    for c in columns:
        l, r = F.col(f"l_{c}"), F.col(f"r_{c}")
        changed = _differs(l, r, left.schema[c].dataType, right.schema[c].dataType, tolerance)
        found.append(F.when(both & changed, entry("changed", c, l, r)))
    rows = joined.select(*key_columns, F.inline(F.array_compact(F.array(*found))))
    alone = [("left_column", c) for c in whole[0].columns if c not in whole[1].columns] + [("right_column", c) for c in whole[1].columns if c not in whole[0].columns]
    if not alone:
        return rows
    fields = rows.schema.fields
    told = rows.sparkSession.createDataFrame(alone, "kind string, column string")
    return rows.unionByName(told.select(*[(F.col(f.name) if f.name in told.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]))


def tables_equivalent(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), tolerance: float = 1e-9) -> bool:
    """Same columns in any order, same number of rows and no differing value.

    Without keys the rows are compared as multisets, with numbers rounded to the tolerance.
    """
    if sorted(left.columns) != sorted(right.columns) or left.count() != right.count():
        return False
    if keys:
        return table_diff(left, right, keys, tolerance).isEmpty()
    digits = max(0, len(f"{1 / tolerance:.0f}") - 1) if tolerance > 0 else 15

    def plain(df: DataFrame, other: DataFrame) -> DataFrame:
        out = []
        for c in sorted(df.columns):
            column, name = F.col(f"`{c}`"), c
            if isinstance(df.schema[c].dataType, NUMERIC) or isinstance(other.schema[c].dataType, NUMERIC):
                column = F.round(F.nanvl(column.try_cast("double"), F.lit(None).cast("double")), digits)
            else:
                column = F.coalesce(column.cast("string"), F.lit(""))
            out.append(column.alias(name))
        return df.select(*out)

    a, b = plain(left, right), plain(right, left)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def round_trips(df: DataFrame, path: str, tolerance: float = 1e-9) -> bool:
    """Writes the frame as CSV, reads it back with its schema and compares the two."""
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(quoteAll=True, **exact).csv(path)
    back = df.sparkSession.read.schema(df.schema).options(multiLine=True, **exact).csv(path)
    return tables_equivalent(df, back, tolerance=tolerance)
