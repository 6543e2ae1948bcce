"""Cells of one table or of a whole registry of tables with different schemas.

A registry keeps its rows as VARIANT objects beside the dataset's id, so tables of any schema are one frame. ``variant_explode``
turns each row into its cells once, and every fact of a column is an aggregate by (dataset, column). Names and
types of the columns are metadata: the driver has them from the schemas, one entry per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.joins import union_all


def friendly_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "text"


def as_text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column).cast("string")
    return column.cast("string")


@dataclass
class Cells:
    """``columns``: by, position, column, type, is_string; ``values``: by, position, ``_v`` (text, null if missing);
    ``names`` are the entries of ``columns``, which the driver made from schemas."""

    columns: DataFrame
    values: DataFrame
    names: Sequence[tuple]
    by: tuple[str, ...] = ()

    def is_named(self, hints: Sequence[str]) -> Column:
        """Whether a cell is of a column with one of the hints in its name."""
        at = len(self.by)
        found = [n[: at + 1] for n in self.names if any(h in n[at + 1].lower() for h in hints)]
        if not at:
            return F.col("position").isin([p for (p,) in found])
        key = F.concat_ws(" ", *self.by, "position")
        return key.isin([" ".join(map(str, k)) for k in found])


def _named(session: SparkSession, entries: Sequence[tuple], by: str = "") -> DataFrame:
    return session.createDataFrame(list(entries), f"{by}position int, column string, type string, is_string boolean")


def _entries(schema: T.StructType) -> list[tuple]:
    return [(i, f.name, friendly_type(f.dataType), isinstance(f.dataType, T.StringType)) for i, f in enumerate(schema.fields)]


def cells_of(table: DataFrame | Cells) -> Cells:
    """The cells of one table."""
    if isinstance(table, Cells):
        return table
    names = table.columns
    plain = table.select(*[as_text(f).alias(f"c{i}") for i, f in enumerate(table.schema.fields)])
    long = plain.unpivot([], [f"c{i}" for i in range(len(names))], "_c", "_v")
    entries = _entries(table.schema)
    return Cells(_named(table.sparkSession, entries), long.select(F.substring("_c", 2, 10).cast("int").alias("position"), "_v"), entries)


def variant_rows(table: DataFrame, dataset_id: int) -> DataFrame:
    """``dataset_id`` and ``row``, a VARIANT object with the positions of the columns as keys. A value may have up to 128 MB, Spark's limit of a VARIANT."""
    cells = [F.col(f"`{f.name}`") for f in table.schema.fields]
    cells = [F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c for c, f in zip(cells, table.schema.fields, strict=True)]
    # Numbers keep their type; nested and other values are kept as the text that profiles show.
    typed = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.StringType)
    cells = [c if isinstance(f.dataType, typed) else as_text(f) for c, f in zip(cells, table.schema.fields, strict=True)]
    return table.select(F.lit(dataset_id).cast("long").alias("dataset_id"), F.to_variant_object(F.struct(*[c.alias(str(i)) for i, c in enumerate(cells)])).alias("row"))


@dataclass
class Registry:
    """Registered tables: ``datasets`` (dataset_id, name, dataset_type), ``columns`` and VARIANT ``rows``."""

    datasets: DataFrame
    columns: DataFrame
    rows: DataFrame
    names: Sequence[tuple]

    def cells(self) -> Cells:
        """All cells, by dataset; each row is exploded once."""
        exploded = self.rows.lateralJoin(self.rows.sparkSession.tvf.variant_explode(F.col("row").outer()))
        values = exploded.select("dataset_id", F.col("key").cast("int").alias("position"), F.expr("try_variant_get(value, '$', 'string')").alias("_v"))
        return Cells(self.columns, values, self.names, ("dataset_id",))


def registry(tables: Sequence[tuple[DataFrame, int, str, str]]) -> Registry:
    """A registry of (table, dataset id, name, dataset type)."""
    session = tables[0][0].sparkSession
    datasets = session.createDataFrame([(int(i), name, kind) for _, i, name, kind in tables], "dataset_id long, name string, dataset_type string")
    entries = [(int(i), *entry) for table, i, _, _ in tables for entry in _entries(table.schema)]
    return Registry(datasets, _named(session, entries, "dataset_id long, "), union_all([variant_rows(table, i) for table, i, _, _ in tables]), entries)
