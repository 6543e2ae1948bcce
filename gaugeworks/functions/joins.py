"""Joins of rows with per-group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Adds the table's columns to the rows with equal keys; NULL keys match each other.

    The table holds one row per key. Without keys it is a single row, the only case in
    which a broadcast is asked for; otherwise Spark chooses by the sizes it measures.
    """
    if not keys:
        if how == "left":
            return rows.join(F.broadcast(table), F.lit(True), "left")
        return rows.crossJoin(F.broadcast(table))
    renamed = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = None
    for key in keys:
        same = rows[key].eqNullSafe(renamed[f"_k_{key}"])
        condition = same if condition is None else condition & same
    return rows.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
