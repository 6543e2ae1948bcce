"""Operation keys and idempotent appends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import as_column, normalized_key


def _plain(value: Any) -> str:
    """A part as text: words of a text in lower case between single spaces, containers with their items' lengths."""
    if isinstance(value, dict):
        return "{" + _framed(sorted(_framed([str(k), _plain(v)]) for k, v in value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + _framed(_plain(v) for v in value) + "]"
    if isinstance(value, (set, frozenset)):
        return "<" + _framed(sorted(_plain(v) for v in value)) + ">"
    return " ".join(str(value).lower().split())


def _framed(parts: Iterable[str]) -> str:
    """Each part behind its length, so that no two lists of parts read alike."""
    return "".join(f"{len(p)}:{p}" for p in parts)


def operation_key(operation: str, *parts: Any) -> str:
    """``operation:<sha-256>`` of the framed parts; the order of dict keys and spacing do not matter."""
    return f"{operation}:{hashlib.sha256(_framed([operation, *map(_plain, parts)]).encode()).hexdigest()}"


def operation_key_column(operation: str, *parts: Column | str) -> Column:
    """The same key for text columns, computed row by row in the JVM; a NULL part reads "none"."""
    framed = [F.lit(_framed([operation]))]
    for part in parts:
        text = F.when(as_column(part).isNull(), F.lit("none")).otherwise(normalized_key(part))
        framed += [F.char_length(text).cast("string"), F.lit(":"), text]
    return F.concat(F.lit(f"{operation}:"), F.sha2(F.concat(*framed), 256))


def key_to_id(key: str) -> int:
    """A positive id that follows from the key, so a repeated operation finds the same id."""
    return int(key.rsplit(":", 1)[1][:15], 16)


def key_to_id_column(key: Column) -> Column:
    return F.conv(F.substring(F.substring_index(key, ":", -1), 1, 15), 16, 10).cast("long")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order; copies are removed before any join."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") == 1).drop("_r")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, each key once."""
    return first_by_key(incoming, keys, order).join(existing.select(*keys), list(keys), "left_anti")
