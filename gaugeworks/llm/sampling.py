"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def bounded(rows: DataFrame, label: str, id: str, size: int) -> DataFrame:
    """About ``size`` rows of every label (all, if it has fewer), chosen by a hash of the id.

    One count per label decides the share; the same rows are chosen however the table is cut. Rows with
    a null label or id are left out.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
    counts = rows.groupBy(label).count().collect()
    share = F.lit(0)
    for value, count in counts:
        share = F.when(F.col(label) == F.lit(value), F.lit(int(_STEPS * min(1.0, size / count)))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(id), F.lit("sample")), F.lit(_STEPS)) < share)
