"""Value coercion that yields NULL instead of failing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import as_column, measure

# Accepted date layouts, tried in order.
DATE_LAYOUTS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "dd-MMM-yyyy",
    "yyyy-MM", "yyyy/MM", "MMM yyyy", "MMM-yyyy", "MMMM yyyy", "MMM yy", "MMM-yy",
    "yyyyMMdd",
)


def to_number(value: Column | str) -> Column:
    return measure(value)


def to_timestamp(value: Column | str, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    text = F.trim(as_column(value).cast("string"))
    tries = [text.try_cast("timestamp")]
    tries += [F.try_to_timestamp(text, F.lit(layout)) for layout in layouts]
    return F.coalesce(*tries)


def to_day(value: Column | str, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """Calendar date of a date, timestamp or text value; unparsable text becomes NULL."""
    return to_timestamp(value, layouts).cast("date")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """The frame with ``ts`` as a timestamp; wall-clock times are read in the session's time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName() != "timestamp" else df


def looks_like_period(name: str) -> bool:
    """Whether a column name is a month or a date, as the headings of wide period reports are."""
    import calendar
    import re

    import pandas as pd

    label = name.strip()
    # "Mar 24" and "march-2024" begin with a month, "2024/3" is a year and a month.
    word, number = re.match(r"([^\W\d_]*)[- ]?(.*)", label.lower()).groups()
    months = {m.lower() for m in calendar.month_abbr[1:]}
    if word[:3] in months and word.isascii() and re.fullmatch(r"\d{2,4}", number):
        return True
    if [len(p) if p.isdecimal() else 0 for p in re.split("[-/]", label)] in ([4, 1], [4, 2]):
        return True
    return any(c.isdigit() for c in label) and not pd.isna(pd.to_datetime(label, errors="coerce"))
