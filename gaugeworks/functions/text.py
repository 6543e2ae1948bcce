"""Scalar text expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalized_key(text: Column | str) -> Column:
    """Lower-cased text with edges trimmed and inner whitespace collapsed; NULL becomes ''."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(as_column(text).cast("string"), F.lit(""))), r"(?U)\s+", " ")
    return F.trim(squeezed)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains one of the words as a substring."""
    hits = [text.contains(word) for word in words]
    result = hits[0]
    for hit in hits[1:]:
        result = result | hit
    return result


def first_rule(text: Column, rules: Iterable[tuple[str, Iterable[str]]], default: str | None) -> Column:
    """Label of the first (label, words) rule with a substring hit."""
    label = None
    for name, words in rules:
        hit = contains_any(text, words)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return label.otherwise(F.lit(default))


def token_estimate(text: Column | str) -> Column:
    """Rough token count: one per four characters, rounded down."""
    return F.floor(F.char_length(as_column(text)) / 4)


def words(text: Column | str, min_length: int = 1) -> Column:
    """Lower-cased word tokens of the text."""
    return F.regexp_extract_all(
        F.lower(as_column(text)), F.lit(r"(?U)\b\w{%d,}\b" % min_length), F.lit(0)
    )


def measure(value: Column | str) -> Column:
    """Value as double with NaN taken as missing and anything unparsable as NULL."""
    return F.nanvl(as_column(value).try_cast("double"), F.lit(None).cast("double"))


def filled(template: str, *values: Column | str) -> Column:
    """A fixed sentence with its ``{}`` replaced by values; plain strings are taken as they are."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit(rest)]
    return F.concat(*out)
