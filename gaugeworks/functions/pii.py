"""Personal-data detection and redaction as column expressions and frame operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.constants import PII_PATTERNS
from gaugeworks.functions.text import as_column


def _jvm(pattern: str) -> Column:
    # Unicode classes, so that \b, \d and \s mean the same for accented text as for ASCII.
    return F.lit("(?U)" + pattern)


def _placeholder(kind: str) -> Column:
    return F.lit("[" + kind.upper().replace("\\", "\\\\").replace("$", "\\$") + "]")


def _possible(text: Column, pattern: str) -> Column:
    """A cheap test that every match of a built-in pattern passes; it spares most texts the search.

    What a pattern of the caller needs is not guessed.
    """
    if pattern == PII_PATTERNS["email"]:
        return F.contains(text, F.lit("@"))
    if pattern in (PII_PATTERNS["phone"], PII_PATTERNS["ssn"], PII_PATTERNS["address"]):
        return F.regexp_like(text, F.lit(r"(?U)\d"))
    return F.lit(True)


def detect(text: Column | str, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """map<kind, matches>, holding only kinds that occur."""
    entries = []
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all(as_column(text), _jvm(pattern), F.lit(0))
        entries += [F.lit(kind), F.when(_possible(as_column(text), pattern), found)]
    return F.map_filter(F.create_map(*entries), lambda _, found: F.size(found) > 0)


def kinds(text: Column | str, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Kinds that occur, in pattern order."""
    hits = [F.when(_occurs(as_column(text), p), F.lit(kind)) for kind, p in patterns.items()]
    return F.array_compact(F.array(*hits))


def _occurs(text: Column, pattern: str) -> Column:
    return _possible(text, pattern) & F.regexp_like(text, _jvm(pattern))


def is_clean(text: Column | str, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """True when no pattern occurs; NULL text is clean."""
    dirty = F.lit(False)
    for pattern in patterns.values():
        dirty = dirty | F.coalesce(_occurs(as_column(text), pattern), F.lit(False))
    return ~dirty


def redacted(text: Column | str, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Text with every match replaced by ``[KIND]``, patterns applied in order."""
    out = as_column(text)
    for kind, pattern in patterns.items():
        out = F.regexp_replace(out, _jvm(pattern), _placeholder(kind))
    return out


def redact(
    df: DataFrame, text: str, patterns: Mapping[str, str] = PII_PATTERNS, out: str = "redacted_text"
) -> DataFrame:
    """Adds the redacted text and one ``n_<kind>`` count per pattern.

    Each pattern sees the text left by the patterns before it, so a count is the number
    of replacements made and not the number of matches in the source text.
    """
    df = df.withColumn(out, F.col(text))
    for kind, pattern in patterns.items():
        n = F.when(_possible(F.col(out), pattern), F.regexp_count(F.col(out), _jvm(pattern)))
        df = df.withColumn(f"n_{kind}", F.coalesce(n, F.lit(0)))
        replaced = F.regexp_replace(F.col(out), _jvm(pattern), _placeholder(kind))
        df = df.withColumn(out, F.when(F.col(f"n_{kind}") > 0, replaced).otherwise(F.col(out)))
    return df


def flag(df: DataFrame, text: str, patterns: Mapping[str, str] = PII_PATTERNS) -> DataFrame:
    """Adds ``has_pii`` and ``pii_kinds``; the text stays as it is."""
    df = df.withColumn("pii_kinds", F.coalesce(kinds(text, patterns), F.array().cast("array<string>")))
    return df.withColumn("has_pii", F.size("pii_kinds") > 0)


def redaction_totals(
    df: DataFrame, text: str, patterns: Mapping[str, str] = PII_PATTERNS, by: tuple[str, ...] = ()
) -> DataFrame:
    """Replacements per kind over all texts: one row per (by, kind)."""
    counted = redact(df.select(*by, text), text, patterns)
    wide = counted.groupBy(*by).agg(*[F.sum(f"n_{k}").alias(k) for k in patterns])
    return wide.unpivot(list(by), list(patterns), "kind", "total").withColumn(
        "total", F.coalesce("total", F.lit(0))
    )


def summary(text: Column | str, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Sentence such as ``PII detected: 2 emails, 1 phone``."""
    parts = []
    for kind, pattern in patterns.items():
        n = F.regexp_count(as_column(text), _jvm(pattern))
        label = kind.replace("_", " ")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}"), F.when(n > 1, "s").otherwise(""))))
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit("No PII detected")).otherwise(F.concat(F.lit("PII detected: "), joined))
