"""Reading delimited and JSON files, cleaning frames and checking them."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks import constants as K


def detect_delimiter(first_lines: Sequence[str]) -> str:
    """Tab when present at least as often as comma; pipe or semicolon when strictly more often."""
    head = "\n".join(first_lines[:5])
    commas = head.count(",")
    if 0 < head.count("\t") >= commas:
        return "\t"
    for mark in ("|", ";"):
        if head.count(mark) > commas:
            return mark
    return ","


def dedupe_names(names: Sequence[str]) -> list[str]:
    """Trimmed names, blanks as ``unnamed``, repeats with ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = str(raw).strip() or "unnamed"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, separator: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A delimited file with a header line.

    Only the first five lines come to the driver. With a schema the file is read once;
    without one Spark passes over it to infer types.
    """
    head = [r["value"] for r in spark.read.text(path).take(5)]
    if separator is None:
        separator = "\t" if path.lower().endswith(".tsv") else detect_delimiter(head)
    reader = spark.read.option("sep", separator).option("header", True).option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if schema is None and head:
        header = next(csv.reader([head[0].lstrip("﻿")], delimiter=separator))
        if len(header) == len(df.columns):
            df = df.toDF(*dedupe_names(header))
    return df


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct fields as top-level columns with dotted names; arrays stay as they are."""

    def leaves(fields, path, label):
        for f in fields:
            here, name = [*path, f"`{f.name}`"], [*label, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here, name)
            else:
                yield F.col(".".join(here)).alias(separator.join(name))

    return df.select(*leaves(df.schema.fields, [], []))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """JSON records: a top-level list gives its items, an object its longest list of records."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.option("multiLine", not lines).json(path)
    if lines:
        return flatten(df)
    filled = spark.read.text(path).where(F.regexp_like("value", F.lit(r"[^\s\ufeff]"))).first()
    first = filled["value"].lstrip("﻿").strip() if filled else ""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if first.startswith("[") or not lists:
        return flatten(df)
    sizes = df.agg(*[F.max(F.size(F.col(f"`{c}`"))).alias(c) for c in lists]).first()
    longest = max(lists, key=lambda c: sizes[c] if sizes[c] is not None else -1)
    return flatten(df.select(F.inline(F.col(f"`{longest}`")))) if isinstance(
        df.schema[longest].dataType.elementType, T.StructType
    ) else df.select(F.explode(F.col(f"`{longest}`")).alias("value"))


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By extension: csv, tsv, txt or json."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "json":
        return read_json(spark, path, schema)
    if kind in ("csv", "tsv", "txt"):
        return read_delimited(spark, path, schema)
    raise ValueError(f"unsupported file type '.{kind}'; supported: csv, tsv, txt, json")


def clean(df: DataFrame) -> DataFrame:
    """Clean names, then drop rows and columns without any value, with one aggregate over all columns."""
    df = df.toDF(*dedupe_names(df.columns))
    quoted = [f"`{c}`" for c in df.columns]
    df = df.where(F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in quoted]))
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(quoted)]).first()
    return df.select(*[F.col(c) for i, c in enumerate(quoted) if counts[i] > 0])


def validate(df: DataFrame, dataset_type: str, strict: bool = True) -> DataFrame:
    """(rule, column, message) rows; no row means the file is fine."""
    found: list[tuple[str, str | None, str]] = []
    names = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    counts = renamed.agg(F.count(F.lit(1)).alias("n"), *[F.count(c) for c in renamed.columns]).first()
    repeated = sorted({c for c in names if names.count(c) > 1})
    if counts[0] == 0:
        found.append(("empty_frame", None, "the file holds no rows"))
    found += [("duplicate_column", c, "each column needs a unique name") for c in repeated]
    if counts[0]:
        found += [("empty_column", c, "the column holds no value") for c, n in zip(names, counts[1:]) if n == 0]
    if strict:
        required = K.REQUIRED_COLUMNS.get(dataset_type, ())
        found += [("missing_column", c, f"expected columns: {', '.join(required)}") for c in required if c not in names]
    return df.sparkSession.createDataFrame(found, "rule string, column string, message string")


def ingest(spark: SparkSession, path: str, filename: str | None = None, schema: T.StructType | None = None):
    """Reads, cleans, detects the type and normalises: (frame, dataset type)."""
    from gaugeworks.operators.describe import numeric_columns
    from gaugeworks.operators.normalize import detect_type, normalize

    df = clean(read_file(spark, path, schema))
    kind = detect_type(df.columns, filename or path.rsplit("/", 1)[-1], bool(numeric_columns(df)))
    return normalize(df, kind), kind


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_hash) of every file below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def duplicates(df: DataFrame, hash_column: str, key: str) -> DataFrame:
    """Hashes held by more than one row, with the smallest key and the number of copies."""
    groups = df.groupBy(hash_column).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias(f"first_{key}"))
    return groups.where(F.col("copies") > 1)
