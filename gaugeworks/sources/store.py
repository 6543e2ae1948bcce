"""Dataset registry and canonical tables as Parquet folders.

Facts, themes and passages are partitioned by ``dataset_id``: reading one dataset prunes to its folder, repeating a
failed load overwrites the same folder, and deleting a dataset drops its folders. The registry, provenance and
analyses have few rows a dataset, so they lie in ``BUCKETS`` folders by a remainder of the id. Changing datasets
rewrites their buckets and no others.

Many datasets are loaded at once: one anti-join with the registry, one write per table, whatever their number.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import union_all
from gaugeworks.operators.normalize import canonical_rows
from gaugeworks.session import scratch_path
from gaugeworks.sources.ledger import key_to_id, key_to_id_column, operation_key, operation_key_column

SCHEMAS = {
    "datasets": (
        "name string, dataset_type string, upload_date timestamp, row_count long, column_names array<string>, "
        "file_hash string, title string, description string, source string, keywords array<string>, "
        "usage_notes string, ethical_considerations string, indexing_status string, indexed_at timestamp, "
        "indexing_error string, dataset_id long"
    ),
    "survey_responses": (
        "id long, response_date date, question string, response_text string, sentiment string, "
        "sentiment_score double, themes string, dataset_id long"
    ),
    "usage_statistics": "id long, date date, metric_name string, metric_value double, category string, dataset_id long",
    "themes": (
        "theme_id int, theme_name string, keywords array<string>, frequency long, "
        "representative_quotes array<string>, dataset_id long"
    ),
    "passages": (
        "passage_id string, text string, dataset_type string, source_row_id string, date string, "
        "question string, metric_name string, embedding array<float>, dataset_id long"
    ),
    "provenance_events": "kind string, ts timestamp, operation string, method string, username string, detail string, dataset_id long",
    "analyses": (
        "analysis_id long, analysis_type string, parameters string, statistical_results string, "
        "interpretation string, insights string, recommendations string, ts timestamp, dataset_id long"
    ),
    "ledger": "operation string, idempotency_key string, status string, result_json string, error string, ts timestamp",
}
_BUCKETED = ("datasets", "provenance_events", "analyses")
_PARTITIONED = tuple(name for name in SCHEMAS if name != "ledger" and name not in _BUCKETED)
BUCKETS = 64
# Equal rows that are numbered by one row, at most.
COPIES = 4096
ENTRY = "name string, dataset_type string, file_hash string, column_names array<string>, title string, description string, source string, keywords array<string>, usage_notes string, ethical_considerations string"


def dataset_key(name: str | Column = "name", dataset_type: str | Column = "dataset_type", file_hash: str | Column = "file_hash") -> Column:
    """The operation key that tells datasets apart."""
    return operation_key_column("store_dataset", file_hash, name, dataset_type)


def with_row_ids(rows: DataFrame, by: str = "dataset_id", out: str = "id") -> DataFrame:
    """Rows with an id that follows from their values and, for equal rows, the number of the copy.

    The same rows get the same ids in any order and partitioning. Equal rows are counted first, so a hot row is
    one row per task in the shuffle. Ids are 63 bits of a hash: of 10^8 rows of a dataset about one in a thousand such
    datasets holds a pair with equal ids.
    """
    columns = [f"`{c}`" for c in rows.columns if c != out]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = counted.where(F.col("_n") > COPIES).withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {COPIES}L)")))
    many = many.repartition(by, "_from").withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, "_n") - 1)))
    content = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    key = F.shiftrightunsigned(F.xxhash64(*content, F.col("_copy")), 1)
    return few.union(many.drop("_from")).withColumn(out, key).drop("_n", "_copy")


def _now(as_of: datetime | None) -> datetime:
    return as_of or datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class Load:
    """A table to be stored as a dataset."""

    rows: DataFrame
    name: str
    dataset_type: str
    file_hash: str
    metadata: Mapping[str, Any] = field(default_factory=dict)


class Store:
    """Canonical tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs_path(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _exists(self, path: str) -> bool:
        fs, p = self._fs_path(path)
        return fs.exists(p)

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        """The frame in the table's columns; missing columns become NULL."""
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _folders(self, name: str, df: DataFrame) -> tuple[DataFrame, str | None]:
        """The frame in the table's columns, with the column that its folders go by."""
        shaped = self.shaped(name, df)
        if name in _BUCKETED:
            return shaped.withColumn("bucket", F.pmod("dataset_id", F.lit(BUCKETS)).cast("int")), "bucket"
        return shaped, "dataset_id" if name in _PARTITIONED else None

    def table(self, name: str) -> DataFrame:
        if not self._exists(self._path(name)):
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name not in _BUCKETED:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name))
        return self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(self._path(name)).drop("bucket")

    def _of(self, name: str, dataset_id: int) -> DataFrame:
        """A dataset's rows; only its folder is read."""
        if name not in _BUCKETED or not self._exists(self._path(name)):
            return self.table(name).where(F.col("dataset_id") == dataset_id)
        rows = self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(self._path(name))
        return rows.where((F.col("bucket") == dataset_id % BUCKETS) & (F.col("dataset_id") == dataset_id)).drop("bucket")

    def append(self, name: str, df: DataFrame) -> None:
        """Appends rows; columns of the table that the frame lacks become NULL."""
        shaped, folder = self._folders(name, df)
        writer = shaped.write.mode("append")
        (writer.partitionBy(folder) if folder else writer).parquet(self._path(name))

    def replace_datasets(self, name: str, df: DataFrame) -> None:
        """Overwrites the rows of the datasets that occur in the frame and no others."""
        shaped, folder = self._folders(name, df)
        if name in _BUCKETED:
            new = self.kept(shaped)
            touched = new.select("bucket").distinct()
            old = self._bucketed(name).join(F.broadcast(touched), "bucket", "left_semi").join(new.select("dataset_id").distinct(), "dataset_id", "left_anti")
            # Read and rewritten folders are the same, so what stays is written elsewhere first.
            shaped = new.unionByName(self.kept(old))
        self._overwrite(name, shaped, folder)

    def _overwrite(self, name: str, shaped: DataFrame, folder: str) -> None:
        # Rebalancing splits a large dataset over several files and gathers small ones.
        shaped.hint("rebalance", folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(self._path(name))

    def _bucketed(self, name: str) -> DataFrame:
        if not self._exists(self._path(name)):
            return self.spark.createDataFrame([], SCHEMAS[name] + ", bucket int")
        return self.spark.read.schema(SCHEMAS[name] + ", bucket int").parquet(self._path(name))

    def kept(self, df: DataFrame) -> DataFrame:
        """The frame written to scratch space and read again."""
        path = scratch_path(self.spark, "store")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # Ledger: append-only, the latest row of a key is its state.

    def record(self, operation: str, key: str, status: str, result: Mapping[str, Any] | None = None, error: str | None = None, as_of: datetime | None = None) -> None:
        self.record_all([(operation, key, status, result, error)], as_of)

    def record_all(self, rows: Sequence[tuple], as_of: datetime | None = None) -> None:
        """(operation, key, status, result, error) rows in one write."""
        moment = _now(as_of)
        shaped = [(o, k, s, json.dumps(r, sort_keys=True) if r is not None else None, e, moment) for o, k, s, r, e in rows]
        self.append("ledger", self.spark.createDataFrame(shaped, SCHEMAS["ledger"]))

    def ledger_state(self) -> DataFrame:
        order = F.struct("ts", F.col("status") == "completed")
        latest = F.max_by(F.struct("status", "result_json", "error", "ts"), order)
        return self.table("ledger").groupBy("operation", "idempotency_key").agg(latest.alias("_s")).select(
            "operation", "idempotency_key", "_s.*"
        )

    def completed_result(self, operation: str, key: str) -> dict | None:
        row = self.ledger_state().where(
            (F.col("operation") == operation) & (F.col("idempotency_key") == key) & (F.col("status") == "completed")
        ).first()
        return None if row is None or not row["result_json"] else {**json.loads(row["result_json"]), "idempotency_reused": True}

    # Datasets.

    def load(self, entries: DataFrame, rows: DataFrame, as_of: datetime | None = None) -> DataFrame:
        """Stores the datasets of ``entries`` that are not registered yet and returns their ids.

        ``entries`` has the columns of ``ENTRY`` (name, type and hash are needed), ``rows`` the canonical rows of all of them with
        their name, type and hash. Ids follow from the keys and facts overwrite their own folders, so a load
        that died half-way is simply repeated; a dataset counts as stored once the registry, which is written
        last, has it. The number of jobs does not depend on the number of datasets.
        """
        moment = F.lit(_now(as_of)).cast("timestamp")
        for field in self.spark.createDataFrame([], ENTRY).schema:
            if field.name not in entries.columns:
                entries = entries.withColumn(field.name, F.lit(None).cast(field.dataType))
        keyed = entries.withColumn("_key", dataset_key()).withColumn("dataset_id", key_to_id_column(F.col("_key"))).dropDuplicates(["dataset_id"])
        known = self.table("datasets").select("dataset_id")
        new = self.kept(keyed.join(known, "dataset_id", "left_anti"))
        step = lambda status, result: new.select(
            F.lit("store_dataset").alias("operation"), F.col("_key").alias("idempotency_key"), F.lit(status).alias("status"), result.alias("result_json"),
            F.lit(None).cast("string").alias("error"), moment.alias("ts"),
        )
        self.append("ledger", step("in_progress", F.lit(None).cast("string")))
        of = rows.withColumn("dataset_id", key_to_id_column(dataset_key())).drop("name", "file_hash").join(new.select("dataset_id"), "dataset_id", "left_semi")
        counts = []
        for target, wanted in (("survey_responses", F.col("dataset_type").isin(*K.TEXT_TYPES)), ("usage_statistics", ~F.col("dataset_type").isin(*K.TEXT_TYPES))):
            fields = [f for f in self.spark.createDataFrame([], SCHEMAS[target]).schema if f.name != "id"]
            have = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name in rows.columns or f.name == "dataset_id"]
            own = with_row_ids(of.where(wanted).select(*have))
            shaped, folder = self._folders(target, own)
            self._overwrite(target, shaped, folder)
            if self._exists(self._path(target)):
                # Joined with the new ids, so only their folders are read again.
                counts.append(self.table(target).join(F.broadcast(new.select("dataset_id")), "dataset_id", "left_semi").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count")))
        registered = new.join(union_all(counts), "dataset_id", "left") if counts else new.withColumn("row_count", F.lit(0))
        self.replace_datasets("datasets", registered.withColumns({
            "row_count": F.coalesce("row_count", F.lit(0)).cast("long"), "upload_date": moment, "indexing_status": F.lit("pending"),
        }))
        self.append("ledger", step("completed", F.to_json(F.struct("dataset_id"))))
        return keyed.join(new.select("dataset_id", F.lit(True).alias("is_new")), "dataset_id", "left").select(
            "dataset_id", "name", "dataset_type", "file_hash", F.coalesce("is_new", F.lit(False)).alias("is_new"),
        )

    def add_datasets(self, loads: Sequence[Load], as_of: datetime | None = None) -> list[int]:
        """Stores every load once per (hash, name, type), all in one pass, and returns their ids."""
        entries = [
            (x.name, x.dataset_type, x.file_hash, list(x.rows.columns), *[x.metadata.get(c) for c in ("title", "description", "source")],
             list(x.metadata.get("keywords", [])), x.metadata.get("usage_notes"), x.metadata.get("ethical_considerations"))
            for x in loads
        ]
        tagged = [
            canonical_rows(x.rows, x.dataset_type, 0).drop("dataset_id").withColumns({"name": F.lit(x.name), "dataset_type": F.lit(x.dataset_type), "file_hash": F.lit(x.file_hash)})
            for x in loads
        ]
        rows = tagged[0]
        for frame in tagged[1:]:
            rows = rows.unionByName(frame, allowMissingColumns=True)
        self.load(self.spark.createDataFrame(entries, ENTRY), rows, as_of)
        return [key_to_id(operation_key("store_dataset", x.file_hash, x.name, x.dataset_type)) for x in loads]

    def add_dataset(
        self, df: DataFrame, name: str, dataset_type: str, file_hash: str,
        metadata: Mapping[str, Any] | None = None, as_of: datetime | None = None,
    ) -> int:
        """Stores one dataset once per (hash, name, type) and returns its id."""
        return self.add_datasets([Load(df, name, dataset_type, file_hash, metadata or {})], as_of)[0]

    def check_duplicate(self, file_hash: str) -> DataFrame:
        return self.table("datasets").where(F.col("file_hash") == file_hash).select("dataset_id", "name", "upload_date")

    def facts(self, dataset_id: int) -> DataFrame:
        row = self._of("datasets", dataset_id).select("dataset_type").first()
        kind = row["dataset_type"] if row else "usage"
        table = "survey_responses" if kind in K.TEXT_TYPES else "usage_statistics"
        return self._of(table, dataset_id)

    def preview(self, dataset_id: int, n: int = 10) -> DataFrame:
        return self.facts(dataset_id).orderBy("id").limit(n)

    def catalog(self) -> DataFrame:
        return self.table("datasets").orderBy(F.desc("upload_date"), F.desc("dataset_id"))

    def manifest(self) -> DataFrame:
        """One JSON document per dataset, newest first."""
        fields = (
            "dataset_id", "name", "title", F.col("dataset_type").alias("type"), "upload_date", "row_count",
            "description", "source", "keywords", "usage_notes", "ethical_considerations",
        )
        return self.catalog().select("dataset_id", F.to_json(F.struct(*fields)).alias("manifest"))

    def export(self, dataset_id: int, path: str, kind: str = "csv") -> None:
        df = self.facts(dataset_id)
        if kind == "csv":
            df.write.mode("overwrite").option("header", True).csv(path)
        elif kind == "json":
            df.write.mode("overwrite").json(path)
        else:
            raise ValueError("kind must be csv or json")

    def drop_folder(self, name: str, dataset_id: int) -> None:
        """Removes a dataset's folder of a table that is partitioned by dataset."""
        fs, p = self._fs_path(f"{self._path(name)}/dataset_id={dataset_id}")
        if fs.exists(p):
            fs.delete(p, True)

    def delete_dataset(self, dataset_id: int) -> bool:
        """Drops the dataset's folders and its rows in its buckets; passages go first, the registry last."""
        if self._of("datasets", dataset_id).isEmpty():
            return False
        for table in ["passages"] + [t for t in _PARTITIONED if t != "passages"]:
            self.drop_folder(table, dataset_id)
        for table in [t for t in _BUCKETED if t != "datasets"] + ["datasets"]:
            bucket = dataset_id % BUCKETS
            rows = self._bucketed(table).where(F.col("bucket") == bucket)
            kept = self.kept(rows.where(F.col("dataset_id") != dataset_id))
            if kept.isEmpty():
                # Nothing is left to overwrite the folder with.
                fs, p = self._fs_path(f"{self._path(table)}/bucket={bucket}")
                if fs.exists(p):
                    fs.delete(p, True)
            else:
                self._overwrite(table, kept, "bucket")
        return True

    # Provenance and analyses.

    def add_provenance(self, dataset_id: int, operation: str, method: str, parameters: Mapping[str, Any] | None = None, as_of: datetime | None = None) -> None:
        row = ("transformation", _now(as_of), operation, method, None, json.dumps(parameters or {}, sort_keys=True), dataset_id)
        self.append("provenance_events", self.spark.createDataFrame([row], SCHEMAS["provenance_events"]))

    def add_query(self, dataset_id: int, question: str, username: str, as_of: datetime | None = None) -> None:
        row = ("query", _now(as_of), None, None, username, question, dataset_id)
        self.append("provenance_events", self.spark.createDataFrame([row], SCHEMAS["provenance_events"]))

    def provenance(self, dataset_id: int) -> DataFrame:
        return self._of("provenance_events", dataset_id).orderBy("ts", "kind", "detail")

    def add_analysis(
        self, dataset_id: int, analysis_type: str, parameters: Mapping[str, Any], results: Mapping[str, Any], as_of: datetime | None = None
    ) -> int:
        texts = {k: results.get(k) for k in ("interpretation", "insights", "recommendations")}
        numbers = {k: v for k, v in results.items() if k not in texts}
        moment = _now(as_of)
        analysis_id = key_to_id(operation_key("analysis", dataset_id, analysis_type, dict(parameters), str(moment)))
        row = (
            analysis_id, analysis_type, json.dumps(parameters, sort_keys=True), json.dumps(numbers, sort_keys=True, default=str),
            texts["interpretation"], texts["insights"], texts["recommendations"], moment, dataset_id,
        )
        self.append("analyses", self.spark.createDataFrame([row], SCHEMAS["analyses"]))
        return analysis_id

    def analysis(self, analysis_id: int) -> DataFrame:
        return self.table("analyses").where(F.col("analysis_id") == analysis_id)

    def analyses(self, dataset_id: int, analysis_type: str | None = None, limit: int | None = None) -> DataFrame:
        return list_analyses(self._of("analyses", dataset_id), analysis_type, limit)


def list_analyses(analyses: DataFrame, analysis_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored analyses, newest first, with flags for the texts they carry."""
    df = analyses if analysis_type is None else analyses.where(F.col("analysis_type") == analysis_type)
    flags = [F.col(c).isNotNull().alias(f"has_{c}") for c in ("interpretation", "insights", "recommendations")]
    df = df.select("analysis_id", "dataset_id", "analysis_type", "parameters", "ts", *flags)
    df = df.orderBy(F.desc("ts"), F.desc("analysis_id"))
    return df if limit is None else df.limit(limit)
