"""Queries that write a given table below the shared folder and read it through intake and the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import union_all
from gaugeworks.operators import normalize, retrieval
from gaugeworks.plans.registry import query, table
from gaugeworks.session import scratch_path
from gaugeworks.sources import indexing, intake
from gaugeworks.sources.store import Load, Store

MOMENT = datetime(2024, 5, 1)


@query("delimited_rows", """
    SELECT p_partkey, p_name AS "part name", p_brand, p_size FROM part""")
def delimited_rows(spark, sf):
    path = scratch_path(spark, "delimited")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias(" part name "), "p_brand", "p_size")
    rows.write.option("sep", "|").option("header", True).csv(path)
    read = intake.read_delimited(spark, path, separator=None)
    return read.select(F.col("p_partkey").cast("long").alias("p_partkey"), "part name", "p_brand", F.col("p_size").cast("int").alias("p_size"))


@query("json_rows", """
    SELECT conv_id, turn AS "said.turn", role AS "said.by.role", length(text)::BIGINT AS "said.by.length" FROM conversations""")
def json_rows(spark, sf):
    path = scratch_path(spark, "json")
    by = F.struct("role", F.char_length("text").cast("long").alias("length"))
    table(spark, sf, "conversations").select("conv_id", F.struct("turn", by.alias("by")).alias("said")).write.json(path)
    return intake.read_json(spark, path, lines=True)


@query("cleaned_frame", """
    SELECT c_custkey, c_name AS unnamed, c_mktsegment AS segment, c_nationkey AS segment_2 FROM customer WHERE c_custkey % 5 <> 0""")
def cleaned_frame(spark, sf):
    rows = table(spark, sf, "customer")
    kept = F.col("c_custkey") % 5 != 0
    hidden = rows.select(*[F.when(kept, F.col(c)).alias(c) for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")], F.lit(None).cast("string").alias("gone"))
    return intake.clean(hidden.toDF(" c_custkey", "  ", "segment", "segment ", "gone"))


def _event_store(spark, sf) -> tuple[Store, list[int]]:
    """A store with a dataset per kind of event, loaded at once, and one of texts."""
    events = table(spark, sf, "events")
    store = Store(spark, scratch_path(spark, "store"))
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = events.select(
        F.to_date("ts").alias("date"), "event_type", F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"),
    )
    loads = [Load(rows.where(F.col("event_type") == k).drop("event_type"), k, "usage", f"hash-{k}", {"title": k.upper()}) for k in kinds]
    texts = table(spark, sf, "benchmark").select(F.lit(None).cast("date").alias("response_date"), F.col("item_id").cast("string").alias("question"), F.col("text").alias("response_text"))
    return store, store.add_datasets([*loads, Load(texts, "items", "survey", "hash-items")], MOMENT)


CATALOG_SQL = """
    SELECT event_type AS name, 'usage' AS dataset_type, count(*) AS row_count, upper(event_type) AS title FROM events GROUP BY event_type
    UNION ALL SELECT 'items', 'survey', count(*), NULL FROM benchmark"""


@query("stored_catalog", CATALOG_SQL)
def stored_catalog(spark, sf):
    store, _ = _event_store(spark, sf)
    return store.catalog().select("name", "dataset_type", "row_count", "title")


@query("stored_manifest", f"SELECT name, dataset_type AS type, row_count, title FROM ({CATALOG_SQL})")
def stored_manifest(spark, sf):
    store, _ = _event_store(spark, sf)
    told = F.from_json("manifest", "name string, type string, row_count long, title string")
    return store.manifest().select(told.alias("m")).select("m.*")


@query("deleted_datasets", f"""
    SELECT t, n FROM (SELECT 'datasets' AS t, count(*) AS n FROM ({CATALOG_SQL}) WHERE name NOT IN ('click', 'items')
        UNION ALL SELECT 'usage_statistics', count(*) FROM events WHERE event_type <> 'click') WHERE n > 0""")
def deleted_datasets(spark, sf):
    store, ids = _event_store(spark, sf)
    for gone in (ids[0], ids[-1]):
        store.delete_dataset(gone)
    counts = [store.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t in ("datasets", "usage_statistics", "survey_responses")]
    return union_all(counts).where("n > 0")


@query("exported_dataset", "SELECT ts::DATE AS date, event_type AS metric_name, value AS metric_value FROM events WHERE event_type = 'error'", "metric_value")
def exported_dataset(spark, sf):
    store, ids = _event_store(spark, sf)
    path = scratch_path(spark, "export")
    store.export(ids[1], path, "json")
    return spark.read.schema("date date, metric_name string, metric_value double").json(path)


@query("previewed_rows", """
    SELECT metric_name, count(*) AS n, count(DISTINCT event_id) > 0 AS is_stored FROM (
        SELECT event_type AS metric_name, event_id, row_number() OVER (PARTITION BY event_type) AS r FROM events) WHERE r <= 7 GROUP BY metric_name""")
def previewed_rows(spark, sf):
    store, ids = _event_store(spark, sf)
    shown = union_all([store.preview(i, 7) for i in ids[:-1]])
    stored = table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.lit(True).alias("known")).distinct()
    found = shown.join(stored, ["date", "metric_name", "metric_value"], "left")
    return found.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("is_stored"))


@query("provenance_history", """
    SELECT 'query' AS kind, ts, 'u' || user_id AS username, event_type AS detail FROM events WHERE event_type = 'purchase' AND user_id = 7
    UNION ALL SELECT 'transformation', TIMESTAMP '2030-01-01', NULL, '{"rows": ' || (SELECT count(*) FROM events) || '}'""")
def provenance_history(spark, sf):
    store = Store(spark, scratch_path(spark, "store"))
    events = table(spark, sf, "events")
    store.append("provenance_events", events.where(F.col("event_type") == "purchase").select(
        F.lit("query").alias("kind"), "ts", F.concat(F.lit("u"), "user_id").alias("username"), F.col("event_type").alias("detail"), F.col("user_id").alias("dataset_id"),
    ))
    store.add_provenance(7, "count", "all", {"rows": events.count()}, datetime(2030, 1, 1))
    return store.provenance(7).select("kind", "ts", "username", "detail")


def _type_sql(text: str, fallback: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, '{h}')" for h in hints) + f" THEN '{kind}'" for kind, hints in K.TYPE_HINTS)
    return f"CASE {cases} ELSE {fallback} END"


@query("detected_types", f"""
    SELECT p_partkey, {_type_sql("lower(p_name || '.csv ' || p_type || ' ' || CASE p_size % 5 WHEN 0 THEN 'Room Bookings' WHEN 1 THEN 'checkout_date' WHEN 2 THEN 'response' WHEN 3 THEN 'visits' ELSE p_brand END)", "CASE WHEN p_partkey % 2 = 0 THEN 'usage' ELSE 'survey' END")} AS dataset_type FROM part""")
def detected_types(spark, sf):
    size = F.col("p_size") % 5
    named = F.when(size == 0, "Room Bookings").when(size == 1, "checkout_date").when(size == 2, "response").when(size == 3, "visits").otherwise(F.col("p_brand"))
    manifest = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(".csv")).alias("filename"), F.concat_ws(" ", "p_type", named).alias("columns"), (F.col("p_partkey") % 2 == 0).alias("has_numeric"),
    )
    return normalize.detect_types(manifest).select("p_partkey", "dataset_type")


@query("metric_renames", "SELECT event_id AS metric_name, ts, user_id, event_type AS category, value AS metric_value, props FROM events")
def metric_renames(spark, sf):
    return normalize.metric_columns(table(spark, sf, "events"), "usage")


@query("text_renames", "SELECT conv_id, turn, role, text AS response_text FROM conversations")
def text_renames(spark, sf):
    return normalize.text_columns(table(spark, sf, "conversations"))


INDEXED_SQL = """
    SELECT 'ds' || dataset_id || '_row' || doc_id AS passage_id, dataset_id, CASE WHEN doc_id % 10 = 0 AND dataset_id % 2 = 0 THEN text || ' again' ELSE text END AS text
    FROM (SELECT doc_id, text, CAST(substr(source, 4) AS BIGINT) AS dataset_id FROM documents WHERE text IS NOT NULL)
    WHERE dataset_id <> 3 AND NOT (dataset_id = 5 AND doc_id % 7 = 0)"""


def _passages(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull()).withColumn("dataset_id", F.substring("source", 4, 20).cast("long"))
    return docs.select(retrieval.passage_id("dataset_id", "doc_id").alias("passage_id"), "dataset_id", "doc_id", "text", F.lit("survey").alias("dataset_type"))


def _two_runs(spark, sf):
    """A first run over all documents and a second after some changed, some went and one dataset lost all."""
    store = Store(spark, scratch_path(spark, "store"))
    first = _passages(spark, sf)
    _, model = retrieval.hashed_embedding(first)
    encode = lambda df: retrieval.hashed_embedding(df, model=model)[0]
    indexing.index_run(store, first, encode, as_of=MOMENT)
    even = (F.col("doc_id") % 10 == 0) & (F.col("dataset_id") % 2 == 0)
    second = first.withColumn("text", F.when(even, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    second = second.where((F.col("dataset_id") != 3) & ~((F.col("dataset_id") == 5) & (F.col("doc_id") % 7 == 0)))
    return store, indexing.index_run(store, second, encode, first.select("dataset_id"), MOMENT), indexing.index_run(store, second, encode, first.select("dataset_id"), MOMENT)


@query("indexed_passages", f"SELECT passage_id, dataset_id, md5(text) AS text_md5, regexp_matches(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS has_vector FROM ({INDEXED_SQL})")
def indexed_passages(spark, sf):
    store, _, _ = _two_runs(spark, sf)
    some = F.exists("embedding", lambda x: x != 0)
    return store.table("passages").select("passage_id", "dataset_id", F.md5("text").alias("text_md5"), some.alias("has_vector"))


@query("indexing_run", f"""
    WITH first AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS dataset_id FROM documents WHERE text IS NOT NULL),
    second AS (SELECT * FROM first WHERE dataset_id <> 3 AND NOT (dataset_id = 5 AND doc_id % 7 = 0))
    SELECT dataset_id, count(s.doc_id) FILTER (s.doc_id % 10 = 0 AND dataset_id % 2 = 0) AS encoded, count(s.doc_id) FILTER (NOT (s.doc_id % 10 = 0 AND dataset_id % 2 = 0)) AS kept,
           count(*) - count(s.doc_id) AS removed, 0::BIGINT AS encoded_again, count(s.doc_id) AS kept_again
    FROM first f LEFT JOIN second s USING (doc_id, dataset_id) GROUP BY dataset_id""")
def indexing_run(spark, sf):
    _, second, third = _two_runs(spark, sf)
    third = third.select("dataset_id", F.col("encoded").alias("encoded_again"), F.col("kept").alias("kept_again"))
    return second.join(third, "dataset_id", "left").na.fill(0, ["encoded_again", "kept_again"])
