"""The registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, centroids, conversations, decontaminate, jaccard, language, mixing, neighbours, quality, sharding, substrings, toxicity, warc
from gaugeworks.llm.sampling import bounded
from gaugeworks.llm.statements import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _fold(id: str = "doc_id", folds: int = 4) -> Column:
    """Remainder that tells held-out rows."""
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds))


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = _table(spark, sf, "documents")
    model = language.fit(docs.filter((_fold() != 2) & F.col("lang").isNotNull()))
    found = language.label(docs, model)
    return found.select(F.col("id").alias("doc_id"), (_fold("id") == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("starts").alias("n_spans"))


@query
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Places of documents that hold a benchmark item, with their edit distance."""
    found = decontaminate.matches(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return jaccard.near_duplicates(_table(spark, sf, "documents"))


def word_tokenizer() -> str:
    """Path of the tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    encoded = bpe.encode(_table(spark, sf, "documents"), word_tokenizer())
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """Texts of about ``sample`` documents per label; of several labels of a document the largest counts.

    The sample is drawn from the labels, which bounds it before texts are read, so it is sent to them.
    """
    labels = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded(labels, "label", "doc_id", sample)), "doc_id")


@query
def op5_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.search(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    """What reading the archives of all pages gives."""
    found = warc.round_trip(_table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learned from those that are not held out."""
    docs = _table(spark, sf, "documents")
    labels = _table(spark, sf, "labels").filter(_fold() != 2)
    found = quality.score(docs, quality.fit(labelled(docs, labels, "quality", quality.SAMPLE)))
    return found.select(F.col("id").alias("doc_id"), (_fold("id") == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "good_share")


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, learned from those that are not held out."""
    docs = _table(spark, sf, "documents")
    labels = _table(spark, sf, "labels").filter(_fold(folds=5) != 0)
    found = toxicity.score(docs, toxicity.fit(labelled(docs, labels, "toxic", toxicity.SAMPLE)))
    return found.select(F.col("id").alias("doc_id"), (_fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words left of every document and how many were removed as repeats."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return substrings.repeated_words(docs).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


@query
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard of every document, with the bytes that it brings there."""
    docs = _table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"))
    return sharding.place(docs, "doc_id", SHARDS)


@query
def op11_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster of every vector after three rounds, with the inertia and a digest of its centroid."""
    assigned, found = centroids.cluster(_table(spark, sf, "embeddings"), k=16, rounds=3)
    return centroids.described(assigned, found).withColumnRenamed("id", "vec_id").drop("n_exact")


@query
def op12_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix of one and a half times all words takes of every document."""
    laid, slots = mixing.planned(_table(spark, sf, "documents"))
    taken = mixing.mix(laid, slots).groupBy("number", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    some = laid.filter("size > 0").join(taken, ["number", "start"], "left")
    found = some.unionByName(laid.filter("size = 0"), allowMissingColumns=True)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def damaged(rows: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of conversation and turn: dropped, emptied, without ends of sentences, repeated, or made the user's."""
    whole = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(whole("text"), ".!?", "")).otherwise(whole("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(whole("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of every damaged conversation, and cost, edits and digest of its cheapest repair."""
    rows = _table(spark, sf, "conversations")
    hurt = damaged(rows)
    repaired = conversations.repair(hurt)
    digests = conversations.digests(conversations.turns(hurt, repaired)).withColumnRenamed("id", "of")
    ids = rows.select("conv_id").distinct()
    found = ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
