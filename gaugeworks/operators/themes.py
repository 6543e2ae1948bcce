"""Themes: TF-IDF vectors, k-means, keywords, quotes and shares."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import attach
from gaugeworks.functions.pii import redacted
from gaugeworks.functions.text import as_column


# Restarts that hold their vectors at the same time.
SIDE_BY_SIDE = 4


@dataclass
class Themes:
    """``assigned`` adds theme_id to the rows; ``table`` has one row per theme."""

    assigned: DataFrame
    table: DataFrame
    vocabulary: list[str]
    status: str


def _tfidf(df: DataFrame, text: str, features: int, keep: tuple[str, ...]):
    """Adds ``features``: L2-normalised tf times ln((1 + n) / (1 + df)) + 1 over words and word pairs.

    The vocabulary is the most frequent terms of the corpus after English stop words, equal counts
    in alphabetical order. Returns the frame, the persisted counts with the kept columns, the step
    that turns counts into features, and the vocabulary.
    """
    spark = df.sparkSession
    tokens = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True)
    stops = StopWordsRemover(inputCol="_w", outputCol="_s", stopWords=StopWordsRemover.loadDefaultStopWords("english"))
    pairs = NGram(inputCol="_s", outputCol="_p", n=2)
    terms = pairs.transform(stops.transform(tokens.transform(df)))
    terms = terms.withColumn("_terms", F.concat("_s", "_p")).drop("_w", "_s", "_p")
    # The outer form, because for the inner one Spark adds a filter that tokenises every text again.
    exploded = terms.select(F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
    frequent = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = [r["term"] for r in frequent.orderBy(F.desc("n"), "term").limit(features).collect()]
    if not vocabulary:
        raise ValueError("the texts hold no word outside the stop words")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_tf")
    counted = counter.transform(terms).drop("_terms")
    # The term counts are small next to the texts; keeping them spares a second tokenisation.
    points = counted.select(*keep, "_tf").persist(StorageLevel.MEMORY_AND_DISK)
    # One row with a number per vocabulary term.
    n, present = points.agg(F.count(F.lit(1)), Summarizer.numNonZeros(F.col("_tf"))).first()
    weights = [float(np.log((1 + n) / (1 + d)) + 1) for d in present.toArray()]
    scale = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_x")
    unit = Normalizer(p=2.0, inputCol="_x", outputCol="features")
    finish = lambda frame: unit.transform(scale.transform(frame)).drop("_tf", "_x")
    return finish(counted), points, finish, vocabulary


def _best_of(vectors: DataFrame, k: int, seed: int, restarts: int) -> KMeansModel:
    """The restart with the lowest cost; the restarts share the cached vectors, and a few run side by side.

    A cached frame would be decoded again in every round, so a restart gets a frame made from it, which it keeps as objects.
    """
    rows = vectors.select("features", F.lit(0).alias("_other"))

    def fit(i: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-4, featuresCol="features", predictionCol="_c").fit(rows)

    with ThreadPoolExecutor(max_workers=min(restarts, SIDE_BY_SIDE)) as pool:
        models = list(pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(restarts)))
    return min(models, key=lambda model: model.summary.trainingCost)


def extract_themes(
    df: DataFrame, key: str, text: str, sentiment: str | None = None, n_themes: int = K.DEFAULT_THEMES,
    features: int = K.THEME_FEATURES, seed: int = K.THEME_SEED, restarts: int = K.THEME_RESTARTS,
) -> Themes:
    """Clusters the texts and describes each cluster by keywords, share, quotes and sentiment mix."""
    rows = df.where(F.col(text).isNotNull())
    n = rows.count()
    if n < K.MIN_RESPONSES or n < n_themes:
        status = "insufficient_data" if n < K.MIN_RESPONSES else "fewer_responses_than_themes"
        empty = df.sparkSession.createDataFrame([], "theme_id int, theme_name string, keywords array<string>")
        return Themes(rows.withColumn("theme_id", F.lit(None).cast("int")), empty, [], status)
    keep = (sentiment,) if sentiment else ()
    vectors, counts, finish, vocabulary = _tfidf(rows, text, features, keep)
    points = finish(counts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = _best_of(points, n_themes, seed, restarts)
        shares = theme_shares(model.transform(points).withColumn("theme_id", F.col("_c") + 1), sentiment)
        # One row per theme, brought here so that the counts can be let go.
        shares = df.sparkSession.createDataFrame(shares.collect(), shares.schema)
    finally:
        points.unpersist()
        counts.unpersist()
    assigned = model.transform(vectors).withColumn("theme_id", F.col("_c") + 1).drop("_c", "features")
    described = []
    for i, center in enumerate(model.clusterCenters()):
        top = [vocabulary[j] for j in np.argsort(-np.asarray(center), kind="stable")[:5]]
        described.append((i + 1, f"Theme {i + 1}: {top[0]}", top))
    names = df.sparkSession.createDataFrame(described, "theme_id int, theme_name string, keywords array<string>")
    table = names.join(shares, "theme_id").join(
        quotes_by_theme(assigned, names, key, text), "theme_id", "left"
    )
    return Themes(assigned, table, vocabulary, "ok")


def theme_shares(assigned: DataFrame, sentiment: str | None = None) -> DataFrame:
    """Frequency, share in percent and sentiment mix per theme (over rows that have a sentiment)."""
    known = F.count(sentiment) if sentiment else F.lit(0)
    share = lambda label: (
        F.when(known > 0, F.count_if(F.col(sentiment) == label) / known).otherwise(0.0) if sentiment else F.lit(0.0)
    )
    table = assigned.groupBy("theme_id").agg(
        F.count(F.lit(1)).alias("frequency"), *[share(s).alias(s) for s in ("positive", "neutral", "negative")]
    )
    # One row per theme.
    total = F.sum("frequency").over(Window.partitionBy())
    return table.withColumn("percentage", F.col("frequency") / total * 100)


def representative_quotes(df: DataFrame, key: str, text: str, keyword: str, by: tuple[str, ...] = (), n: int = 3) -> DataFrame:
    """The n texts per group that hold the keyword (any case) and come closest to 100 characters."""
    found = F.contains(F.lower(text), F.lower(as_column(keyword)))
    distance = F.abs(F.char_length(text) - 100)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_d", key))
    near = df.where(found).select(*by, key, text, distance.alias("_d"))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).drop("_d")


def quotes_by_theme(assigned: DataFrame, names: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    rows = attach(assigned, names.select("theme_id", F.col("keywords")[0].alias("_kw")), ["theme_id"])
    picked = representative_quotes(rows, key, text, "_kw", ("theme_id",), n)
    quotes = F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda q: q[text])
    return picked.groupBy("theme_id").agg(quotes.alias("representative_quotes"))


def export_table(themes: DataFrame) -> DataFrame:
    """Display rows: joined keywords and percentages with one decimal."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    return themes.select(
        F.col("theme_name").alias("Theme"), F.array_join("keywords", ", ").alias("Keywords"),
        F.col("frequency").alias("Frequency"), F.format_string("%.1f%%", "percentage").alias("Percentage"),
        pct("positive").alias("Positive_Sentiment"), pct("neutral").alias("Neutral_Sentiment"),
        pct("negative").alias("Negative_Sentiment"),
    )


def summary_lines(themes: DataFrame) -> DataFrame:
    """One redacted line per theme with share, first keywords, sentiment and an example."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    # Redacted before it is shortened, so that no half address or number survives the cut.
    quote = F.substring(redacted(F.coalesce(F.col("representative_quotes")[0], F.lit(""))), 1, 100)
    line = F.concat(
        F.col("theme_name"), F.format_string(" (%.1f%% of responses) Keywords: ", "percentage"),
        F.array_join(F.slice("keywords", 1, 3), ", "), F.lit(" Sentiment: Positive "), pct("positive"),
        F.lit(", Neutral "), pct("neutral"), F.lit(", Negative "), pct("negative"),
        F.when(quote != "", F.concat(F.lit(' Example: "'), quote, F.lit('..."'))).otherwise(""),
    )
    return themes.select("theme_id", redacted(line).alias("summary"))
