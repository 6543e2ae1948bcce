"""Sentiment of texts by word list or by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import attach
from gaugeworks.functions.text import words
from gaugeworks.operators.describe import sentiment_distribution

# The library's own word list, word -> (polarity, subjectivity).
LEXICON: dict[str, tuple[float, float]] = {
    "amazing": (0.8, 0.9), "awesome": (0.9, 1.0), "beautiful": (0.8, 0.9), "best": (0.9, 0.4),
    "better": (0.5, 0.5), "clean": (0.4, 0.6), "clear": (0.2, 0.4), "comfortable": (0.5, 0.8),
    "convenient": (0.5, 0.6), "easy": (0.4, 0.8), "effective": (0.5, 0.7), "efficient": (0.5, 0.6),
    "enjoy": (0.5, 0.6), "enjoyable": (0.6, 0.7), "excellent": (0.9, 0.9), "fair": (0.4, 0.7),
    "fantastic": (0.8, 0.9), "fast": (0.3, 0.6), "fine": (0.3, 0.5), "free": (0.3, 0.6),
    "friendly": (0.5, 0.6), "glad": (0.5, 0.9), "good": (0.6, 0.6), "grateful": (0.6, 0.8),
    "great": (0.8, 0.8), "happy": (0.8, 0.9), "helpful": (0.6, 0.6), "impressed": (0.7, 0.8),
    "kind": (0.5, 0.8), "like": (0.3, 0.5), "love": (0.7, 0.7), "loved": (0.7, 0.8),
    "nice": (0.6, 0.9), "outstanding": (0.9, 0.9), "perfect": (0.9, 0.9), "pleasant": (0.6, 0.8),
    "pleased": (0.6, 0.8), "polite": (0.5, 0.7), "positive": (0.4, 0.5), "quick": (0.3, 0.5),
    "quiet": (0.2, 0.4), "recommend": (0.5, 0.5), "reliable": (0.5, 0.6), "satisfied": (0.5, 0.8),
    "spacious": (0.4, 0.6), "superb": (0.9, 0.9), "thank": (0.4, 0.4), "thanks": (0.4, 0.4),
    "useful": (0.4, 0.5), "valuable": (0.5, 0.6), "warm": (0.4, 0.6), "welcoming": (0.6, 0.7),
    "wonderful": (0.9, 0.9), "worth": (0.4, 0.3),
    "angry": (-0.6, 0.9), "annoying": (-0.7, 0.9), "awful": (-0.9, 0.9), "bad": (-0.7, 0.7),
    "boring": (-0.7, 0.9), "broken": (-0.5, 0.5), "closed": (-0.1, 0.2), "cold": (-0.4, 0.7),
    "complain": (-0.5, 0.6), "confused": (-0.4, 0.7), "confusing": (-0.4, 0.6), "crowded": (-0.4, 0.5),
    "difficult": (-0.5, 0.8), "dirty": (-0.6, 0.8), "disappointed": (-0.7, 0.8), "disappointing": (-0.7, 0.8),
    "error": (-0.3, 0.3), "expensive": (-0.5, 0.7), "fail": (-0.5, 0.4), "failed": (-0.5, 0.4),
    "frustrated": (-0.7, 0.9), "frustrating": (-0.7, 0.9), "hard": (-0.3, 0.5), "hate": (-0.8, 0.9),
    "horrible": (-0.9, 0.9), "inadequate": (-0.6, 0.6), "inconvenient": (-0.5, 0.6), "lack": (-0.4, 0.4),
    "lacking": (-0.4, 0.5), "loud": (-0.4, 0.7), "mad": (-0.6, 0.9), "mess": (-0.5, 0.6),
    "missing": (-0.3, 0.3), "negative": (-0.4, 0.4), "noise": (-0.3, 0.5), "noisy": (-0.5, 0.7),
    "old": (-0.1, 0.3), "outdated": (-0.5, 0.5), "poor": (-0.6, 0.7), "problem": (-0.4, 0.4),
    "rude": (-0.7, 0.8), "sad": (-0.6, 0.9), "slow": (-0.4, 0.5), "terrible": (-0.9, 0.9),
    "unable": (-0.4, 0.5), "uncomfortable": (-0.5, 0.8), "unhappy": (-0.7, 0.9), "unhelpful": (-0.6, 0.7),
    "upset": (-0.6, 0.8), "useless": (-0.7, 0.7), "worse": (-0.6, 0.6), "worst": (-0.9, 0.9),
    "wrong": (-0.5, 0.6),
}
# Word lists up to this many entries travel inside the expression.
LEXICON_INLINE = 2_000
# Model labels in output order and their scores.
LABELS = ("negative", "neutral", "positive")
LABEL_SCORES = (-1.0, 0.0, 1.0)


def category(polarity: Column) -> Column:
    return (
        F.when(polarity > K.SENTIMENT_POSITIVE, "positive")
        .when(polarity < K.SENTIMENT_NEGATIVE, "negative").otherwise("neutral")
    )


def lexicon_sentiment(df: DataFrame, text: str, lexicon: Mapping[str, tuple[float, float]] = LEXICON) -> DataFrame:
    """Adds hits, polarity, subjectivity and category: means over the words of the list.

    A text without such a word, an empty text and a NULL text are neutral with polarity 0.
    The whole computation stays inside the row, so it needs no shuffle.
    """
    if len(lexicon) > LEXICON_INLINE:
        raise ValueError("pass a word list of this size as a table to lexicon_sentiment_table")
    listed = sorted(lexicon)
    known = F.filter(words(F.coalesce(F.col(text), F.lit(""))), lambda w: w.isin(*listed))
    table = lambda i: F.create_map(*[F.lit(x) for w in listed for x in (w, float(lexicon[w][i]))])
    total = lambda i: F.aggregate("_hits", F.lit(0.0), lambda acc, w: acc + F.element_at(table(i), w))
    rows = df.withColumn("_hits", known)
    n = F.size("_hits")
    mean = lambda i: F.when(n > 0, total(i) / n).otherwise(0.0)
    rows = rows.withColumn("hits", n).withColumn("polarity", mean(0)).withColumn("subjectivity", mean(1)).drop("_hits")
    return rows.withColumn("category", category(F.col("polarity")))


def lexicon_sentiment_table(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """The same for a word list of any size with columns word, polarity and subjectivity.

    Words are counted per text before the join, and texts without a hit come back by key.
    """
    # The outer form, because for the inner one Spark adds a filter that tokenises every text again.
    exploded = df.select(key, F.explode_outer(words(text)).alias("word")).where(F.col("word").isNotNull())
    tokens = exploded.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    hits = tokens.join(lexicon.select("word", "polarity", "subjectivity"), "word").groupBy(key).agg(
        F.sum("n").alias("hits"),
        (F.sum(F.col("n") * F.col("polarity")) / F.sum("n")).alias("polarity"),
        (F.sum(F.col("n") * F.col("subjectivity")) / F.sum("n")).alias("subjectivity"),
    )
    rows = attach(df, hits, [key], "left")
    rows = rows.withColumns({
        "hits": F.coalesce("hits", F.lit(0)),
        "polarity": F.coalesce("polarity", F.lit(0.0)),
        "subjectivity": F.coalesce("subjectivity", F.lit(0.0)),
    })
    return rows.withColumn("category", category(F.col("polarity")))


Scorer = Callable[[Sequence[str]], np.ndarray]


def model_sentiment(df: DataFrame, key: str, text: str, load: Callable[[], Scorer], batch: int = 32) -> DataFrame:
    """(key, category, score, confidence, failed) from a model that gives label probabilities per text.

    ``load`` runs once per task and returns the scorer. A batch that fails becomes neutral, and ``failed`` says so.
    """
    kind = df.schema[key].dataType.simpleString()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in frames:
            labels, scores, confidences, failed = [], [], [], []
            texts = frame[text].fillna("").tolist()
            for start in range(0, len(texts), batch):
                part = texts[start:start + batch]
                try:
                    chances = np.asarray(scorer(part), float).reshape(len(part), len(LABELS))
                    best = chances.argmax(axis=1)
                    labels += [LABELS[i] for i in best]
                    scores += [LABEL_SCORES[i] for i in best]
                    confidences += list(chances[np.arange(len(part)), best] * 100)
                    failed += [False] * len(part)
                except Exception:
                    labels += ["neutral"] * len(part)
                    scores += [0.0] * len(part)
                    confidences += [0.0] * len(part)
                    failed += [True] * len(part)
            yield pd.DataFrame({key: frame[key], "category": labels, "score": scores, "confidence": confidences, "failed": failed})

    return df.select(key, text).mapInPandas(score, f"`{key}` {kind}, category string, score double, confidence double, failed boolean")


def mean_confidence(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    table = sentiment_distribution(scored, "category", by)
    return attach(table, scored.groupBy(*by).agg(F.avg("confidence").alias("average_confidence"), F.count_if("failed").alias("failed")), by)


def dataset_sentiment(df: DataFrame, text: str, by: Sequence[str] = (), scored: DataFrame | None = None) -> DataFrame:
    """Category shares per dataset; too few responses give a status instead of shares."""
    rows = lexicon_sentiment(df.where(F.col(text).isNotNull()), text) if scored is None else scored
    table = sentiment_distribution(rows, "category", by)
    enough = F.col("total") >= K.MIN_RESPONSES
    status = F.when(~enough, "insufficient_data").when(F.col("processed") == 0, "nothing_processed").otherwise("ok")
    shares = [F.when(enough, F.col(c)).alias(c) for c in ("positive", "neutral", "negative")]
    return table.select(*by, "total", "processed", "skipped", *shares, status.alias("status"))
