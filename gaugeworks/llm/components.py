"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Rows of a key that share a copy of its answer, and how many keys may have more than that at most.
SHARED = 500
FREQUENT = 50_000


def answered(rows: DataFrame, answers: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``answers`` (one row per ``key``), null where there is none.

    A frequent key would meet its answer in one task. Its rows are cut by a hash of ``spread`` into shares, each with a copy of the
    answer. At most ``FREQUENT`` keys are that frequent, so their list can be sent to all tasks. ``rows`` are read twice, so they
    should be a stored table.
    """
    size = max(SHARED, -(-rows.count() // FREQUENT))
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > size).select(key, F.ceil(F.col("_n") / size).cast("long").alias("_copies"))
    many = F.broadcast(stored(many, "frequent"))
    share = F.coalesce(F.pmod(F.xxhash64(spread, F.lit("share")), "_copies"), F.lit(0)).alias("_share")
    left = rows.join(many, key, "left").select(*rows.columns, share)
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1)) - 1)
    right = answers.join(many, key, "left").select(*answers.columns, F.explode(copies).alias("_share"))
    return left.join(right, [key, "_share"], "left").drop("_share")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in the edges ``a``, ``b``.

    Each round hangs neighbours below the smallest one they share, first larger neighbours, then smaller
    ones; only minima are gathered per id, never lists. Edges with a null end are ignored; an id that has
    only an edge to itself is not returned.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
