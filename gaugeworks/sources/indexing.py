"""Indexing runs: the stored passages of datasets brought in line with the passages that they should have."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.store import Store


def changes(passages: DataFrame, stored: DataFrame, datasets: DataFrame, carried: bool = False) -> DataFrame:
    """(dataset_id, passage_id, kind) for the given datasets: kind is new, changed, same or removed, told by the text's SHA-256.

    ``datasets`` are the ids of a run, which every task holds. ``carried`` adds ``row``, the passage to be encoded where it is new or changed.
    """
    sign = F.sha2(F.coalesce("text", F.lit("")), 256)
    rest = F.struct(*[F.col(f"`{c}`") for c in passages.columns if c not in ("dataset_id", "passage_id")])
    new = passages.select("dataset_id", "passage_id", sign.alias("_new"), *([rest.alias("row")] if carried else []))
    old = stored.join(F.broadcast(datasets), "dataset_id", "left_semi").select("dataset_id", "passage_id", sign.alias("_old"))
    both = new.join(old, ["dataset_id", "passage_id"], "full")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "same").otherwise("changed")
    found = both.withColumn("kind", kind)
    row = F.when(F.col("kind").isin("new", "changed") & F.col("passage_id").isNotNull(), F.col("row"))
    return found.select("dataset_id", "passage_id", "kind", *([row.alias("row")] if carried else []))


def index_run(store: Store, passages: DataFrame, encode: Callable[[DataFrame], DataFrame], datasets: DataFrame | None = None, as_of: datetime | None = None) -> DataFrame:
    """Encodes new and changed passages, removes those that are gone, and leaves all others as they are.

    ``encode`` adds ``embedding`` to passages. ``datasets`` (dataset_id) are those that the run covers, by default those that have passages;
    a covered dataset without passages loses its index. Only datasets in which something changed are written again, each into its own
    folder, so a run that died half-way is simply repeated. Returns the number of encoded, kept and removed passages by dataset.
    """
    keys = ["dataset_id", "passage_id"]
    covered = (passages if datasets is None else datasets).select("dataset_id").distinct()
    stored = store.table("passages")
    # Texts are shuffled once: what has to be encoded comes out of the comparison.
    own = passages.join(F.broadcast(covered), "dataset_id", "left_semi").dropDuplicates(keys)
    found = store.kept(changes(own, stored, covered, carried=True))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    summary = store.kept(found.groupBy("dataset_id").agg(count("new", "changed").alias("encoded"), count("same").alias("kept"), count("removed").alias("removed")))
    touched = summary.where("encoded + removed > 0").select("dataset_id")
    fresh = encode(found.where(F.col("row").isNotNull()).select(*keys, "row.*").select(*passages.columns))
    same = found.where(F.col("kind") == "same").join(F.broadcast(touched), "dataset_id", "left_semi").select(*keys)
    # The rows that stay come from the folders that are overwritten, so all are written elsewhere first.
    rows = store.kept(store.shaped("passages", fresh).unionByName(store.shaped("passages", stored.join(same, keys, "left_semi"))))
    store.replace_datasets("passages", rows)
    # Bounded by the datasets whose last passage went.
    for row in summary.where("encoded + kept = 0").select("dataset_id").toLocalIterator():
        store.drop_folder("passages", row["dataset_id"])
    registered = store.table("datasets").join(summary.select("dataset_id", (F.col("encoded") + F.col("kept") > 0).alias("_has")), "dataset_id")
    status = F.when(F.col("_has"), "completed").otherwise("pending")
    moment = F.when(F.col("_has"), F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp())
    store.replace_datasets("datasets", registered.withColumns({"indexing_status": status, "indexed_at": moment, "indexing_error": F.lit(None).cast("string")}).drop("_has"))
    return summary
