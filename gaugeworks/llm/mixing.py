"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Targets: sources share ``share`` of all words by their weights, none more than ``most`` times its own size; what
   is beyond goes to the others by weight. Every round is one aggregate that finds the common level of words
   per weight; it ends when no further source is full.
2. Schedule: slot ``t`` has the golden-ratio point ``t * STEP mod POINTS``, in integers. Sources hold intervals of the
   points as long as their targets, and the slot goes to the source whose interval holds its point. A grid of cells
   over the points turns that search into an equality join. Slots are ranked per source, first inside chunks of the
   slots, then by the chunks' counts.
3. Blocks: every source's documents are shuffled by a hash and laid end to end, as often as the target needs; block
   ``b`` of a source is its words ``b * block`` to ``(b + 1) * block``. The slot of rank ``b`` takes block ``b``. The points leave a
   source a few slots over or short; those over stay empty, and those short follow at the end, so that every source
   gives exactly its target, rounded down.

No group has to fit in one task: the order inside a source is cut by the first bits of the hash into about the
square root of all rows, and slots into chunks. Words are maximal runs of characters other than 0x20 and 0x09-0x0D.

Defined cases: a null text has no words; a null source is a source of its own, after all others; rows with a null
id take part; equal rows are documents of their own; documents without words take no part and are placed with
a size of 0; an empty table, or one without words, gives an empty mix. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.components import stored
from gaugeworks.operators import ordered

WORD = r"[^\x20\x09-\x0D]+"
# Golden-ratio points: the odd number next to POINTS times 0.618... visits every point once in POINTS slots.
POINTS = 1 << 31
STEP = 1327217885
# Words in a slot.
BLOCK = 512
# Slots that are ranked in one group.
CHUNK = 4096
# Rows of a source that are ordered in one group, at least.
SLICE = 1000
HASH_BITS = 60
# Equal rows that one row stands for, at most, when they are laid out.
COPIES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id``, ``source``, ``size`` and shuffling hash ``place`` of every row; texts are read once for it."""
    name, body = F.col(id).cast("long"), F.col(text)
    digest = F.md5(F.concat(F.coalesce(name.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(body, F.lit(""))))
    place = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(name.alias("id"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"), place.alias("place"))


def numbered(rows: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``rows`` and ``number`` (from 1, by code point, null last) of every source."""
    sources = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    keyed = sources.withColumn("_key", F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name")))
    return stored(ordered.positions(keyed, "_key", out="number").drop("_key"), "numbered")


def with_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``: level * weight, but ``most`` times the size at most."""
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.lit(float(most)) * F.col("source_size")
    level, before = 0.0, None
    while True:
        full = cap <= level * F.col("weight")
        given, count, left = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.count(F.when(full, 1)), F.sum(F.when(full, 0).otherwise(F.col("weight")).cast("double")),
        ).first()
        if count == before or not left:
            return sources.withColumn("target", F.when(full, cap).otherwise(F.lit(level) * F.col("weight")))
        level, before = (total - given) / left, count


def golden_points(spark: SparkSession, slots: int) -> DataFrame:
    """``slot`` and its ``point``, from 0 to ``POINTS`` - 1."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // 1_000_000))
    slot = F.col("id")
    return spark.range(0, slots, 1, parts).select(slot.alias("slot"), (slot % POINTS * STEP % POINTS).alias("point"))


def scheduled(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot``, ``number`` and ``rank`` (from 0 in each source) of slots that give every source its ``quota`` in blocks.

    ``sources`` has ``number`` and ``quota``, whole words. Slots are in order, but not without gaps.
    """
    spark = sources.sparkSession
    placed = ordered.running_before(sources.select("number", "quota").filter("quota > 0"), "number", ["quota"])
    edge = lambda words: F.floor(words / F.col("quota_all") * POINTS).cast("long")
    placed = stored(placed.select("number", "quota", "quota_all", edge(F.col("quota_before")).alias("low"), edge(F.col("quota_before") + F.col("quota")).alias("high")), "intervals")
    count, last, words = placed.agg(F.count("*"), F.max("number"), F.max("quota_all")).first()
    slots = ceil((words or 0) / block)
    shift = 31 - min(31, max(1, (4 * count).bit_length()))
    cells = placed.filter("low < high").select(
        "number", "low", "high", "quota", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"),
    )
    points = golden_points(spark, slots).withColumn("cell", F.shiftright("point", shift))
    dealt = points.join(cells, "cell").filter("low <= point AND point < high").select("slot", "number", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    dealt = stored(dealt, "dealt")
    counts = ordered.running_before(dealt.groupBy("number", "chunk").agg(F.count("*").alias("n")), "chunk", ["n"], by=["number"])
    inside = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot"))
    ranked = dealt.withColumn("_in", inside).join(counts.select("number", "chunk", "n_before"), ["number", "chunk"])
    ranked = ranked.select("slot", "number", (F.col("n_before") + F.col("_in") - 1).alias("rank"), "quota").filter(F.col("rank") * block < F.col("quota"))
    had = dealt.groupBy("number").agg(F.count("*").alias("had"))
    short = placed.join(had, "number", "left").select(
        "number", F.coalesce("had", F.lit(0)).cast("long").alias("had"), F.ceil(F.col("quota") / block).cast("long").alias("needs"),
    ).filter("had < needs").select("number", F.explode(F.sequence("had", F.col("needs") - 1)).alias("rank"), "had")
    late = F.lit(slots) + (F.col("rank") - F.col("had")) * (last or 1) + F.col("number") - 1
    return ranked.select("slot", "number", "rank").union(short.select(late.alias("slot"), "number", "rank"))


def _key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key")


def laid_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row of ``sized`` with its source's columns and ``start``, the words of its source before it."""
    total = sources.agg(F.sum("rows")).first()[0] or 0
    bits = max(0, (total // max(SLICE, isqrt(total)) if total else 0).bit_length())
    merged = rows.select(_key(), "place", "id", "size").groupBy("_key", "place", "id", "size").agg(F.count("*").alias("copies"))
    merged = merged.withColumn("slice", F.shiftright("place", HASH_BITS - bits)).withColumn("words", F.col("size") * F.col("copies"))
    totals = merged.groupBy("_key", "slice").agg(F.sum("words").alias("words"))
    lower = Window.partitionBy("_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_key", "slice", F.coalesce(F.sum("words").over(lower), F.lit(0)).alias("_base"))
    base = base.join(sources.withColumn("_key", _key()).drop("rows"), "_key")
    inside = Window.partitionBy("_key", "slice").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = merged.withColumn("_in", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(base, ["_key", "slice"])
    found = stored(found.withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in", "slice", "words"), "laid")
    each = F.col("start") + F.col("copy") * F.col("size")
    few = found.filter(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = found.filter(F.col("copies") > COPIES).withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    many = many.repartition("_key", "place", "from").withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "copies") - 1))).drop("from")
    return few.union(many).withColumn("start", each).drop("copy", "copies", "place", "_key")


def pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of documents by block: ``number``, ``rank``, ``id``, ``start``, and words ``from`` to ``to`` of the document."""
    some = laid.filter("size > 0 AND start < quota")
    rounds = F.floor((F.col("quota") - F.col("start") - 1) / F.col("source_size")).cast("long")
    again = some.select("number", "quota", "id", "start", "size", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), rounds)).alias("round"))
    begin = F.col("round") * F.col("source_size") + F.col("start")
    again = again.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), "quota"))
    div = lambda words: F.floor(words / block).cast("long")
    cut = again.withColumn("rank", F.explode(F.sequence(div(F.col("begin")), div(F.col("end") - 1))))
    low, high = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    return cut.select("number", "rank", "id", "start", "round", (low - F.col("begin")).alias("from"), (high - F.col("begin")).alias("to"))


def mix(laid: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: in the order of ``slot``, then ``round``, ``start`` and ``from``, words ``from`` to ``to`` of document ``id``."""
    return slots.join(pieces(laid, block), ["number", "rank"])


def planned(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, id: str = "doc_id", text: str = "text", source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Documents laid out with their sources' targets, and the slots of the schedule; ``mix`` joins both.

    Sources by code point, null last, have ``weights``, repeating.
    """
    rows = stored(sized(docs, id, text, source), "sized")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    targets = with_targets(numbered(rows).withColumn("weight", weight), share, most)
    targets = stored(targets.withColumn("quota", F.floor("target").cast("long")), "targets")
    return laid_out(rows, targets), scheduled(targets, block)
