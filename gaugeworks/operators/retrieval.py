"""Passages, embeddings, nearest passages and cited contexts for batches of questions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import attach
from gaugeworks.functions.pii import redacted
from gaugeworks.functions.text import token_estimate, words

# Question vectors up to this many bytes are held by every task; more are joined block by block.
QUESTION_BYTES = 8 * 1024 * 1024
PIVOTS = 64
CHUNK_ROWS = 100_000
BLOCK_ROWS = 50_000
# Blocks of questions are made smaller, down to this, until every core has one.
LEAST_BLOCK_ROWS = 2_000
# Up to this many groups of a block and a chunk get a task each; of more, some meet in a task, which evens out.
MOST_DEALT = 4096
# Pairs of vectors that are worth a task of their own.
TASK_PAIRS = 1_000_000_000
# Distances are compared after rounding, so that equal ones are ordered by id.
DISTANCE_DIGITS = 9


def passage_id(dataset_id: Column | str, row_id: Column | str) -> Column:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.lit("ds"), text(dataset_id), F.lit("_row"), text(row_id))


def survey_passages(df: DataFrame) -> DataFrame:
    """Question and response lines of survey rows; rows without a response are left out."""
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    rows = df.where(F.col("response_text").isNotNull() & (F.col("response_text") != ""))
    return rows.select(
        passage_id("dataset_id", "id").alias("passage_id"), "dataset_id", F.lit("survey").alias("dataset_type"),
        F.col("id").cast("string").alias("source_row_id"),
        F.coalesce(F.col("response_date").cast("string"), F.lit("")).alias("date"),
        F.coalesce("question", F.lit("")).alias("question"), F.lit("").alias("metric_name"),
        F.concat_ws("\n", line("Survey question: ", "question"), line("Patron feedback response: ", "response_text")).alias("text"),
    )


def metric_passages(df: DataFrame, dataset_type: str = "usage") -> DataFrame:
    """A sentence per metric row; transactions read as checkouts."""
    name = F.coalesce(F.when(F.col("metric_name") != "", F.col("metric_name")), F.lit("metric"))
    # No value and zero both read 0.
    value = F.when(F.coalesce("metric_value", F.lit(0.0)) == 0, "0").otherwise(F.col("metric_value").cast("string"))
    day = F.coalesce(F.col("date").cast("string"), F.lit(""))
    has_category = F.col("category").isNotNull() & (F.col("category") != "")
    if dataset_type == "circulation":
        text = F.concat(F.lit("Circulation checkout: "), name, F.lit(" material checked out on "), day)
        tail = F.concat(F.lit(" by "), F.col("category"), F.lit(" patron"))
    else:
        text = F.concat(name, F.lit(": "), value, F.lit(" on "), day)
        tail = F.concat(F.lit(" (Category: "), F.col("category"), F.lit(")"))
    return df.select(
        passage_id("dataset_id", "id").alias("passage_id"), "dataset_id", F.lit(dataset_type).alias("dataset_type"),
        F.col("id").cast("string").alias("source_row_id"), day.alias("date"), F.lit("").alias("question"),
        name.alias("metric_name"), F.coalesce("category", F.lit("")).alias("category"), F.concat(text, F.when(has_category, tail).otherwise("")).alias("text"),
    )


def hashed_embedding(df: DataFrame, text: str = "text", size: int = 256, model=None):
    """Adds a unit vector of hashed, idf-weighted words; returns the frame and the fitted idf model.

    Needs no model download. Questions must be encoded with the model fitted on the passages.
    """
    tokens = df.withColumn("_w", words(F.coalesce(F.col(text), F.lit("")), 2))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size).transform(tokens)
    model = model or IDF(inputCol="_tf", outputCol="_x").fit(counted)
    scaled = Normalizer(p=2.0, inputCol="_x", outputCol="_u").transform(model.transform(counted))
    return scaled.withColumn("embedding", vector_to_array("_u", "float32")).drop("_w", "_tf", "_x", "_u"), model


def encode(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[Sequence[str]], np.ndarray]], batch: int = 100) -> DataFrame:
    """(key, embedding) from a caller's encoder, loaded once per task and fed in batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            parts = [np.asarray(encoder(texts[i:i + batch]), np.float32) for i in range(0, len(texts), batch)]
            yield pd.DataFrame({key: frame[key], "embedding": [v for part in parts for v in part]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def not_indexed(datasets: DataFrame, passages: DataFrame) -> DataFrame:
    """Registered datasets that have no passage yet."""
    return datasets.join(passages.select("dataset_id"), "dataset_id", "left_anti")


def sync_status(datasets: DataFrame, passages: DataFrame) -> DataFrame:
    """Registry with ``indexing_status`` completed wherever passages exist."""
    present = passages.groupBy("dataset_id").agg(F.lit(True).alias("_has"))
    rows = attach(datasets, present, ["dataset_id"], "left")
    ready = F.col("indexing_status").isin(*K.INDEXED_STATUSES)
    status = F.when(F.col("_has") & ~F.coalesce(ready, F.lit(False)), "completed").otherwise(
        F.coalesce("indexing_status", F.lit("pending"))
    )
    return rows.withColumn("indexing_status", status).drop("_has")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.round(np.maximum(d, 0.0), DISTANCE_DIGITS)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class Nearest:
    """The k nearest passages of some questions, from passages that come in parts.

    A product of single-precision matrices, widened by a bound of its rounding error, tells which pairs can be within the limit and
    the k-th distance so far; only those get a distance in double precision. Nothing is lost, and nothing larger than ``STEP`` by ``MOST`` is held.
    Each ``STEP`` questions sort what they found as soon as that is worth it, so that their k-th distances tighten at once.
    """

    STEP, FIRST, MOST, SLICE = 512, 256, 2048, 32_768

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, limit: float | None, exclude_same: bool = False):
        self.ids, self.vectors, self.k, self.exclude_same = ids, vectors, k, exclude_same
        self.limit = math.inf if limit is None else limit
        self.distance = np.full((len(ids), k), math.inf)
        self.held = np.zeros((len(ids), k), bool)
        self.keys = None
        self.waiting = [[] for _ in range(0, len(ids), self.STEP)]
        self.waits = [0] * len(self.waiting)
        self.squares = (vectors * vectors).sum(1)
        # Beyond single precision every pair gets its distance.
        self.safe = bool(np.isfinite(self.squares).all() and self.squares.max(initial=0.0) < 1e30)
        self.slack = (vectors.shape[1] + 8) * 2.0**-23
        if self.safe:
            self.left = np.column_stack([vectors, np.ones(len(ids)), self.slack * np.sqrt(self.squares)]).astype(np.float32)
            # New memory for every product would cost more than comparing it.
            self.products, self.flags = np.empty(self.STEP * self.MOST, np.float32), np.zeros(self.STEP * self.MOST, bool)

    def reach(self, asked: np.ndarray | slice) -> np.ndarray:
        """The largest distance that still matters for each of these questions."""
        return np.where(self.held[asked, -1], np.minimum(self.distance[asked, -1], self.limit), self.limit)

    def add(self, keys: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Takes passages into account, for the questions at the ascending positions ``which`` or for all."""
        if not len(rows) or not len(self.ids):
            return
        keys, rows = _without_spare_copies(keys, rows, self.k)
        if self.keys is None:
            self.keys = np.zeros(self.distance.shape, keys.dtype)
        elif self.keys.dtype != keys.dtype:
            self.keys = self.keys.astype(np.result_type(self.keys, keys))
        squares = (rows * rows).sum(1)
        safe = self.safe and bool(np.isfinite(squares).all() and squares.max() < 1e30)
        right = np.column_stack([rows, (self.slack - 1) * squares / 2, np.sqrt(squares)]).astype(np.float32) if safe else None
        for block in range(len(self.waiting)):
            start = block * self.STEP
            asked = np.arange(start, min(start + self.STEP, len(self.ids)))
            if which is not None:
                asked = which[np.searchsorted(which, start):np.searchsorted(which, start + self.STEP)]
                if not len(asked):
                    continue
            left = self.left[asked] if safe else None
            at, size = 0, self.MOST if self.held[asked, -1].all() else self.FIRST
            while at < len(rows):
                end = min(at + size, len(rows))
                if safe:
                    least = (self.squares[asked] - self.reach(asked) - 1e-9) / 2
                    r, c = self._possible(left, right[at:end], np.nextafter(least.astype(np.float32), np.float32(-np.inf)))
                else:
                    r, c = np.divmod(np.arange(len(asked) * (end - at)), end - at)
                self._take(asked[r], keys, rows, at + c)
                # Sorting costs what is held, so a few that are near wait until they are worth it.
                if self.waits[block] > len(asked) * self.k // 2:
                    self._settle(block)
                # The k-th distance gets smaller with every part, so parts can grow.
                at, size = end, min(2 * size, self.MOST)

    def _possible(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose product is at least what their question asks for."""
        count = len(left) * len(right)
        products, flags = self.products[:count].reshape(len(left), -1), self.flags[:count].reshape(len(left), -1)
        np.matmul(left, right.T, out=products)
        np.greater_equal(products, least[:, None], out=flags)
        # Few are set, so eight are looked at together.
        self.flags[count:-(-count // 8) * 8] = False
        eights = np.flatnonzero(self.flags[:-(-count // 8) * 8].view(np.uint64))
        which, bit = np.nonzero(self.flags.reshape(-1, 8)[eights])
        return np.divmod(eights[which] * 8 + bit, len(right))

    def _take(self, r: np.ndarray, keys: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
        if self.exclude_same:
            other = keys[c] != self.ids[r]
            r, c = r[other], c[other]
        if not len(r):
            return
        d = np.empty(len(r))
        for i in range(0, len(r), self.SLICE):
            apart = self.vectors[r[i:i + self.SLICE]] - rows[c[i:i + self.SLICE]]
            d[i:i + self.SLICE] = np.einsum("ij,ij->i", apart, apart)
        d = np.round(d, DISTANCE_DIGITS)
        near = ~(d > self.reach(r))
        block = int(r[0]) // self.STEP
        self.waiting[block].append((r[near], d[near], keys[c[near]]))
        self.waits[block] += len(self.waiting[block][-1][0])

    def _settle(self, block: int) -> None:
        if not self.waits[block]:
            return
        start = block * self.STEP
        r, d, ids = (np.concatenate(x) for x in zip(*self.waiting[block], strict=True))
        self.waiting[block], self.waits[block] = [], 0
        near = ~(d > self.reach(r))
        r, d, ids = r[near], d[near], ids[near]
        touched = np.unique(r)
        has = self.held[touched]
        r = np.concatenate([np.repeat(touched, self.k)[has.ravel()], r])
        d = np.concatenate([self.distance[touched][has], d])
        ids = np.concatenate([self.keys[touched][has], ids])
        # Narrow integers are sorted by radix.
        order = np.lexsort((ids, d, (r - start).astype(np.uint16)))
        r, d, ids = r[order], d[order], ids[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        kept = place < self.k
        r, place = r[kept], place[kept]
        self.distance[r, place], self.keys[r, place], self.held[r, place] = d[kept], ids[kept], True

    def found(self) -> pd.DataFrame:
        """``_q``, ``_p`` and ``distance`` within the limit."""
        for block in range(len(self.waiting)):
            self._settle(block)
        if self.keys is None:
            return pd.DataFrame({"_q": self.ids[:0], "_p": [], "distance": pd.Series([], dtype=float)})
        shown = self.held if self.limit == math.inf else self.held & (self.distance <= self.limit)
        return pd.DataFrame({"_q": np.repeat(self.ids, self.k)[shown.ravel()], "_p": self.keys[shown], "distance": self.distance[shown]})


def _without_spare_copies(keys: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, those with the k + 1 smallest keys: no other is among the k nearest of any question, itself left out."""
    if not rows.shape[1]:
        return keys, rows
    plain = np.ascontiguousarray(rows)
    _, group, sizes = np.unique(plain.view(np.dtype((np.void, plain.shape[1] * plain.itemsize))).ravel(), return_inverse=True, return_counts=True)
    if sizes.max() <= k + 1:
        return keys, rows
    many = np.flatnonzero(sizes[group] > k + 1)
    copies = pd.DataFrame({"group": group[many], "key": keys[many]})
    many = many[(copies.groupby("group")["key"].rank("dense", na_option="top") > k + 1).to_numpy()]
    kept = np.ones(len(keys), bool)
    kept[many] = False
    return keys[kept], rows[kept]


def nearest(
    questions: DataFrame, passages: DataFrame, k: int = K.TOP_K, limit: float | None = K.DISTANCE_LIMIT,
    question_key: str = "question_id", passage_key: str = "passage_id", vector: str = "embedding",
    exclude_same_key: bool = False, question_bytes: int = QUESTION_BYTES,
    chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(question, rank, passage, distance): the exact k nearest passages by squared distance.

    Passages farther than ``limit`` are dropped. Each task reduces its passages to k rows per
    question before anything is shuffled. Question vectors are held by every task only when
    they fit in ``question_bytes``; otherwise both sides are joined block by block. The pairs are
    quadratic in number; see ``Nearest`` for what a pair costs.
    """
    q = questions.select(F.col(question_key).alias("_q"), F.col(vector).alias("_qv")).where(F.col("_qv").isNotNull())
    p = passages.select(F.col(passage_key).alias("_p"), F.col(vector).alias("_pv")).where(F.col("_pv").isNotNull())
    size = q.agg(F.count(F.lit(1)), F.max(F.size("_qv"))).first()
    n, width = size[0], size[1] or 0
    fits = n * width * 8 <= question_bytes
    found = _by_task(q, p, k, limit, exclude_same_key) if fits else _by_block(q, p, k, limit, exclude_same_key, n, chunk_rows, block_rows)
    if exclude_same_key:
        found = found.where(F.col("_q") != F.col("_p"))
    order = Window.partitionBy("_q").orderBy("distance", "_p")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = (question_key, passage_key) if question_key != passage_key else (question_key, f"near_{passage_key}")
    return ranked.select(F.col("_q").alias(names[0]), "rank", F.col("_p").alias(names[1]), "distance")


def _result_schema(q: DataFrame, p: DataFrame) -> str:
    return f"_q {q.schema['_q'].dataType.simpleString()}, _p {p.schema['_p'].dataType.simpleString()}, distance double"


def _by_task(q: DataFrame, p: DataFrame, k: int, limit: float | None, exclude_same: bool) -> DataFrame:
    frame = q.toPandas()
    schema = _result_schema(q, p)
    context = q.sparkSession.sparkContext
    if frame.empty:
        return q.sparkSession.createDataFrame([], schema)
    held = context.broadcast((frame["_q"].to_numpy(), np.stack(frame["_qv"].to_numpy())))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = held.value
        best = Nearest(ids, vectors.astype(np.float64), k, limit, exclude_same)
        for part in frames:
            if not part.empty:
                best.add(part["_p"].to_numpy(), _matrix(part["_pv"]))
        if best.keys is not None:
            yield best.found()

    # A table of few files would be searched by few tasks.
    tasks = min(context.defaultParallelism, len(frame) * p.count() // TASK_PAIRS)
    return (p.repartition(tasks, "_p") if tasks > 1 else p).mapInPandas(search, schema)


def _dealt(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first chunk and the number of chunks of every cell: small cells share a chunk of up to ``most`` rows, large ones are cut."""
    first, count = np.zeros(len(sizes), int), np.zeros(len(sizes), int)
    at, room = -1, 0
    for cell in np.argsort(-sizes, kind="stable"):
        size = int(sizes[cell])
        if size > most:
            count[cell] = -(-size // most)
            first[cell], at, room = at + 1, at + int(count[cell]), 0
        elif size:
            if size > room:
                at, room = at + 1, most
            first[cell], count[cell], room = at, 1, room - size
    return first, count


def blocks_of(n: int, block_rows: int, parallelism: int) -> int:
    """Blocks of at most ``block_rows`` questions, and one per core if that leaves enough in each."""
    return max(1, math.ceil(n / block_rows), min(parallelism, n // LEAST_BLOCK_ROWS))


def _homes(spark: SparkSession, count: int) -> list[int]:
    """Numbers that a shuffle by their hash into ``count`` partitions deals to different ones; results never depend on it."""
    tried = spark.range(count * (20 + 2 * count.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(count)).alias("place"))
    found = {r["place"]: r["id"] for r in tried.groupBy("place").agg(F.min("id").alias("id")).collect()}
    spare = iter(set(range(count * 64)) - set(found.values()))
    return [found[i] if i in found else next(spare) for i in range(count)]


def _by_block(q: DataFrame, p: DataFrame, k: int, limit: float | None, exclude_same: bool, n: int, chunk_rows: int, block_rows: int) -> DataFrame:
    """Passages go to the nearest of a few pivots; a question visits only cells within reach.

    With cell radius r and pivot distance d, no passage of the cell is nearer than d - r, so a
    cell beyond the limit, or beyond the k-th distance so far, is skipped without losing a result. Cells are dealt
    to chunks and questions to blocks of bounded size, however uneven the cells are.
    """
    sample = p.orderBy(F.xxhash64("_p"), "_p").limit(PIVOTS).toPandas()
    schema = _result_schema(q, p)
    if sample.empty:
        return q.sparkSession.createDataFrame([], schema)
    pivots = _matrix(sample["_pv"])
    reach = math.sqrt(limit) if limit is not None else math.inf

    @F.pandas_udf("cell int, away double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        d = _squared(_matrix(vectors), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "away": np.sqrt(d[np.arange(len(d)), cell])})

    placed = p.withColumn("_c", place("_pv"))
    # One row per pivot.
    cells = placed.groupBy("_c.cell").agg(F.max("_c.away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius = np.full(len(pivots), -np.inf)
    sizes = np.zeros(len(pivots), dtype=int)
    for row in cells:
        radius[row["cell"]], sizes[row["cell"]] = row["radius"], row["n"]
    first, count = _dealt(sizes, chunk_rows)

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series) -> pd.Series:
        d = np.sqrt(_squared(_matrix(vectors), pivots))
        # A distance that is no number skips nothing.
        near = ~(d - radius[None, :] > reach + 1e-6) & (count[None, :] > 0)
        chunks = [np.arange(f, f + c, dtype="int32") for f, c in zip(first, count, strict=True)]
        return pd.Series([np.unique(np.concatenate([chunks[i] for i in np.flatnonzero(row)] or [chunks[0][:0]])) for row in near])

    n_blocks = blocks_of(n, block_rows, q.sparkSession.sparkContext.defaultParallelism)
    number = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("_cell"))
    left = q.withColumn("_chunk", F.explode(visits("_qv"))).withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(n_blocks)))
    right = placed.select("_p", "_pv", F.col("_c.cell").alias("_cell"))
    right = right.withColumn("_chunk", (number(first) + F.pmod(F.xxhash64("_p"), number(count).cast("long"))).cast("int"))
    right = right.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    keys, groups = ["_chunk", "_block"], int((first + count).max()) * n_blocks
    if groups <= MOST_DEALT:
        # The work of a group is large, so no task gets two while another has none.
        home = F.get(F.array(*[F.lit(i).cast("long") for i in _homes(q.sparkSession, groups)]), (F.col("_chunk") * n_blocks + F.col("_block")).cast("int"))
        keys = ["_home"]
        left, right = (side.withColumn("_home", home).repartition(groups, "_home") for side in (left, right))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_q": a["_q"][:0], "_p": b["_p"][:0], "distance": pd.Series([], dtype=float)})
        best = Nearest(a["_q"].to_numpy(), _matrix(a["_qv"]), k, limit, exclude_same)
        names, rows = b["_p"].to_numpy(), _matrix(b["_pv"])
        everyone = np.arange(len(a))
        for cell, own in b.groupby("_cell").indices.items():
            away = np.sqrt(_squared(best.vectors, pivots[cell:cell + 1])[:, 0])
            best.add(names[own], rows[own], np.flatnonzero(~(away - radius[cell] > np.sqrt(best.reach(everyone)) + 1e-6)))
        return best.found()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def confidence_scores(
    questions: DataFrame, retrieved: DataFrame, question_key: str = "question_id", limit: float = K.DISTANCE_LIMIT
) -> DataFrame:
    """Mean of 1 - distance / limit clamped to 0..1; a missing distance counts 0.5, no passage gives 0."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / limit))
    scored = retrieved.select(question_key, F.when(F.col("distance").isNull(), 0.5).otherwise(score).alias("_s"))
    table = scored.groupBy(question_key).agg(F.avg("_s").alias("confidence"), F.count(F.lit(1)).alias("n_passages"))
    rows = questions.select(question_key).join(table, question_key, "left")
    return rows.select(
        question_key, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_passages", F.lit(0)).alias("n_passages")
    )


def with_passage_text(retrieved: DataFrame, passages: DataFrame, passage_key: str = "passage_id") -> DataFrame:
    """Adds metadata and the redacted text of each retrieved passage."""
    rows = retrieved.join(passages.drop("embedding"), passage_key)
    return rows.withColumn("text", redacted("text"))


def citations(retrieved: DataFrame, question_key: str = "question_id") -> DataFrame:
    """One ordered array of (source_number, dataset_id, dataset_type, date) per question."""
    entry = F.struct(F.col("rank").alias("source_number"), "dataset_id", "dataset_type", "date")
    kept = retrieved.where(F.col("dataset_id").isNotNull())
    return kept.groupBy(question_key).agg(
        F.sort_array(F.collect_list(entry)).alias("citations"), F.count(F.lit(1)).alias("n_citations")
    )


def recent_turns(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", n: int = K.CONTEXT_TURNS
) -> DataFrame:
    """The last n turns of each conversation; map tasks keep n rows per conversation before the shuffle."""
    order = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


# The frame around context and question whose length the budget check counts.
PROMPT_HEAD = "You are a helpful library assessment assistant. Answer questions based on the provided data.\n\n"
PROMPT_HISTORY = "Previous conversation:\n"
PROMPT_TAIL = "Answer (include specific data points and cite sources):"
_PROMPT_LABELS = len("Relevant data:\n") + len("\n\n") + len("Question: ") + len("\n\n")
_TURN_LABELS = len("Q: ") + len("\nA: ") + len("\n\n")


def contexts(
    questions: DataFrame, retrieved: DataFrame, history: DataFrame | None = None, question_key: str = "question_id",
    question: str = "question", max_tokens: int = K.MAX_CONTEXT_TOKENS,
) -> DataFrame:
    """Numbered context per question, its token estimate and a status.

    ``history`` holds question_key, question and answer of the turns to include. At most k
    passages belong to a question, so the arrays are short.
    """
    source = F.concat(F.lit("Source "), F.col("rank").cast("string"), F.lit(": "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", source.alias("line")))), lambda x: x["line"])
    texts = retrieved.groupBy(question_key).agg(F.array_join(lines, "\n\n").alias("context"))
    rows = questions.select(question_key, F.col(question).alias("question")).join(texts, question_key, "left")
    spoken = F.lit(0)
    if history is not None:
        chars = F.sum(F.char_length("question") + F.char_length("answer") + F.lit(_TURN_LABELS)).alias("_chars")
        rows = rows.join(history.groupBy(question_key).agg(chars), question_key, "left")
        spoken = F.when(F.col("_chars").isNull(), F.lit(0)).otherwise(F.col("_chars") + len(PROMPT_HISTORY))
    size = F.lit(len(PROMPT_HEAD) + len(PROMPT_TAIL) + _PROMPT_LABELS) + spoken
    tokens = F.floor((size + F.char_length(F.coalesce("context", F.lit(""))) + F.char_length("question")) / 4)
    status = (
        F.when(F.col("context").isNull(), "no_relevant_data")
        .when(tokens > max_tokens, "context_too_large").otherwise("ready")
    )
    return rows.select(question_key, "question", "context", tokens.alias("estimated_tokens"), status.alias("status"))


def history_budget(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text",
                   n: int = K.CONTEXT_TURNS, max_tokens: int = K.MAX_CONTEXT_TOKENS) -> DataFrame:
    """Token estimate of the last n turns of each conversation against the budget."""
    recent = recent_turns(turns, conversation, turn, n)
    return recent.groupBy(conversation).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(token_estimate(F.coalesce(F.col(text), F.lit("")))).alias("tokens")
    ).withColumn("within_budget", F.col("tokens") <= max_tokens)
