"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

A coordinate that makes all norms equal turns the largest inner product into the smallest distance. Each
table hashes vectors by ``floor((a x + b) / w)`` for several random directions. A query visits buckets in the
order of their estimated success: perturbations of its own bucket by one step in some directions, ordered
by the summed squared distances to the borders that they cross. Candidates of all tables are merged and
ranked by exact inner products in double precision.

The number of directions grows with the logarithm of the number of vectors. ``fit`` measures on about
``SAMPLE`` queries, whose true neighbours one pass over all vectors finds, how many buckets a query must
visit for ``RECALL``; with too many, it takes a direction less. Every vector is in the index. A query that met
fewer than ``k`` others, though there are more, visits ``WIDER`` times as many buckets, and is compared with all
vectors if that is not enough. That last step costs as many products as such queries times vectors.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that a result can show of them.
Buckets with many members or queries are cut into parts, members times queries, so none is dropped.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another
length than most (the shorter of equally frequent lengths) take no part, as do rows with a null id; ties go
to the smaller id; a repeated row counts once; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.components import stored

TABLES = 2
WIDTH = 2.5
OCCUPANCY = 256
RECALL = 0.96
SAMPLE = 100
MOST_PROBES = 512
WIDER = 8
PART = 4096


@dataclass
class Index:
    directions: np.ndarray
    shifts: np.ndarray
    width: float
    norm: float
    count: int
    probes: int

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Positions of vectors along the directions of all tables, in bucket widths."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        if query:
            x = x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True))
        full = np.concatenate((x, rest[:, None]), 1)
        return (np.einsum("nd,tdm->tnm", full, self.directions) + self.shifts[:, None, :]) / self.width


def probe_order(fraction: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Perturbations of one bucket, each as a step per direction, by rising score; the first changes nothing."""
    m = len(fraction)
    scores = np.concatenate((fraction**2, (1 - fraction) ** 2))
    order = np.argsort(scores, kind="stable")
    ranked = scores[order]
    steps = [(int(i % m), -1 if i < m else 1) for i in order]
    out = [(0,) * m]
    heap = [(ranked[0], (0,))] if m else []
    while heap and len(out) < most:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score + ranked[last + 1] - ranked[last], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + ranked[last + 1], (*chosen, last + 1)))
        row = [0] * m
        for i in chosen:
            j, step = steps[i]
            if row[j]:
                break
            row[j] = step
        else:
            out.append(tuple(row))
    return out


def _codes(buckets: np.ndarray) -> np.ndarray:
    """One number per row of steps along the directions."""
    code = np.zeros(len(buckets), np.int64)
    with np.errstate(over="ignore"):
        for j in range(buckets.shape[1]):
            code = (code + buckets[:, j]) * np.int64(0x5851F42D4C957F2D)
            code ^= code >> 29
    return code


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.float64).reshape(len(values), -1)


def _members(index: Index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                places = index.places(_matrix(batch.column("vector")), False)
                for table in range(len(places)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, table, np.int32)), pa.array(_codes(np.floor(places[table]).astype(np.int64))), batch.column("least"), batch.column("rep"), batch.column("vector")],
                        names=["table", "bucket", "least", "rep", "vector"],
                    )

    return run


def _probes(index: Index):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                places = index.places(_matrix(part.column("vector")), True)
                for table in range(len(places)):
                    home = np.floor(places[table])
                    rows, steps = [], []
                    for i, fraction in enumerate(places[table] - home):
                        order = probe_order(fraction, index.probes)
                        rows += [i] * len(order)
                        steps += order
                    codes = _codes((home[rows] + np.array(steps).reshape(len(rows), -1)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), table, np.int32)), pa.array(codes), part.column("rep").take(pa.array(rows))], names=["table", "bucket", "rep"])

    return run


def _nearest(queries: np.ndarray, members: np.ndarray, least: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, tuple]:
    """The ``k`` largest inner products of every query, ties by smallest id, and the members they belong to."""
    scores = queries @ members.T
    if scores.shape[1] > k:
        # All that tie with the k-th stay in play.
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        rows, columns = np.nonzero(scores >= kth[:, None])
    else:
        rows, columns = np.nonzero(np.ones(scores.shape, bool))
    values, ids, names = scores[rows, columns], least[columns], reps[columns]
    order = np.lexsort((names, ids, -values, rows))
    rows, values, ids, names = rows[order], values[order], ids[order], names[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(queries)))[rows]
    keep = place < k
    return np.bincount(rows[keep], minlength=len(queries)), (values[keep], ids[keep], names[keep])


NEAR = "query long, near array<struct<worse:double,least:long,rep:long>>"


def _near_column(counts: np.ndarray, found: tuple) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    values, ids, names = found
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(-values), pa.array(ids), pa.array(names)], names=["worse", "least", "rep"]))


def _visited(k: int):
    def run(key, queries, members):
        if not len(queries) or not len(members):
            return pa.table({"query": pa.array([], pa.int64()), "near": _near_column(np.zeros(0, np.int64), (np.zeros(0), *[np.zeros(0, np.int64)] * 2))})
        x, y = _matrix(queries.column("vector")), _matrix(members.column("vector"))
        least, reps = (np.asarray(members.column(c).combine_chunks()) for c in ("least", "rep"))
        out = []
        for start in range(0, len(x), 512):
            counts, found = _nearest(x[start:start + 512], y, least, reps, k)
            out.append(pa.table({"query": queries.column("rep").slice(start, 512), "near": _near_column(counts, found)}))
        return pa.concat_tables(out)

    return run


def _true_neighbours(names: np.ndarray, x: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, reps = _matrix(batch.column("vector")), np.asarray(batch.column("rep"))
            scores = x @ y.T
            scores[names[:, None] == reps[None, :]] = -np.inf
            best = np.argsort(-scores, axis=1)[:, :k]
            for i in range(len(x)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(best.shape[1], names[i])), pa.array(scores[i, best[i]]), batch.column("vector").take(pa.array(best[i]))], names=["query", "score", "vector"],
                )

    return run


def fit(vectors: DataFrame, k: int, seed: int = 7) -> Index:
    """An index plan for ``rep``, ``vector`` rows of distinct vectors."""
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    count, norm = vectors.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    sample = vectors.orderBy(F.xxhash64("rep", F.lit("sample"))).limit(SAMPLE).toPandas()
    x = np.array(sample.vector.tolist(), float)
    names = sample.rep.to_numpy(np.int64)
    top = Window.partitionBy("query").orderBy(F.desc("score"))
    true = vectors.mapInArrow(_true_neighbours(names, x, k), f"query long, score double, vector {vectors.schema['vector'].dataType.simpleString()}").withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k).toPandas()
    random = np.random.default_rng(seed)
    most = max(0, round(float(np.log2(max(count, 1) / OCCUPANCY) / 1.25)))
    directions = random.normal(size=(TABLES, x.shape[1] + 1, most))
    # Widths are relative to the spread of a projection.
    width = WIDTH * norm
    shifts = random.uniform(0, width, (TABLES, most))
    row_of = {n: i for i, n in enumerate(names.tolist())}
    owner = np.array([row_of[q] for q in true["query"]], np.int64)
    y = np.array(true.vector.tolist(), float).reshape(len(true), -1)
    for m in range(most, -1, -1):
        index = Index(directions[:, :, :m], shifts[:, :m], width, norm, count, 1)
        if not len(true) or not m:
            return index
        rank = np.full(len(true), MOST_PROBES)
        at, to = index.places(x, True), np.floor(index.places(y, False))
        for table in range(TABLES):
            home = np.floor(at[table])
            orders = [{step: r for r, step in enumerate(probe_order(f, MOST_PROBES))} for f in at[table] - home]
            moved = (to[table] - home[owner]).astype(int)
            rank = np.minimum(rank, [orders[o].get(tuple(s), MOST_PROBES) for o, s in zip(owner.tolist(), moved.tolist(), strict=True)])
        reached = np.searchsorted(np.sort(rank), np.arange(MOST_PROBES), "right") / len(rank)
        if reached[-1] >= RECALL:
            index.probes = int(np.argmax(reached >= RECALL)) + 1
            return index
    return index


def _met(asking: DataFrame, probes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The nearest entries of every query among the members of the buckets that it visits."""
    cut = lambda name: F.ceil(F.count("*") / PART).cast("long").alias(name)
    sizes = members.groupBy("table", "bucket").agg(cut("parts")).join(probes.groupBy("table", "bucket").agg(cut("pieces")), ["table", "bucket"])
    sizes = stored(sizes, "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit("part")), F.col(n))
    left = probes.join(asking, "rep").join(sizes, ["table", "bucket"]).select("table", "bucket", own("pieces").alias("piece"), every("parts").alias("part"), "rep", "vector")
    right = members.join(sizes, ["table", "bucket"]).select("table", "bucket", own("parts").alias("part"), every("pieces").alias("piece"), "least", "rep", "vector")
    # Columns of their own, since queries and members can come from one table.
    right = right.select(*[F.col(c).alias(f"m_{c}") for c in ("table", "bucket", "part", "piece")], *[F.col(c).alias(c) for c in ("least", "rep", "vector")])
    visited = left.groupBy("table", "bucket", "part", "piece").cogroup(right.groupBy("m_table", "m_bucket", "m_part", "m_piece")).applyInArrow(_visited(k + 1), NEAR)
    # At most k + 1 candidates of each visited bucket part meet here. An entry is found once per table at most.
    return visited.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, TABLES * (k + 1)).alias("near"))


def _listed(met: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``query`` and the ``list`` of its ``k`` nearest ids, null if it met nothing."""
    shown = met.select("query", F.inline("near")).groupBy("query", "rep").agg((-F.min("worse")).alias("score"))
    shown = shown.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    shown = shown.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = shown.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("list"))
    return queries.join(lists, "query", "left").select("query_id", "query", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))


def search(rows: DataFrame, is_query: Column, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest found of every query row."""
    # Single precision only where it was given, so that scores are those of the original vectors.
    kind = "array<float>" if rows.select(vector).dtypes[0][1] == "array<float>" else "array<double>"
    sound = (
        rows.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(F.col(id).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"), F.col("_query").alias("query"))
        .filter("id IS NOT NULL AND vector IS NOT NULL")
        .filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
        .filter(F.exists("vector", lambda v: v != 0))
    )
    lengths = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    sound = stored(sound.filter(F.size("vector") == (lengths.n if lengths else 0)), "vectors")
    # Equal vectors: the smallest ids are picked in the map tasks already.
    smallest = Window.partitionBy("vector").orderBy("id")
    classes = (
        sound.select("id", "vector").withColumn("place", F.dense_rank().over(smallest)).filter(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumns({"rep": F.xxhash64("vector"), "least": F.get("ids", F.lit(0))})
    )
    classes = stored(classes, "classes")
    vectors = classes.select("least", "rep", "vector")
    queries = stored(sound.filter("query").select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("query")).distinct(), "queries")
    if not lengths:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query").alias("vec_id"), F.lit(0.0).alias("score"))
    index = fit(vectors, k)

    members = stored(vectors.mapInArrow(_members(index), f"table int, bucket long, least long, rep long, vector {kind}"), "members")
    held = members.select("table", "bucket").distinct()
    # What a query can find at least; classes of more than k + 1 ids count as k + 1.
    least = min(k, classes.agg(F.sum(F.size("ids"))).first()[0] - 1)
    found = F.coalesce(F.size("list"), F.lit(0))
    answers, left = None, queries
    # Queries that met too few visit more buckets, and those that still did are compared with all vectors.
    for probes in sorted({index.probes, min(WIDER * index.probes, MOST_PROBES)}):
        asking = vectors.join(left.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").drop("least")
        asked = asking.mapInArrow(_probes(replace(index, probes=probes)), "table int, bucket long, rep long").join(held, ["table", "bucket"], "left_semi")
        listed = stored(_listed(_met(asking, stored(asked, "probes"), members, k), classes, left, k), "answers")
        done = listed.filter(found >= least)
        answers = done if answers is None else answers.union(done)
        left = stored(listed.filter(found < least).select("query_id", "query"), "short")
        if left.isEmpty():
            break
    else:
        asking = vectors.join(left.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").drop("least")
        blocks = -(-2 * index.count // PART)
        members = vectors.select(F.lit(0).alias("table"), F.pmod(F.xxhash64("rep", F.lit("block")), F.lit(blocks)).cast("long").alias("bucket"), "least", "rep", "vector")
        probes = asking.select(F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bucket"), "rep")
        answers = answers.union(_listed(_met(asking, probes, members, k), classes, left, k))
    return answers.select("query_id", F.posexplode("list").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
