"""Substring dedup: words covered by a window of words that also starts in an earlier document.

Every window of ``width`` words gets Rabin-Karp hashes. Each block of texts first settles its own
repeats, so a window that a third of all documents share leaves a block once. The rest goes to
buckets by hash; a bucket compares 64 bits beside the bits that chose the bucket, which makes a false
match less likely than one in 10^13 windows at any size, since buckets grow in number with the input.
Buckets answer with positions, which meet the texts again in groups of rows and merge into maximal
intervals. Windows are judged on the input.

Defined cases: a null text has no words; a row with a null id is kept whole and removes nothing; rows
with equal ids are not earlier than one another, so both stay; texts shorter than a window stay; an
empty table gives an empty result. Other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import blocks as B

WIDTH = 13


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids with 0 for null, and which are not null."""
    known = np.asarray(column.is_valid())
    return np.asarray(column.cast(pa.int64()).fill_null(0)), known


def _windows_to_buckets(width: int, buckets: int, groups: int):
    def run(batches):
        for block in B.blocks(batches):
            known = block.column("id").is_valid()
            block = block.filter(known)
            if not block.num_rows:
                continue
            ids, _ = _ids(block.column("id"))
            text = block.column("text")
            data, offsets = B.buffer(text)
            starts, ends, first = B.word_spans(data, offsets)
            at, doc = B.windows(first, width)
            if not len(at):
                continue
            words = B.word_hashes(data, starts, ends)
            hashes = B.window_hashes(words, at, width)
            bucket = (B.window_hashes(words, at, width, salt=0x2545F4914F6CDD1D) % np.uint64(buckets)).astype(np.int64)
            place = (at - first[:-1][doc]).astype(np.int32)
            keys = B.row_keys(ids, text)
            later = _later(hashes, ids[doc])
            rows = []
            gone = np.flatnonzero(later)
            for group, part in B.split((keys[doc[gone]] % np.uint64(groups)).astype(np.int64)):
                part = gone[part]
                rows.append((buckets + group, B.pack({"key": keys[doc[part]], "step": np.diff(place[part], prepend=np.int32(0))})))
            left = np.flatnonzero(~later)
            for number, part in B.split(bucket[left]):
                part = left[part]
                rows.append((number, B.pack({
                    "id": ids[doc[part]], "key": keys[doc[part]], "step": np.diff(place[part], prepend=np.int32(0)), "hash": hashes[part],
                })))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    return run


def _later(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash under a smaller id."""
    order = np.argsort(hashes)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
    sorted_ids = ids[order]
    least = np.repeat(np.minimum.reduceat(sorted_ids, heads), np.diff(np.append(heads, len(hashes))))
    out = np.empty(len(hashes), bool)
    out[order] = sorted_ids > least
    return out


def _bucket_answers(buckets: int, groups: int):
    def run(key, table):
        B.release()
        number = key[0].as_py()
        blobs = table.column("blob")
        if number >= buckets:
            return pa.table({"group": pa.array([number - buckets] * len(blobs), pa.int64()), "blob": blobs})
        parts = [B.unpack(x) for x in blobs]
        place = np.concatenate([np.cumsum(np.asarray(p.column("step")), dtype=np.int32) for p in parts])
        ids, keys, hashes = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("id", "key", "hash"))
        del parts
        gone = np.flatnonzero(_later(hashes, ids))
        rows = []
        for group, part in B.split((keys[gone] % np.uint64(groups)).astype(np.int64)):
            part = gone[part]
            rows.append((group, B.pack({"key": keys[part], "step": np.diff(place[part], prepend=np.int32(0))})))
        return pa.table({"group": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _rows_to_groups(groups: int):
    def run(batches):
        for block in B.blocks(batches):
            ids, _ = _ids(block.column("id"))
            keys = B.row_keys(ids, block.column("text"))
            rows = []
            for group, part in B.split((keys % np.uint64(groups)).astype(np.int64)):
                taken = block.take(pa.array(part))
                rows.append((group, B.pack({"key": keys[part]} | {f"c{i}": c for i, c in enumerate(taken.columns)})))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["group", "blob"])

    return run


def _covered(places: np.ndarray, width: int, count: int) -> np.ndarray:
    """Which of ``count`` words are covered by windows that start at ``places``."""
    change = np.zeros(count + 1, np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + width, count), -1)
    return np.cumsum(change[:count]) > 0


def _cut(width: int, types: list[pa.DataType], names: list[str]):
    def run(rows, answers):
        B.release()
        found = [B.unpack(x) for x in answers.column("blob")]
        places: dict[int, np.ndarray] = {}
        if found:
            keys = np.concatenate([np.asarray(p.column("key")) for p in found])
            place = np.concatenate([np.cumsum(np.asarray(p.column("step")), dtype=np.int32) for p in found])
            order = np.argsort(keys)
            keys, place = keys[order], place[order]
            heads = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
            places = dict(zip(keys[heads].tolist(), np.split(place, heads[1:]), strict=True))
        out = []
        for blob in rows.column("blob"):
            batch = B.unpack(blob)
            counts, removed, starts, ends, kept = [], [], [], [], []
            whole = batch.column("c1").to_pylist()
            known = batch.column("c0").is_valid().to_pylist()
            for i, (key, text, real) in enumerate(zip(np.asarray(batch.column("key")).tolist(), whole, known, strict=True)):
                words = text.encode().split()
                counts.append(len(words))
                at = places.get(key) if real else None
                if at is None:
                    removed.append(0)
                    starts.append([])
                    ends.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                gone = _covered(at, width, len(words))
                a, b = B.runs(gone)
                removed.append(int(gone.sum()))
                starts.append(a)
                ends.append(b)
                kept.append(b" ".join(compress(words, ~gone)).decode())
                whole[i] = kept[-1]
            # The carried columns, with words cut out of the text, then what was found.
            carried = [pa.array(whole, pa.string()), *batch.columns[3:]]
            out.append(pa.Table.from_arrays(
                [c.cast(t) for c, t in zip([batch.column("c0"), *carried], types, strict=True)]
                + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.string())],
                names=names,
            ))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], t) for t in [*types, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]], names=names)

    return run


def repeated_words(docs: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` in a struct ``row`` (its columns, the text without the removed words) with

    ``n_words``, ``n_removed``, ``starts`` and ``ends`` (removed intervals of words, ends excluded) and ``kept``
    (kept words joined by one space). A text that loses nothing is unchanged in ``row``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    others = [f for f in docs.schema.fields if f.name not in (id, text)]
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    slim = docs.select(quoted(id).cast("long").alias("id"), quoted(text).alias("text"))
    total = B.text_bytes(slim)
    buckets, groups = B.parts(docs, total, B.BUCKET_BYTES), B.parts(docs, total, B.GROUP_BYTES)
    answers = (
        slim.mapInArrow(_windows_to_buckets(width, buckets, groups), "bucket long, blob binary")
        .groupBy("bucket").applyInArrow(_bucket_answers(buckets, groups), "group long, blob binary")
    )
    # Carried columns get neutral names, so that none can clash.
    carried = docs.select(quoted(id).cast("long").alias("id"), quoted(text).alias("text"), *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(others)])
    shipped = carried.mapInArrow(_rows_to_groups(groups), "group long, blob binary")
    fields = [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)]]
    found = T.StructType.fromDDL("n_words long, n_removed long, starts array<long>, ends array<long>, kept string")
    schema = T.StructType(fields + found.fields)
    types = [to_arrow_type(f.dataType, timestamp_utc=True) for f in fields]
    merged = shipped.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_cut(width, types, schema.names), schema)
    place = {id: "id", text: "text"} | {f.name: f"c{i}" for i, f in enumerate(others)}
    row = F.struct(*[F.col(place[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    return merged.select(row.alias("row"), *found.names)


def drop_repeats(docs: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words removed that ``repeated_words`` finds; all rows and columns stay."""
    return repeated_words(docs, width, id, text).select("row.*")
