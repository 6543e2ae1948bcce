"""Blocks of texts inside a task: cutting batches, words, shingle hashes, packed rows.

A block is a slice of one Arrow batch with about ``BLOCK_BYTES`` of text, or one longer text.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so words of the decoded text too.
Hashes are 64-bit polynomials modulo 2^64 over mixed values. All functions are vectorised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
# Bytes of words whose letters are mixed at once; some 60 bytes are held for each.
PIECE_BYTES = 256 << 10
# Bytes of text per group of documents that meet again in one task.
GROUP_BYTES = 8 << 20
# Bytes of text per bucket of word windows, about 2 million windows.
BUCKET_BYTES = 12 << 20


_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000")}


def small_batches(spark: SparkSession) -> None:
    """Lets rows with texts travel to Python in batches of 8 MB, unless the session says otherwise.

    A batch exists several times at once: in the JVM, on the way and in Python.
    """
    for key, (usual, small) in _BATCH.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, small)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one aggregate, which only decides how finely work is cut."""
    small_batches(docs.sparkSession)
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(docs: DataFrame, total: int, unit: int) -> int:
    """Number of pieces of ``unit`` bytes, at least one per shuffle partition of the session."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // unit))


def release() -> None:
    """Gives memory that Arrow holds for later back, since Python workers wait for the next task, and the next stage, beside the heap."""
    pa.default_memory_pool().release_unused()


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``size`` bytes of text; null texts become empty. Only a slice is ever copied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            part = batch.slice(start, stop - start)
            column = pc.fill_null(part.column(at).cast(pa.large_string()), "")
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)
            start = stop
        del column, part
        release()


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string column and the offsets of its rows in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every document the index of its first word (one more at the end)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        np.logical_not(inside[:-1], out=before[1:])
        np.logical_not(inside[1:], out=after[:-1])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit scramble, so that every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64(salt)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(count, 1), base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word's bytes; letters are spread out for ``PIECE_BYTES`` of words at a time."""
    lengths = ends - starts
    out = np.empty(len(lengths), np.uint64)
    if not len(lengths):
        return out
    total = np.cumsum(lengths)
    power, letters = _powers(0xC6A4A7935BD1E995, int(lengths.max())), _letters()
    at = before = 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(total, before + PIECE_BYTES, "right")))
        # A piece does not end in an empty word.
        while stop < len(lengths) and not lengths[stop - 1]:
            stop += 1
        size = lengths[at:stop]
        head = total[at:stop] - size - before
        place = np.arange(int(total[stop - 1] - before)) - np.repeat(head, size)
        with np.errstate(over="ignore"):
            value = letters[data[np.repeat(starts[at:stop], size) + place]] * power[place]
            out[at:stop] = np.add.reduceat(value, head)
        at, before = stop, int(total[stop - 1])
    return mix(out, 0x5851F42D4C957F2D)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``width`` words, and its document."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc], doc


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp: hashes of ``width`` words from each index on, as differences of one running polynomial."""
    with np.errstate(over="ignore"):
        running = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words, salt) * _powers(_BASE, len(words))[: len(words)], out=running[1:])
        return mix((running[at + width] - running[at]) * _powers(_UNBASE, len(words) + 1)[at], salt)


def row_keys(ids: np.ndarray, texts: pa.Array) -> np.ndarray:
    """A hash of each row's id and text; rows that agree in both are alike in every result."""
    import xxhash

    data, offsets = buffer(texts)
    view = memoryview(np.ascontiguousarray(data))
    return np.array([
        xxhash.xxh3_64_intdigest(view[a:b], int(i) & 0xFFFFFFFFFFFFFFFF) for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True)
    ], np.uint64)


def pack(columns: dict[str, np.ndarray | pa.Array]) -> bytes:
    """Columns of equal length as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes | pa.Scalar) -> pa.RecordBatch:
    if isinstance(blob, pa.Scalar):
        blob = blob.as_buffer()
    return pa.ipc.open_stream(blob).read_next_batch()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Byte arrays as one compressed blob, with few bytes beside them; most blobs are small."""
    arrays = [np.ascontiguousarray(a).ravel() for a in arrays]
    sizes = np.array([len(a) for a in arrays], np.uint32)
    return bytes([len(arrays)]) + sizes.tobytes() + zstandard.compress(b"".join(a.tobytes() for a in arrays), 3)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(blob, np.uint32, blob[0], 1), dtype=np.int64)
    data = np.frombuffer(zstandard.decompress(blob[1 + 4 * blob[0]:]), np.uint8)
    return np.split(data, ends[:-1])


def split(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every value of ``groups``: the value and the indices that have it, in order."""
    if not len(groups):
        return
    # Narrow integers are sorted by radix.
    groups = groups.astype(np.uint16) if groups.max() < 1 << 16 else groups
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    for piece in np.split(order, cuts):
        yield int(groups[piece[0]]), piece


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
