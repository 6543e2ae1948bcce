"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are reduced to lower-case runs of letters and digits, joined by single spaces. An
item of length n may differ by ``k = floor(rate * n)`` edits (insertions, deletions, substitutions). It is split
into k + 1 pieces; whatever the edits, one piece stays whole. All pieces are found in one pass over a text,
and the surroundings of every hit are verified with Myers' bit-parallel distance over the whole item.

The items are read by the driver in slices of at most about ``SLICE_BYTES``, so what tasks hold is bounded
for a benchmark of any size; a larger one costs further passes over the texts.

Defined cases: a null text, or one without letters and digits, holds nothing; null or empty items match
nothing; an item without room for an edit must occur whole, between word borders; repeated items each
report; a null id is carried; empty tables give an empty result. Other columns, whatever their names, are
carried along untouched by ``clean`` and play no part in ``matches``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
SLICE_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")
FOUND = "id long, item_id long, distance int, start int, end int, piece_hits int"


def lowered(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    """Words between single spaces, one at either end; empty without words."""
    words = _WORD.findall(lowered(text))
    return f" {' '.join(words)} " if words else ""


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """Offsets and texts of one piece more than the errors that the item may have."""
    count = int(rate * len(item)) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def closest(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of the item to a part of the text, if at most ``most``, and where the first such part ends."""
    letters: dict[str, int] = {}
    for i, c in enumerate(item):
        letters[c] = letters.get(c, 0) | 1 << i
    full = (1 << len(item)) - 1
    top = 1 << len(item) - 1
    up, down, score = full, 0, len(item)
    best, at = most + 1, -1
    for j, c in enumerate(text):
        match = letters.get(c, 0) | down
        same = (((match & up) + up) ^ up) | match
        right_up = down | (full & ~(same | up))
        right_down = up & same
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        if score < best:
            best, at = score, j + 1
        right_up = (right_up << 1) & full
        up = ((right_down << 1) & full) | (full & ~(same | right_up))
        down = right_up & same
    return (best, at) if best <= most else None


class Finder:
    """All pieces of a slice of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, normal(t)) for i, t in items if t and normal(t)]
        self.rate = rate
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item, rate):
                where.setdefault(piece, []).append((n, offset))
        self.tree = ahocorasick.Automaton()
        for piece, places in where.items():
            self.tree.add_word(piece, (len(piece), places))
        self.any = bool(where)
        if self.any:
            self.tree.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """Item, distance, start and end (in the text) and hits of every place that holds an item."""
        body = normal(text) if text and self.any else ""
        if not body:
            return
        spans: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.tree.iter(body):
            for n, offset in places:
                item = self.items[n][1]
                slack = int(self.rate * len(item))
                start = end + 1 - length - offset
                low, high = max(0, start - slack), min(len(body), start + len(item) + slack)
                known = spans.setdefault(n, [])
                # Hits come by their ends, so only the last stretch can overlap.
                if known and low <= known[-1][1]:
                    known[-1][0], known[-1][1] = min(low, known[-1][0]), max(high, known[-1][1])
                    known[-1][2] += 1
                else:
                    known.append([low, high, 1])
        words = None
        for n, stretches in spans.items():
            name, item = self.items[n]
            slack = int(self.rate * len(item))
            for low, high, hits in stretches:
                found = closest(item, body[low:high], slack)
                if found is None:
                    continue
                distance, end = found
                back = closest(item[::-1], body[low:low + end][::-1], distance)
                start = low + end - back[1]
                words = words or list(_WORD.finditer(lowered(text)))
                # A place in the reduced text has as many spaces before it as its word has words before it.
                first = min(body.count(" ", 0, start + 1) - 1, len(words) - 1)
                last = max(first, min(body.count(" ", 0, low + end - 1) - 1, len(words) - 1))
                yield name, distance, words[first].start(), words[last].end(), hits


def _slices(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    rows = items.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // SLICE_BYTES))
    for part in range(count):
        yield [(r.id, r.text) for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == part).collect()]


def _matches(items: list[tuple[int, str]], rate: float):
    def run(batches):
        finder = Finder(items, rate)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [(i, *hit) for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in finder.find(text)]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "item_id", "distance", "start", "end", "piece_hits"])

    return run


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per place of a text that holds an item: ``id``, ``item_id``, ``distance``, ``start``, ``end`` (characters of

    the text, whole words) and ``piece_hits``. Overlapping places of an item are one, shown by its closest part.
    """
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = [slim.mapInArrow(_matches(part, rate), FOUND) for part in _slices(items, item_id, item_text)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _kept(items: list[tuple[int, str]], rate: float, at: int):
    def run(batches):
        finder = Finder(items, rate)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield part.filter(pa.array([next(finder.find(text), None) is None for text in part.column(at).to_pylist()], pa.bool_()))

    return run


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    for part in _slices(items, item_id, item_text):
        docs = docs.mapInArrow(_kept(part, rate, docs.columns.index(text)), docs.schema)
    return docs
