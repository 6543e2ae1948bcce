"""N-gram Jaccard join with a token-group matrix.

Documents are sets of shingles. Two documents link when ``100 * common >= percent * union``.

1. Shingle hashes go to buckets, which answer how many documents hold each (counted up to ``HOT``). A
   document whose repeated shingles are fewer than ``percent`` of its set cannot link and ends here.
   Equal sets within a block are reported as copies at once, and a shingle that ``HOT`` documents of a
   block share leaves the block once, with its count. A row that is repeated in several blocks may be a
   copy of one row and have copies itself; such chains are components too.
2. Documents with the same smallest hashed shingle meet, and greedy leaders cut them into classes of
   documents that link to a leader. Large meetings are cut into salted parts.
3. The matrix: groups are parts of a class with about ``MEMBERS`` documents. Its columns are the shingles
   of the prefixes, without which no link is possible; columns that belong to one class are dropped.
   Documents of a class query the groups of larger classes. They find those with a common column behind
   which both sides still have as many shingles as a link between their sizes needs.
4. A group's token union bounds the overlap with each of its queries, and only groups that can hold a
   partner are opened. All members are one class already, so the first link found is enough.
5. Matrix and opening run first with a few queries and columns of each class, which joins most classes
   that belong together, then with all queries and columns of the classes that are left apart.
6. Components of all links and chains of copies.

Defined cases: a null or wordless text has an empty set and no links; a text shorter than the shingle
width is one shingle; a row with a null id has no links and a null component; rows with equal ids and
different texts are documents of their own; repeated rows are copies; an empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm import blocks as B
from gaugeworks.llm.components import answered, components, stored

WIDTH = 5
PERCENT = 75
# Counts of documents per shingle are exact up to this number; beyond it shingles are ordered by hash.
HOT = 64
PART = 256
MEMBERS = 64
QUERIES = 512
# Queries and columns per class in the first of the two passes.
FIRST = 3
# At most so many rounds of leaders, and of links to the next class, come before the full pass.
ROUNDS = 6
LAST = (1 << 63) - 1
CODE_BITS = 28
# Up to this many keys, 8 MB, are broadcast.
SENT_KEYS = 1_000_000
# Blocks are smaller than elsewhere, since sets take more room than words.
BLOCK_BYTES = 2 << 20


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin."""
    data, offsets = B.buffer(text)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = B.word_spans(data, offsets)
    words = B.word_hashes(data, starts, ends)
    at, doc = B.windows(first, width)
    hashes = B.window_hashes(words, at, width)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    for count in range(1, width):
        some = short[np.diff(first)[short] == count]
        hashes = np.concatenate((hashes, B.window_hashes(words, first[some], count)))
        doc = np.concatenate((doc, some))
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(first) < 1 << 16 else doc[order], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (np.diff(hashes) != 0) | (np.diff(doc) != 0)
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(text) + 1))


def _least_among_equal(first: np.ndarray, hashes: np.ndarray, ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For every text the index of the text with an equal set and the smallest id, of equal ids the smallest name.

    The order is the same in every block, so that copies of copies never lead back to where they began.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros((len(counts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0, 0x632BE59BD9B4E019)):
            some = counts > 0
            if some.any():
                sums[some, k] = np.add.reduceat(B.mix(hashes, salt), first[:-1][some])
    del owner
    best: dict[tuple, int] = {}
    keys = list(zip(counts.tolist(), sums[:, 0].tolist(), sums[:, 1].tolist(), strict=True))
    for i, key in enumerate(keys):
        if key not in best or (ids[i], names[i]) < (ids[best[key]], names[best[key]]):
            best[key] = i
    return np.array([best[k] if k[0] else i for i, k in enumerate(keys)], np.int64)


def _block_sets(block: pa.RecordBatch, width: int):
    """Set hashes of a block, where each text's begin, the row with an equal set that stands for each, and the distinct hashes of those rows."""
    keys = np.asarray(block.column("key"))
    hashes, first = shingle_sets(block.column("text"), width)
    same = _least_among_equal(first, hashes, np.asarray(block.column("id")), keys)
    keep = np.repeat(same == np.arange(len(same)), np.diff(first))
    return keys, hashes, first, same, np.unique(hashes[keep], return_counts=True)


def _by_bucket(distinct: np.ndarray, buckets: int):
    """Of every bucket: its number, the places of its hashes in order of their codes, and the codes.

    A bucket has about two million hashes, whatever the input, so ``CODE_BITS`` let one in a hundred meet a foreign one.
    """
    mixed = B.mix(distinct, 0x2545F4914F6CDD1D)
    codes = (mixed >> np.uint64(64 - CODE_BITS)).astype(np.uint32)
    order = np.argsort(codes, kind="stable")
    for number, part in B.split((mixed[order] % np.uint64(buckets)).astype(np.int64)):
        yield number, order[part], codes[order[part]]


def _sound(batches, size: int):
    for block in B.blocks(batches, size=size):
        block = block.filter(block.column("id").is_valid())
        if block.num_rows:
            yield block, xxhash.xxh3_64_intdigest(np.asarray(block.column("key")).tobytes()) >> 1


def _hashes_to_buckets(width: int, buckets: int):
    def run(batches):
        for block, name in _sound(batches, BLOCK_BYTES):
            _, _, _, _, (distinct, counts) = _block_sets(block, width)
            rows = [(number, B.pack_arrays(np.diff(codes, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T, np.minimum(counts[places], HOT).astype(np.uint8))) for number, places, codes in _by_bucket(distinct, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([name] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "blob"])

    return run


def _bucket_answers(key, table):
    """For every block which of its hashes other sets hold, as bits, and how many sets hold those."""
    B.release()
    parts = [B.unpack_arrays(x) for x in table.column("blob").to_pylist()]
    codes = np.concatenate([np.cumsum(np.ascontiguousarray(p[0].reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32) for p in parts])
    weight = np.concatenate([p[1] for p in parts]).astype(np.int64)
    ends = np.cumsum([len(p[1]) for p in parts])
    del parts
    order = np.argsort(codes)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(codes[order]) != 0)))
    total = np.minimum(np.add.reduceat(weight[order], heads), HOT).astype(np.uint8)
    count = np.empty(len(codes), np.uint8)
    count[order] = np.repeat(total, np.diff(np.append(heads, len(codes))))
    rows = []
    for name, stop, start in zip(table.column("block").to_pylist(), ends, [0, *ends[:-1]], strict=True):
        told = count[start:stop]
        if (told > 1).any():
            rows.append((name, key[0].as_py(), B.pack_arrays(np.packbits(told > 1), told[told > 1])))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "bucket", "blob"])


def _blocks_kept(batches):
    for block, name in _sound(batches, BLOCK_BYTES):
        blob = B.pack({c: block.column(c) for c in ("key", "id", "text")})
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])


SETS = "key long, id long, n long, copy_of long, tokens binary, least long"


def _candidates(width: int, percent: int, buckets: int):
    """The rows of a block; those that can have a partner in another set with their repeated hashes, rarest first."""

    def run(texts, answers):
        B.release()
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        out = []
        for blob in texts.column("blob"):
            block = B.unpack(blob)
            keys, hashes, first, same, (distinct, _) = _block_sets(block, width)
            count = np.zeros(len(distinct), np.uint8)
            for number, places, _ in _by_bucket(distinct, buckets):
                if number in told:
                    bits, counts = B.unpack_arrays(told[number])
                    count[places[np.flatnonzero(np.unpackbits(bits, count=len(places)))]] = counts
            for i, (key, id) in enumerate(zip(keys.tolist(), block.column("id").to_pylist(), strict=True)):
                n, stands = int(first[i + 1] - first[i]), int(same[i])
                row = [key, id, n, None, None, None]
                out.append(row)
                if stands != i:
                    # Repeated rows have one key, and the row that stands for them has the tokens.
                    row[3] = int(keys[stands]) if keys[stands] != key else None
                    continue
                tokens = hashes[first[i]:first[i + 1]]
                held = count[np.searchsorted(distinct, tokens)]
                tokens, held = tokens[held > 1], held[held > 1]
                if not len(tokens) or 100 * len(tokens) < percent * n:
                    continue
                row[4] = tokens[np.lexsort((tokens, held))].tobytes()
                row[5] = int(B.mix(tokens, 0x1B873593).min().view(np.int64))
        types = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)], names=["key", "id", "n", "copy_of", "tokens", "least"])

    return run


def _sorted_tokens(blob: bytes) -> np.ndarray:
    return np.sort(np.frombuffer(blob, np.uint64))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _links(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    if percent * max(n, m) > 100 * min(n, m):
        return False
    common = _common(a, b)
    return 100 * common >= percent * (n + m - common)


def _leaders(percent: int):
    def run(table):
        table = table.sort_by([("n", "ascending"), ("key", "ascending")])
        leaders: list[tuple] = []
        chosen: dict[int, int] = {}
        for key, n, blob in zip(*(table.column(c).to_pylist() for c in ("key", "n", "tokens")), strict=True):
            if key in chosen:
                continue
            tokens, leader = _sorted_tokens(blob), None
            # Leaders come by size, so the first that is too small ends the search.
            for other, m, theirs in reversed(leaders):
                if percent * n > 100 * m:
                    break
                if _links(tokens, n, theirs, m, percent):
                    leader = other
                    break
            if leader is None:
                leaders.append((key, n, tokens))
            chosen[key] = key if leader is None else leader
        return pa.table({"key": pa.array(list(chosen), pa.int64()), "leader": pa.array(list(chosen.values()), pa.int64())})

    return run


def _prefixes(percent: int, some: int | None):
    """Shingles of which a partner must hold one: as many of a set's first as may be missing, and one (at most ``some``).

    ``total`` counts the shingles from the first on; those that no other document holds come before all.
    """

    def run(batches):
        for batch in batches:
            first, total = [], []
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                tokens = np.frombuffer(blob.as_buffer(), np.int64)
                first.append(tokens[: max(0, len(tokens) - -(-percent * n // 100) + 1)][:some])
                total.append(len(tokens))
            ends = np.concatenate(([0], np.cumsum([len(f) for f in first]))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(total, pa.int64()), prefix], names=["key", "n", "total", "prefix"])

    return run


def _opened(percent: int):
    """The links of one part of a cell: its queries (with their class) and its members (without)."""

    def run(key, table):
        rows = list(zip(*(table.column(c).to_pylist() for c in ("class", "n", "tokens")), strict=True))
        texts = [(n, _sorted_tokens(t)) for c, n, t in rows if c is None]
        union = np.unique(np.concatenate([t for _, t in texts])) if texts else np.zeros(0, np.uint64)
        found = set()
        for c, n, blob in rows:
            if c is None or c in found:
                continue
            tokens = _sorted_tokens(blob)
            if 100 * _common(tokens, union) >= percent * n and any(_links(tokens, n, theirs, m, percent) for m, theirs in texts):
                found.add(c)
        return pa.table({"a": pa.array(sorted(found), pa.int64()), "b": pa.array([key[0].as_py()] * len(found), pa.int64())})

    return run


def _salted(rows: DataFrame, by: list[str], size: int, salt: int = 0) -> DataFrame:
    """``rows`` with a ``part`` that cuts each value of ``by`` into parts of about ``size`` rows."""
    large = stored(rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("pieces")).filter("pieces > 1"), "large")
    return rows.join(large, by, "left").withColumn("part", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("key", F.lit("part"), F.lit(salt)), "pieces")))


def _classes(sets: DataFrame, percent: int) -> DataFrame:
    """``key`` and ``class`` of every set; those in a class are linked through leaders.

    Sets of one ``least`` that are cut into parts have leaders in each. The leaders meet again, in other parts, until
    one part is left or few of them merge.
    """
    lead = lambda rows, salt: _salted(rows, ["least"], PART, salt).groupBy("least", "part").applyInArrow(_leaders(percent), "key long, leader long")
    classes = stored(lead(sets, 0).select("key", F.col("leader").alias("class")), "classes")
    large = stored(sets.groupBy("least").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("least"), "cut")
    if large.isEmpty():
        return classes
    heads = stored(sets.join(large, "least", "left_semi").join(classes.filter("key = class").select("key"), "key", "left_semi").dropDuplicates(["key"]), "leaders")
    count = heads.count()
    for salt in range(1, ROUNDS):
        if not count:
            break
        merged = stored(lead(heads, salt).filter("key <> leader").select(F.col("key").alias("class"), "leader"), "merged")
        few = merged.count() < 0.1 * count
        classes = stored(classes.join(merged, "class", "left").select("key", F.coalesce("leader", "class").alias("class")), "classes")
        heads = heads.join(merged.select(F.col("class").alias("key")), "key", "left_anti")
        large = heads.groupBy("least").agg(F.count("*").alias("n")).filter("n > 1").select("least")
        heads = stored(heads.join(large, "least", "left_semi"), "leaders")
        count = 0 if few else heads.count()
    return classes


def _neighbours_in_columns(matrix: DataFrame) -> DataFrame:
    """Per column and class the next larger class, with its first part, in slices of the column of about ``PART`` classes."""
    cells = matrix.groupBy("token", "cell").agg(F.min_by(F.struct("part", "least_n", "most_n", "most_rest"), "part").alias("of"))
    pieces = stored(cells.groupBy("token").agg(F.ceil(F.count("*") / PART).alias("pieces")).filter("pieces > 1"), "large")
    cells = cells.join(pieces, "token", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("cell.class", F.lit("slice")), "pieces"), F.lit(0)))
    after = lambda name: F.lead(name).over(Window.partitionBy("token", "piece").orderBy("cell"))
    return cells.select("token", F.col("cell").alias("class"), after("cell").alias("cell"), after("of").alias("of")).filter("cell IS NOT NULL").select("token", "class", "cell", "of.*")


def _links_between(sets: DataFrame, classes: DataFrame, percent: int, some: int | None) -> DataFrame:
    """Links ``a``, ``b`` between classes.

    ``some`` limits the queries of a class per column and the columns of a set, and a class then asks only the next class of a column.
    """
    sizes = classes.groupBy("class").agg(F.count("*").alias("size"))
    member = _salted(classes.join(sizes, "class"), ["class"], MEMBERS)
    member = stored(member.select("key", F.struct("size", "class").alias("class"), "part"), "members")
    # Only shingles are shuffled to the classes; how many follow each is told by its place.
    prefixes = sets.mapInArrow(_prefixes(percent, some), "key long, n long, total long, prefix array<long>")
    cells = prefixes.join(member, "key").select("key", "n", "class", "part", "total", F.posexplode("prefix").alias("at", "token"))
    cells = cells.select("key", "n", "class", "part", "token", (F.col("total") - F.col("at")).alias("rest"))
    if some is not None:
        place = F.row_number().over(Window.partitionBy("token", "class").orderBy("key"))
        cells = cells.withColumn("place", place).filter(F.col("place") <= some).drop("place")
    # Cells of a column meet once, to see whether it belongs to several classes.
    column = Window.partitionBy("token")
    spread = cells.withColumns({"low": F.min("class.class").over(column), "high": F.max("class.class").over(column)}).filter("low < high")
    cells = stored(spread.drop("low", "high"), "cells")
    if cells.isEmpty():
        return classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    matrix = cells.groupBy("token", F.col("class").alias("cell"), "part").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("most_rest"))
    # A link has common >= percent / (100 + percent) of both sizes, none of it before the first common column.
    fits = F.expr(f"class < cell AND {percent} * n <= 100 * most_n AND {percent} * least_n <= 100 * n AND {100 + percent} * least(rest, most_rest) >= {percent} * (n + least_n)")
    asking = cells.select("token", "rest", "key", "n", "class")
    asked = (asking.join(matrix, "token") if some is None else asking.join(_neighbours_in_columns(matrix), ["token", "class"])).filter(fits)
    asked = stored(asked.select("key", F.col("class.class").alias("class"), F.col("cell.class").alias("cell"), "part").distinct(), "queries")
    # Many queries of a cell are cut into pieces, each with all members of the cell.
    pieces = stored(asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("pieces")), "parts")
    queries = asked.join(pieces, ["cell", "part"]).select("key", "class", "cell", "part", F.pmod(F.xxhash64("key"), "pieces").alias("piece"))
    held = member if some is None else member.join(cells.select("key").distinct(), "key", "left_semi")
    held = held.select("key", F.col("class.class").alias("cell"), "part").join(pieces, ["cell", "part"]).select(
        "key", F.lit(None).cast("long").alias("class"), "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"),
    )
    wanted = stored(queries.union(held), "opened")
    # Most sets are in no opened group. Their keys are sent to the sets up to a size, so that only sets in groups are shuffled.
    keys = stored(wanted.select("key").distinct(), "wanted")
    rows = sets.select("key", "n", "tokens")
    rows = rows.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= SENT_KEYS else rows
    return rows.join(wanted, "key").groupBy("cell", "part", "piece").applyInArrow(_opened(percent), "a long, b long")


def _joined(classes: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """``classes`` with the smallest class that links reach, and how many classes that makes less."""
    links = stored(links, "links")
    if links.isEmpty():
        return classes, 0
    found = stored(components(links).select(F.col("id").alias("class"), "component").filter("class <> component"), "found")
    return stored(classes.join(found, "class", "left").select("key", F.coalesce("component", "class").alias("class")), "joined"), found.count()


def _chains(copies: DataFrame, classes: DataFrame) -> DataFrame:
    """``id`` and ``component`` of the keys and classes that repeated rows join, from ``key`` and its ``copy_of``.

    Most copies hang on one key that is no copy, which needs no edge; left are those of several keys and those with
    copies of their own.
    """
    copies = copies.distinct()
    several = copies.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    targets = copies.select(F.col("copy_of").alias("key")).distinct()
    edges = copies.join(several.union(targets).distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.col("copy_of").alias("b"))
    edges = stored(edges, "chains")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    ends = edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct()
    return components(edges.union(classes.join(ends, "key", "left_semi").select("key", "class")))


def _rooted(slim: DataFrame, width: int, percent: int) -> DataFrame:
    """``key``, ``id``, ``n`` and ``root`` of every ``id``, ``text``, ``key`` row; rows of a component have one root. Null ids have none."""
    buckets = B.parts(slim, B.text_bytes(slim), B.BUCKET_BYTES)
    answers = (
        slim.mapInArrow(_hashes_to_buckets(width, buckets), "bucket long, block long, blob binary")
        .groupBy("bucket").applyInArrow(_bucket_answers, "block long, bucket long, blob binary")
    )
    kept = slim.mapInArrow(_blocks_kept, "block long, blob binary")
    rows = stored(kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_candidates(width, percent, buckets), SETS), "sets")

    sets = rows.filter("tokens IS NOT NULL").select("key", "n", "tokens", "least")
    classes = _classes(sets, percent)
    for _ in range(ROUNDS):
        before = classes.select("class").distinct().count()
        classes, less = _joined(classes, _links_between(sets, classes, percent, FIRST))
        if less < 0.05 * before:
            break
    classes, _ = _joined(classes, _links_between(sets, classes, percent, None))

    # From rows to copies in their block, to classes and along chains of copies.
    chains = _chains(rows.filter("copy_of IS NOT NULL").select("key", "copy_of"), classes)
    placed = rows.select("key", "id", "n", F.coalesce("copy_of", "key").alias("of"))
    placed = answered(placed, classes.withColumnRenamed("key", "of"), "of", "id")
    placed = stored(placed.select("key", "id", "n", F.coalesce("class", "of").alias("of")), "placed")
    placed = answered(placed, chains.withColumnRenamed("id", "of"), "of", "id")
    return stored(placed.select("key", "id", "n", F.coalesce("component", "of").alias("root")), "rooted")


def _row_key(id: Column, text: Column) -> Column:
    return F.xxhash64(id, text).alias("key")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, of every row."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).select("id", "text", _row_key(F.col("id"), F.col("text")))
    rooted = _rooted(slim, width, percent)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = answered(rooted, least, "root", "id").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    alone = slim.filter("id IS NULL").mapInArrow(_set_sizes(width), "doc_id long, n_shingles long, component_id long")
    return found.union(alone)


def _set_sizes(width: int):
    def run(batches):
        for block in B.blocks(batches, size=BLOCK_BYTES):
            _, first = shingle_sets(block.column("text"), width)
            nothing = pa.nulls(block.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array(np.diff(first)), nothing], names=["doc_id", "n_shingles", "component_id"])

    return run


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of every component, with all its columns: that with the smallest id, of those the one whose text has the smallest hash.

    Rows count, not ids: another text under the same id is a document of its own. A null id comes after all others. Of
    rows that agree in id and text one stays.
    """
    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    given = F.coalesce(column(id).cast("long"), F.lit(LAST))
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), given.alias("id"), column(text).alias("text")).select("row", "id", "text", _row_key(F.col("id"), F.col("text")))
    rooted = _rooted(rows.select("id", "text", "key"), width, percent)
    times = rooted.groupBy("root", "id", "key").agg(F.count("*").alias("times"))
    first = rooted.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    marked = answered(stored(times, "times"), first, "root", "key").select("id", "key", (F.struct("id", "key") != F.col("first")).alias("gone"), "times")
    # A row can be in the table under one root only, since equal rows have one key.
    marked = stored(marked.filter("gone OR times > 1").select("id", "key", "gone"), "marked")
    # Few rows are marked. Up to a size they are sent to the texts, which are then not shuffled.
    found = rows.join(F.broadcast(marked) if marked.count() <= SENT_KEYS else marked, ["id", "key"], "left")
    kept = found.filter("gone IS NULL").select("row.*")
    if marked.filter("NOT gone").isEmpty():
        return kept
    again = found.filter("NOT gone").groupBy("id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.union(again.select("row.*"))
