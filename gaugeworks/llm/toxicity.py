"""Toxicity from gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a lexicon, how close its entries stand to the second person, and
rates of capitals, punctuation and obfuscation. Lexicon entries are words and word beginnings that
are far more frequent in toxic texts; at most ``LEXICON`` are learned, together with the trees, from about
``SAMPLE`` texts per label. Digits and signs between letters are read as the letters they stand for.
Their probability is calibrated on texts that neither lexicon nor trees saw: each half of the sample is judged by a
lexicon and trees of the other half, and one isotonic curve is fitted to both.

Defined cases: a null or empty text has features of 0 and the score that the trees give those; a null
id is carried; repeated rows are scored each; an empty table gives an empty result. Fitting needs both
labels. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import blocks as B
from gaugeworks.llm.components import stored
from gaugeworks.llm.sampling import bounded

SAMPLE = 3000
LEXICON = 2000
# An entry is in this many and this share of the toxic texts at least, and this many times as often in toxic texts.
LEAST_TEXTS = 4
LEAST_SHARE = 0.01
LEAST_RATIO = 8.0
NEAR = 5
# Features take many arrays as long as the text, so blocks are smaller than elsewhere.
BLOCK_BYTES = 1 << 20
BEGINNINGS = (4, 5, 6)
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch euer tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros".split()
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "u"}


@dataclass
class Model:
    lexicon: list[tuple[int, float]]
    entries: list[str]
    trees: Any
    curve: Any


@dataclass
class _Tokens:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    capital: np.ndarray
    hidden: np.ndarray
    offsets: np.ndarray


def _tokens(text: pa.Array) -> _Tokens:
    data, offsets = B.buffer(text)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    upper = (data >= 65) & (data <= 90)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & ~edge[1:-1]
    low = np.where(upper, data + np.uint8(32), data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    table = np.zeros(256, np.uint8)
    for sign, meant in STANDS_FOR.items():
        table[ord(sign)] = ord(meant)
    meant = table[data]
    hidden = meant > 0
    hidden[:1] = hidden[-1:] = False
    hidden[1:-1] &= letter[:-2] & letter[2:] & ~edge[1:-2] & ~edge[2:-1]
    low = np.where(hidden, meant, low)
    letter |= hidden
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    starts = np.flatnonzero(letter & (before | edge[:-1]))
    ends = np.flatnonzero(letter & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return _Tokens(low, starts, ends, np.repeat(np.arange(len(text)), np.diff(first)), upper, hidden, offsets)


def _entries(tokens: _Tokens):
    """Hashes of whole words and of word beginnings (0 where a word is no longer than that), with the ends."""
    for length in (0, *BEGINNINGS):
        ends = tokens.ends if not length else np.minimum(tokens.starts + length, tokens.ends)
        hashes = B.mix(B.word_hashes(tokens.data, tokens.starts, ends), length)
        yield np.where(tokens.ends - tokens.starts > length, hashes, np.uint64(0)), ends


def _texts_with(batches):
    """Of each entry in a block: in how many toxic and other texts it is."""
    for block in B.blocks(batches):
        tokens = _tokens(block.column("text"))
        toxic = np.asarray(block.column("label")) == 1
        for hashes, ends in _entries(tokens):
            order = np.argsort(hashes)
            order = order[hashes[order] != 0]
            order = order[np.lexsort((tokens.doc[order], hashes[order]))]
            if not len(order):
                continue
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(tokens.doc[order]) != 0)
            order = order[new]
            heads = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
            mine = toxic[tokens.doc[order]]
            yes, no = (np.add.reduceat(m.astype(np.int64), heads) for m in (mine, ~mine))
            at = order[heads]
            names = [tokens.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(tokens.starts[at], ends[at], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(names, pa.string()), pa.array(yes), pa.array(no)], names=["hash", "entry", "toxic", "other"])


FEATURES = (
    "entries", "entry density", "weight density", "largest weight", "distinct entries", "entries near second person", "second person", "capitals",
    "words in capitals", "exclamation marks", "question marks", "signs", "hidden letters", "hidden entries", "stretched letters", "words",
)


def _features(lexicon: list[tuple[int, float]]):
    keys = np.array([h for h, _ in lexicon], np.int64).view(np.uint64)
    weights = np.array([w for _, w in lexicon])
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    people = [w.encode() for w in SECOND_PERSON]

    def run(batches):
        joined = np.frombuffer(b"".join(people), np.uint8)
        ends = np.cumsum([len(p) for p in people])
        second = np.sort(B.word_hashes(joined, np.concatenate(([0], ends[:-1])), ends))
        for block in B.blocks(batches, size=BLOCK_BYTES):
            t = _tokens(block.column("text"))
            count, n = block.num_rows, len(t.starts)
            weight = np.zeros(n)
            entry = np.zeros(n, np.uint64)
            person = np.zeros(n, bool)
            for i, (hashes, _) in enumerate(_entries(t)):
                if not i:
                    plain = B.word_hashes(t.data, t.starts, t.ends)
                    person = second[np.minimum(np.searchsorted(second, plain), len(second) - 1)] == plain
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    better = (keys[at] == hashes) & (weights[at] > weight)
                    weight[better] = weights[at][better]
                    entry[better] = hashes[better]
            hit = np.flatnonzero(weight > 0)
            who = np.flatnonzero(person)
            near = np.zeros(len(hit), bool)
            for side in ("left", "right"):
                k = np.searchsorted(who, hit, side) - (side == "left")
                k = np.clip(k, 0, max(len(who) - 1, 0))
                if len(who):
                    near |= (np.abs(who[k] - hit) <= NEAR) & (t.doc[who[k]] == t.doc[hit])
            per = lambda index, w=None: np.bincount(index, w, count)  # noqa: E731, B023
            byte_doc = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[t.offsets])  # noqa: E731, B023
            raw, _ = B.buffer(block.column("text"))
            words = np.maximum(per(t.doc), 1)
            letters = np.maximum(byte_doc(((t.data >= 97) & (t.data <= 122)) | (t.data >= 0xC3)), 1)
            inside = np.concatenate(([0], np.cumsum(t.hidden)))
            caps = np.concatenate(([0], np.cumsum(t.capital)))
            covered = np.concatenate(([0], np.cumsum((t.data < 0x80) | (t.data >= 0xC3))))
            hidden = inside[t.ends] > inside[t.starts]
            shouted = (caps[t.ends] - caps[t.starts] == covered[t.ends] - covered[t.starts]) & (t.ends - t.starts > 2)
            stretched = np.zeros(len(raw), bool)
            stretched[2:] = (t.data[2:] == t.data[1:-1]) & (t.data[2:] == t.data[:-2]) & (t.data[2:] >= 97)
            sign = (raw > 32) & (raw < 127) & ~(((raw | 32) >= 97) & ((raw | 32) <= 122)) & ~((raw >= 48) & (raw <= 57))
            _, one = np.unique(np.stack((t.doc[hit].astype(np.uint64), entry[hit])), axis=1, return_index=True) if len(hit) else (None, hit)
            largest = np.zeros(count)
            np.maximum.at(largest, t.doc[hit], weight[hit])
            size = np.maximum(np.diff(t.offsets), 1)
            columns = [
                np.log1p(per(t.doc[hit])), per(t.doc[hit]) / words, per(t.doc[hit], weight[hit]) / words, largest, np.log1p(per(t.doc[hit][one])),
                np.log1p(per(t.doc[hit[near]])), per(t.doc[who]) / words, byte_doc(t.capital) / letters, per(t.doc[shouted]) / words,
                byte_doc(raw == 33) / size, byte_doc(raw == 63) / size, byte_doc(sign) / size, byte_doc(t.hidden) / size,
                per(t.doc[hit[hidden[hit]]]), byte_doc(stretched) / size, np.log1p(per(t.doc)),
            ]
            values = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(columns, 1).ravel()), len(columns)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([c for c, name in zip(block.columns, block.schema.names, strict=True) if name != "text"] + [values], names=[n for n in block.schema.names if n != "text"] + ["values"])

    return run


def _learned(texts: DataFrame, trees: int, depth: int) -> tuple[list, Any]:
    """The lexicon (hash, entry, weight) of the texts and trees over their features; None with one label only."""
    sizes = dict(texts.groupBy("label").count().collect())
    if set(sizes) != {0, 1}:
        return [], None
    rate = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("other") + 0.5) / (sizes[0] + 1))
    least = max(LEAST_TEXTS, LEAST_SHARE * sizes[1])
    found = (
        texts.mapInArrow(_texts_with, "hash long, entry string, toxic long, other long").groupBy("hash")
        .agg(F.min("entry").alias("entry"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .withColumn("weight", rate).filter((F.col("toxic") >= least) & (F.col("weight") >= float(np.log(LEAST_RATIO))))
        .orderBy((F.col("weight") * F.col("toxic")).desc(), "hash").limit(LEXICON).select("hash", "entry", "weight").collect()
    )
    classifier = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1)
    return found, classifier.fit(_with_features(texts, found).select("label", "features"))


def _with_features(texts: DataFrame, lexicon: list) -> DataFrame:
    values = stored(texts.mapInArrow(_features([(r.hash, r.weight) for r in lexicon]), "id long, label int, values array<double>"), "features")
    return values.coalesce(4).withColumn("features", array_to_vector("values"))


def fit(docs: DataFrame, label: str = "label", text: str = "text", id: str = "doc_id", sample: int = SAMPLE, trees: int = 20, depth: int = 4) -> Model:
    """Fit on about ``sample`` texts of each label 0 and 1; rows with another or no label are left out."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(text).alias("text")).filter("label IN (0, 1)")
    chosen = stored(bounded(rows, "label", "id", sample), "labelled")
    lexicon, model = _learned(chosen, trees, depth)
    if model is None:
        raise ValueError("both labels are needed")
    half = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(2))
    judged = None
    for held in range(2):
        theirs, judge = _learned(chosen.filter(half != held), trees, depth)
        if judge is not None:
            rest = judge.transform(_with_features(chosen.filter(half == held), theirs))
            rest = rest.select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("margin"))
            judged = rest if judged is None else judged.union(rest)
    curve = IsotonicRegression(labelCol="label", featuresCol="margin").fit(judged) if judged is not None and judged.select("label").distinct().count() == 2 else None
    return Model([(r.hash, r.weight) for r in lexicon], [r.entry for r in lexicon], model, curve)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with a column ``values``, with ``margin`` and ``score`` added."""
    kept = rows.columns
    found = model.trees.transform(rows.withColumn("features", array_to_vector("values"))).withColumn("margin", vector_to_array("probability")[1])
    if model.curve is None:
        return found.select(*kept, "margin", F.col("margin").alias("score"))
    return model.curve.setPredictionCol("score").transform(found.select(*kept, "margin"))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``score`` (calibrated), ``margin`` (of the trees) and the ``values`` of ``FEATURES`` of every row."""
    B.small_batches(docs.sparkSession)
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = slim.mapInArrow(_features(model.lexicon), "id long, values array<double>")
    return _scored(rows, model).select("id", "score", "margin", "values")


def accepted(docs: DataFrame, model: Model, below: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is lower than ``below``.

    Only texts go to Python and only features come back; the rows wait in the JVM.
    """
    B.small_batches(docs.sparkSession)
    features = _features(model.lexicon)

    @F.arrow_udf("array<double>")
    def values(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [b.column("values") for b in features(iter([pa.RecordBatch.from_arrays([column], names=["text"])]))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("values", values(F.col("row")[text]))
    return _scored(rows, model).filter(F.col("score") < below).select("row.*")
