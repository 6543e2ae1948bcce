"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a label, good or bad. Its score comes from features of the line and of both
neighbouring lines, and neighbouring labels have weights of their own. Forward-backward marginals of "good",
weighted by line length, give the good share of a text; a logistic curve turns it into the probability
of label 1.

Only documents are labelled, so ``fit`` starts from lines with their document's label, moves lines that a
line model finds good out of the bad ones, and then trains the field on those labels. It takes
about ``SAMPLE`` documents per label.

Defined cases: a null, empty or blank text has no lines and a good share of 0; a null id is carried; repeated
rows are scored each; an empty table gives an empty result. Fitting needs both labels. Other columns
play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import blocks as B
from gaugeworks.llm.sampling import bounded

SAMPLE = 1500
FEATURES = (
    "words", "word length", "letters", "capitals", "digits", "signs", "wordless", "repeated word", "distinct words",
    "signs at word end", "sentence end", "repeated line", "length",
)
SCORED = "id long, score double, good_share double, lines array<double>"


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    slope: float
    level: float


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that have a word, their bytes, and where each text's lines begin."""
    data, offsets = B.buffer(text)
    starts, ends, _ = B.word_spans(data, offsets)
    cuts = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
    of_word = np.searchsorted(cuts, starts, "right") - 1
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(starts)), bool), np.diff(of_word) != 0)))
    line = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(starts))))
    a = cuts[of_word[head]]
    b = np.append(cuts, len(data))[of_word[head] + 1]
    first = np.searchsorted(a, offsets)
    first[-1] = len(head)

    def total(mask):
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[b] - sums[a], sums

    upper = (data >= 65) & (data <= 90)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0)
    digit = (data >= 48) & (data <= 57)
    sign = (data > 32) & (data < 127) & ~letter & ~digit
    letters, letter_sums = total(letter)
    words = np.bincount(line, minlength=len(head))
    hashes = B.word_hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.argsort(hashes)
    order = order[np.argsort(line[order], kind="stable")]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(hashes[order]) != 0) | (np.diff(line[order]) != 0)
    tail = sign[ends - 1] & sign[np.maximum(ends - 2, starts)] & (ends - starts > 1)
    last = ends[np.append(head[1:], len(starts)) - 1] - 1 if len(head) else head
    with np.errstate(over="ignore"):
        body = np.add.reduceat(B.mix(hashes + (np.arange(len(starts)) - head[line]).astype(np.uint64)), head) if len(head) else hashes
    same = np.zeros(len(head), bool)
    same[1:] = body[1:] == body[:-1]
    size = np.maximum(b - a, 1)
    of = lambda mask: np.bincount(line, mask, len(head)) / words
    columns = [
        np.log1p(words), np.bincount(line, ends - starts, len(head)) / words, letters / size, total(upper)[0] / np.maximum(letters, 1),
        total(digit)[0] / size, total(sign)[0] / size, of(letter_sums[ends] == letter_sums[starts]), of(again),
        np.bincount(line[order], fresh, len(head)) / words, of(tail), np.isin(data[last], (33, 46, 63)) if len(head) else head, same, np.log1p(size),
    ]
    return np.stack(columns, 1).astype(np.float32), (b - a).astype(np.float64), first


def _with_neighbours(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after in its text, and whether those exist."""
    n = len(values)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.zeros(n, bool)
    before[1:] = doc[1:] == doc[:-1]
    after = np.append(before[1:], False)[:n]
    up, down = np.zeros_like(values), np.zeros_like(values)
    up[1:] = values[:-1]
    down[:-1] = values[1:]
    return np.concatenate((values, up * before[:, None], down * after[:, None], before[:, None], after[:, None], np.ones((n, 1))), 1)


def marginals(unary: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" for every line, and the expected count of each pair of neighbouring labels.

    ``unary`` is the score of good over bad, ``steps[i, j]`` that of label j after i. Texts are worked
    through side by side, the longest first.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, left = first[:-1][order], counts[order]
    active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    weights = np.exp(steps)
    score = np.stack((np.zeros(len(unary)), unary), 1)
    score = np.exp(score - score.max(1, keepdims=True))
    forward, backward = np.zeros((len(unary), 2)), np.ones((len(unary), 2))
    for t, k in enumerate(active):
        at = begin[:k] + t
        now = score[at] if not t else (forward[at - 1] @ weights) * score[at]
        forward[at] = now / now.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        ahead = score[at + 1] * backward[at + 1]
        now = ahead @ weights.T
        both = forward[at][:, :, None] * weights[None] * ahead[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        backward[at] = now / now.sum(1, keepdims=True)
    product = forward * backward
    return product[:, 1] / np.maximum(product.sum(1), 1e-300), pairs


def _ascent(gradient, size: int, rounds: int, rate: float = 0.1) -> np.ndarray:
    """Adam steps along ``gradient``."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return x


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _share(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(doc, good * size, len(first) - 1) / np.maximum(np.bincount(doc, size, len(first) - 1), 1)


def train(values: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """Fit on lines of labelled texts."""
    mean, scale = values.mean(0), values.std(0) + 1e-3
    x = _with_neighbours((values - mean) / scale, first)
    doc = np.repeat(label, np.diff(first)).astype(float)
    alone = np.concatenate(((values - mean) / scale, np.ones((len(values), 1))), 1)
    # Lines weigh alike under both labels, or the rarer one would be moved away altogether.
    line_label = doc.copy()
    balance = np.where(doc == 1, 0.5 / max(doc.mean(), 1e-6), 0.5 / max(1 - doc.mean(), 1e-6))
    for _ in range(3):
        w = _ascent(lambda w: alone.T @ (balance * (line_label - _logistic(alone @ w))) / len(doc) - 1e-4 * w, alone.shape[1], 200)  # noqa: B023
        found = _logistic(alone @ w)
        line_label = np.where(doc == 1, 1.0, (found > 0.5).astype(float))
        # A bad text keeps its worst line bad.
        for i in np.flatnonzero((label == 0) & (np.diff(first) > 0)):
            a, b = first[i], first[i + 1]
            if line_label[a:b].all():
                line_label[a + found[a:b].argmin()] = 0.0
    same_text = np.repeat(np.arange(len(label)), np.diff(first))
    follows = np.flatnonzero(np.diff(same_text) == 0) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_label[follows - 1].astype(int), line_label[follows].astype(int)), 1)
    width = x.shape[1]

    def gradient(p):
        w, steps = p[:width], p[width:].reshape(2, 2)
        good, pairs = marginals(x @ w, first, steps)
        return np.concatenate((x.T @ (line_label - good), (seen - pairs).ravel())) / len(doc) - 1e-4 * p

    p = _ascent(gradient, width + 4, 150)
    w, steps = p[:width], p[width:].reshape(2, 2)
    share = _share(marginals(x @ w, first, steps)[0], size, first)
    curve = np.stack((share, np.ones(len(share))), 1)
    a, b = _ascent(lambda c: curve.T @ (label - _logistic(curve @ c)) / len(label) - 1e-5 * c, 2, 1500, 0.2)
    return Model(mean, scale, w, steps, float(max(a, 0.0)), float(b))


def _collected(batches):
    for block in B.blocks(batches):
        values, size, first = line_features(block.column("text"))
        cut = lambda array, k=1: [array[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), block.column("label").cast(pa.int32()), pa.array(cut(values), pa.binary()), pa.array(cut(size), pa.binary())], names=["id", "label", "values", "size"],
        )


def fit(docs: DataFrame, label: str = "label", text: str = "text", id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` texts of each label 0 and 1; rows with another or no label are left out."""
    rows = docs.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"), F.col(text).alias("text")).filter("label IN (0, 1)")
    found = bounded(rows, "label", "id", sample).mapInArrow(_collected, "id long, label int, values binary, size binary").toPandas().sort_values("id")
    labels = found.label.to_numpy()
    if set(labels) != {0, 1}:
        raise ValueError("both labels are needed")
    size = [np.frombuffer(s, np.float64) for s in found["size"]]
    values = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, len(FEATURES)) for v in found["values"]])
    first = np.concatenate(([0], np.cumsum([len(s) for s in size])))
    return train(values.astype(float), np.concatenate(size), first, labels)


def _scored(model: Model):
    def run(batches):
        for block in B.blocks(batches):
            values, size, first = line_features(block.column("text"))
            good, _ = marginals(_with_neighbours((values - model.mean) / model.scale, first) @ model.weights, first, model.steps)
            share = _share(good, size, first)
            lines = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(_logistic(model.slope * share + model.level)), pa.array(share), lines], names=["id", "score", "good_share", "lines"])

    return run


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``score``, ``good_share`` and the marginals of ``lines`` (those with a word) of every row."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(_scored(model), SCORED)
