"""Language identification with spans of mixed-language text.

Every word is scored for every language by its letter trigrams and by itself. The script of a word, found
by ranges of code points, leaves only languages whose sample is written in it. A Viterbi search with a
penalty for each change of language labels the words; neighbouring words of one language form a span. The
language with most letters is the text's language and its share of the letters the score.

The tables are learned by ``fit`` from about ``SAMPLE`` texts per language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no spans; with ties the
language first by name wins; letters in a script that no language uses are no evidence (score 0 if there
are no others, language first by name); a null id is carried; repeated rows are labelled each; an empty
table gives an empty result. Fitting needs one labelled text at least. Other columns play no part.
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
SWITCH = 8.0
# A script counts as a language's own from this share of its letters on.
SCRIPT_SHARE = 0.02
_CELLS = 1 << 16
LABELLED = "id long, lang string, score double, starts array<int>, ends array<int>, langs array<string>"

# First code points of scripts; a script ends where the next begins. "" holds no letters.
SCRIPTS = (
    (0x00C0, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xE000, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0x20000, "han"), (0x2FA20, ""),
)
NAMES = tuple(dict.fromkeys(["latin", *[n for _, n in SCRIPTS if n]]))


@dataclass
class Model:
    langs: list[str]
    trigrams: np.ndarray
    words: np.ndarray
    allowed: np.ndarray


@dataclass
class _Words:
    """Words with a letter: their texts, places and features."""

    doc: np.ndarray
    place: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    cells: np.ndarray
    first_cell: np.ndarray
    word_cells: np.ndarray


def _features(text: pa.Array) -> _Words:
    data, offsets = B.buffer(text)
    starts, ends, first = B.word_spans(data, offsets)
    upper = (data >= 65) & (data <= 90)
    # Upper-case letters of U+00C0 to U+00DE, whose second byte follows 0xC3.
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(upper, data + np.uint8(32), data)
    ascii_letter = (data >= 97) & (data <= 122)
    lead = np.flatnonzero(data >= 0xC3)
    script = np.zeros(len(starts), np.uint8)
    letter = ascii_letter | (data >= 0xC3)
    if len(lead):
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
        a, b, c, d = (padded[lead + k] for k in range(4))
        point = np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
        names = np.array([255] + [NAMES.index(n) if n else 255 for _, n in SCRIPTS], np.uint8)
        kind = names[np.searchsorted(np.array([s for s, _ in SCRIPTS]), point, "right")]
        letter[lead[kind == 255]] = False
        odd = (kind != 255) & (kind != 0)
        script[np.searchsorted(starts, lead[odd], "right") - 1] = kind[odd]
    at = np.flatnonzero(letter)
    shown = np.where(letter | ((data & 0xC0) == 0x80), data, np.uint8(32)).astype(np.uint32)
    shown = np.concatenate(([np.uint32(32)], shown, [np.uint32(32)]))
    bounds = np.searchsorted(at, np.append(starts, len(data)))
    some = np.flatnonzero(np.diff(bounds) > 0)
    with np.errstate(over="ignore"):
        code = (shown[at] << np.uint32(16) | shown[at + 1] << np.uint32(8) | shown[at + 2]) * np.uint32(0x9E3779B1)
    doc = np.repeat(np.arange(len(text)), np.diff(first))
    words = B.word_hashes(data, starts[some], ends[some])
    return _Words(
        doc[some], some - first[:-1][doc[some]], np.diff(bounds)[some], script[some],
        code >> np.uint32(16), bounds[some], words & np.uint64(_CELLS - 1),
    )


def _count(langs: list[str]):
    def run(batches):
        trigrams = np.zeros((len(langs), _CELLS), np.int64)
        words = np.zeros((len(langs), _CELLS), np.int64)
        scripts = np.zeros((len(langs), len(NAMES)), np.int64)
        for block in B.blocks(batches):
            found = _features(block.column("text"))
            lang = np.array([langs.index(x) for x in block.column("lang").to_pylist()], np.int64)[found.doc]
            of_cell = np.repeat(lang, np.diff(np.append(found.first_cell, len(found.cells))))
            for i in range(len(langs)):
                trigrams[i] += np.bincount(found.cells[of_cell == i], minlength=_CELLS)
                words[i] += np.bincount(found.word_cells[lang == i].astype(np.int64), minlength=_CELLS)
                scripts[i] += np.bincount(found.script[lang == i], found.letters[lang == i], len(NAMES)).astype(np.int64)
        for kind, counts in enumerate((trigrams, words, scripts)):
            i, cell = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[i, cell])],
                names=["kind", "lang", "cell", "count"],
            )

    return run


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Tables of about ``sample`` texts per language; the tables' size depends on the number of languages only."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = bounded(rows, "lang", "id", sample).select("lang", "text")
    langs = sorted(r[0] for r in rows.filter("lang IS NOT NULL").select("lang").distinct().collect())
    if not langs:
        raise ValueError("no labelled text")
    counts = chosen.mapInArrow(_count(langs), "kind int, lang int, cell int, count long").groupBy("kind", "lang", "cell").agg(F.sum("count").alias("count")).toPandas()
    tables = [np.zeros((len(langs), size)) for size in (_CELLS, _CELLS, len(NAMES))]
    for kind, table in enumerate(tables):
        part = counts[counts.kind == kind]
        table[part.lang.to_numpy(), part.cell.to_numpy()] = part["count"].to_numpy()
    trigrams, words, scripts = tables
    smooth = lambda t, a: np.log((t + a) / (t.sum(1, keepdims=True) + a * _CELLS)).T.astype(np.float32)
    return Model(langs, smooth(trigrams, 0.5), smooth(words, 0.5), (scripts >= SCRIPT_SHARE * scripts.sum(1, keepdims=True)).T)


def _viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; texts are worked through side by side, the longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, left = first[:-1][order], counts[order]
    back = np.zeros(scores.shape, np.uint8)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    own = np.arange(scores.shape[1], dtype=np.uint8)
    active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    for t, k in enumerate(active):
        now = value[:k]
        if t:
            best = now.argmax(1)
            jump = now[np.arange(k), best][:, None] - np.float32(switch)
            moved = jump > now
            back[begin[:k] + t] = np.where(moved, best[:, None], own)
            now = np.where(moved, jump, now)
        value[:k] = now + scores[begin[:k] + t]
    label = np.zeros(len(scores), np.uint8)
    state = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        # A text enters the walk at its own last word, with its own best state.
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return label


def _label(model: Model, switch: float):
    langs = np.array(model.langs, object)

    def run(batches):
        size = max(1 << 16, B.BLOCK_BYTES * 4 // max(4, len(langs)))
        for block in B.blocks(batches, size=size):
            found = _features(block.column("text"))
            count = block.num_rows
            if len(found.doc):
                scores = np.add.reduceat(model.trigrams[found.cells], found.first_cell, axis=0) + model.words[found.word_cells]
                scores -= scores.max(1, keepdims=True)
                np.maximum(scores, np.float32(-12), out=scores)
                allowed = model.allowed[found.script]
                known = allowed.any(1)
                scores[~allowed] = -50
                scores[~known] = 0
                first = np.searchsorted(found.doc, np.arange(count + 1))
                label = _viterbi(scores, first, switch)
                weight = np.bincount(found.doc * len(langs) + label, found.letters * known, count * len(langs)).reshape(count, len(langs))
                letters = np.bincount(found.doc, found.letters, count)
                new = np.ones(len(label), bool)
                new[1:] = (np.diff(label) != 0) | (np.diff(found.doc) != 0)
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(label)) - 1
                span = np.searchsorted(found.doc[heads], np.arange(count + 1))
                starts, ends, names = found.place[heads].astype(np.int32), (found.place[tails] + 1).astype(np.int32), langs[label[heads]]
            else:
                weight, letters = np.zeros((count, len(langs))), np.zeros(count)
                span, starts, ends, names = np.zeros(count + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), langs[:0]
            best = weight.argmax(1)
            # Ranges of code points also hold a few signs; the search for a real letter ends at the first.
            for i, body in enumerate(block.column("text").to_pylist()):
                if not any(map(str.isalpha, body)):
                    letters[i] = -1
                    weight[i] = 0
                elif letters[i] == 0:
                    letters[i] = 1
            lang = np.where(letters < 0, "und", langs[best])
            score = weight[np.arange(count), best] / np.maximum(letters, 1)
            offsets = pa.array(span.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                block.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.ListArray.from_arrays(offsets, pa.array(starts)),
                pa.ListArray.from_arrays(offsets, pa.array(ends)), pa.ListArray.from_arrays(offsets, pa.array(names, pa.string())),
            ], names=["id", "lang", "score", "starts", "ends", "langs"])

    return run


def label(docs: DataFrame, model: Model, switch: float = SWITCH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``lang``, ``score`` and the spans (words from ``starts`` up to ``ends``, in ``langs``) of every row."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(_label(model, switch), LABELLED)
