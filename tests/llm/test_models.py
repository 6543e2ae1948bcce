import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import language, quality, sampling, toxicity
from gaugeworks.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "123 !!! — «» ×"), (None, "the and of that"), (5, "Привет мир"), (6, "É"), (7, "the the"), (7, "the the"), (8, "x" * 300_000), (9, "the of\n" * 20_000)]


def odd_frame(spark):
    return spark.createDataFrame([(i, t, 1, "s", [1.0]) for i, t in ODD], "doc_id long, text string, id int, score string, values array<double>").repartition(2)


def held_out(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


# Language

@pytest.fixture(scope="module")
def languages(spark):
    return language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_language_of_held_out_texts(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_id"](spark, DATA).collect()
    assert len(rows) == len(docs) and all(r.held_out == (held_out(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in tested]) > 0.98


def test_language_spans_and_odd_texts(spark, languages):
    mixed = "The of and that is on the\nDer und die schung enge keit zu ver\nthe and of in"
    (row,) = language.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), languages).collect()
    assert (row.lang, row.starts, row.ends, row.langs) == ("en", [0, 7, 15], [7, 15, 19], ["en", "de", "en"])
    got = {(r.id, r.lang, round(r.score, 3)) for r in language.label(odd_frame(spark), languages).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (6, "fr", 1.0), (5, "de", 0.0)} <= got
    assert sorted((r.id or 0) for r in language.label(odd_frame(spark), languages).collect()) == sorted((i or 0) for i, _ in ODD)
    assert language.label(odd_frame(spark).limit(0), languages).count() == 0


def test_scripts_narrow_languages(spark):
    docs = spark.createDataFrame([(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en"), (3, "γεια σου κοσμε", "el")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.id: r.lang for r in language.label(spark.createDataFrame([(1, "дом и сад"), (2, "cat on mat"), (3, "ουρανος")], "doc_id long, text string"), model).collect()}
    assert got == {1: "ru", 2: "en", 3: "el"}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    label = language._viterbi(scores, first, 0.7)
    for a, b in itertools.pairwise(first):
        paths = itertools.product(range(3), repeat=int(b - a))
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) - 0.7 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(label[a:b]) == max(paths, key=value)


def test_fitting_needs_labels(spark):
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    for module in (quality, toxicity):
        with pytest.raises(ValueError):
            module.fit(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, label int"))


def test_samples_are_bounded(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 1 WHEN id % 10 = 1 THEN NULL ELSE 0 END AS label")
    counts = dict(sampling.bounded(rows, "label", "doc_id", 500).groupBy("label").count().collect())
    assert set(counts) == {0, 1} and all(400 < n < 600 for n in counts.values())


# Quality

def test_quality_of_held_out_texts(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = QUERIES["op7_line_quality"](spark, DATA).collect()
    assert all(r.held_out == (held_out(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([r.predicted == labels[r.doc_id] for r in tested]) > 0.95


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(2)
    first, unary, steps = np.array([0, 3, 3, 4, 9]), rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs = quality.marginals(unary, first, steps)
    expected = np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        paths = list(itertools.product((0, 1), repeat=int(b - a)))
        weight = np.array([np.exp(sum(unary[a + i] * s for i, s in enumerate(p)) + sum(steps[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        weight /= weight.sum()
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for w, p in zip(weight, paths, strict=True) if p[i]))
        for w, p in zip(weight, paths, strict=True):
            for x, y in itertools.pairwise(p):
                expected[x, y] += w
    assert pairs == pytest.approx(expected)


def test_line_features():
    text = pa.array(["Aa bb bb.\n\nONE TWO!!\nONE TWO!!", "", "12 x"], pa.large_string())
    values, size, first = quality.line_features(text)
    named = [dict(zip(quality.FEATURES, row, strict=True)) for row in values]
    assert first.tolist() == [0, 3, 3, 4] and size.tolist() == [10, 10, 9, 4]
    assert named[0]["repeated word"] == 0 and named[0]["sentence end"] == 1 and named[0]["capitals"] == pytest.approx(1 / 6)
    assert named[1]["capitals"] == 1 and named[1]["signs at word end"] == 0.5 and named[1]["repeated line"] == 0 and named[2]["repeated line"] == 1
    assert named[3]["digits"] == 0.5 and named[3]["wordless"] == 0.5


def test_quality_of_odd_texts(spark):
    rng = np.random.default_rng(0)
    clean = [(i, "\n".join(" ".join(rng.choice(["this", "is", "a", "fine", "line"], 8)) + "." for _ in range(5)), 1) for i in range(60)]
    junk = [(100 + i, "\n".join("buy!! " * 6 + str(n) for n in range(5)), 0) for i in range(60)]
    model = quality.fit(spark.createDataFrame(clean + junk + [(500, None, 0), (501, "x", None), (502, "y", 7)], "doc_id long, text string, label int"))
    got = [(r.id, r.score, len(r.lines)) for r in quality.score(odd_frame(spark), model).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s, _ in got) and {(i, n) for i, _, n in got if i in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    scores = {r.id: r.score for r in quality.score(spark.createDataFrame([(1, clean[0][1]), (2, junk[0][1])], "doc_id long, text string"), model).collect()}
    assert scores[1] > 0.9 > 0.1 > scores[2]
    assert quality.score(odd_frame(spark).limit(0), model).count() == 0


# Toxicity

def test_toxicity_of_held_out_texts(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, DATA).collect()
    assert all(r.held_out == (held_out(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([r.predicted == labels[r.doc_id] for r in tested]) > 0.9


def test_toxic_words_hidden_words_and_odd_texts(spark):
    rng = np.random.default_rng(0)
    say = lambda n: list(rng.choice(["this", "house", "green", "walk", "river", "stone", "light"], n))
    rows = []
    for i in range(240):
        words = say(30)
        if i % 3 == 0:
            for at in rng.integers(0, 30, 3):
                words[at] = "you " + rng.choice(["stupid", "moron"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), trees=5)
    assert {"stupid", "moron"} <= set(model.entries)
    tested = [(1, " ".join(say(20) + ["you", "stupid", "you", "moron"])), (2, " ".join(say(24))), (3, " ".join(say(20) + ["you", "stup1d", "you", "m0ron"]))]
    found = {r.id: r for r in toxicity.score(spark.createDataFrame(tested, "doc_id long, text string"), model).collect()}
    assert found[1].score > 0.5 > found[2].score and found[3].score > 0.5
    values = dict(zip(toxicity.FEATURES, found[3]["values"], strict=True))
    assert values["hidden entries"] == 2 and values["entries near second person"] > 0
    got = toxicity.score(odd_frame(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd_frame(spark).limit(0), model).count() == 0
    kept = toxicity.accepted(odd_frame(spark), model)
    assert kept.dtypes == odd_frame(spark).dtypes and kept.count() == len([r for r in got if r.score < 0.5])
