import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.operators import evaluation, quantized, retrieval, sentiment, themes


def test_lexicon_sentiment(spark):
    df = spark.createDataFrame([(1, "Great staff, GREAT room"), (2, "terrible noise"), (3, "the door"), (4, ""), (5, None)], "id long, t string")
    rows = {r["id"]: r for r in sentiment.lexicon_sentiment(df, "t").collect()}
    assert [rows[i]["category"] for i in range(1, 6)] == ["positive", "negative", "neutral", "neutral", "neutral"]
    assert rows[1]["hits"] == 2 and rows[1]["polarity"] == pytest.approx(0.8) and rows[5]["polarity"] == 0.0
    table = spark.createDataFrame([(w, p, s) for w, (p, s) in sentiment.LEXICON.items()], "word string, polarity double, subjectivity double")
    joined = {r["id"]: r for r in sentiment.lexicon_sentiment_table(df, "id", "t", table).collect()}
    for i, r in rows.items():
        assert joined[i]["polarity"] == pytest.approx(r["polarity"]) and joined[i]["category"] == r["category"] and joined[i]["hits"] == r["hits"]


def test_dataset_sentiment_needs_ten(spark):
    df = spark.createDataFrame([("a", "good")] * 12 + [("b", "bad")] * 3, "g string, t string")
    rows = {r["g"]: r for r in sentiment.dataset_sentiment(df, "t", ("g",)).collect()}
    assert rows["a"]["positive"] == 1.0 and rows["b"]["status"] == "insufficient_data" and rows["b"]["negative"] is None


def test_model_sentiment_failing_batch_is_neutral(spark):
    def load():
        def score(texts):
            if any("boom" in t for t in texts):
                raise ValueError("model failed")
            return np.array([[0.1, 0.2, 0.7] if "good" in t else [0.8, 0.1, 0.1] for t in texts])

        return score

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "boom"), (4, None)], "id long, t string").coalesce(1)
    rows = {r["id"]: r for r in sentiment.model_sentiment(df, "id", "t", load, batch=2).collect()}
    assert (rows[1]["category"], rows[1]["score"]) == ("positive", 1.0) and rows[1]["confidence"] == pytest.approx(70)
    assert rows[2]["category"] == "negative" and rows[3]["category"] == "neutral" and rows[3]["confidence"] == 0.0


def test_themes(spark):
    texts = [f"quiet study space near windows number{i}" for i in range(12)] + [f"computer lab printer broken again number{i}" for i in range(12)]
    df = spark.createDataFrame([(i, t, "positive" if i < 12 else "negative") for i, t in enumerate(texts)], "id long, t string, s string")
    found = themes.extract_themes(df, "id", "t", "s", n_themes=2, restarts=3)
    rows = found.table.collect()
    assert found.status == "ok" and sum(r["frequency"] for r in rows) == 24 and sum(r["percentage"] for r in rows) == pytest.approx(100)
    assert {r["frequency"] for r in rows} == {12} and {r["positive"] for r in rows} == {0.0, 1.0}
    assert all(len(r["keywords"]) == 5 and len(r["representative_quotes"]) == 3 for r in rows)
    assert all(r["keywords"][0] in r["representative_quotes"][0] for r in rows)
    assert found.assigned.groupBy("theme_id").count().count() == 2
    assert themes.export_table(found.table).count() == 2 and "Theme" in themes.summary_lines(found.table).first()["summary"]
    assert themes.extract_themes(df.limit(5), "id", "t", n_themes=2).status == "insufficient_data"
    assert themes.extract_themes(df.limit(12), "id", "t", n_themes=13).status == "fewer_responses_than_themes"


def test_quotes_prefer_hundred_characters(spark):
    df = spark.createDataFrame([(1, "Key " + "a" * 96), (2, "key"), (3, "KEY " + "b" * 200), (4, "none"), (5, "key " + "c" * 90)], "id long, t string")
    rows = themes.representative_quotes(df, "id", "t", F.lit("key"), n=2).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 5]


def brute(q, p, k, limit):
    out = {}
    for i, a in enumerate(q):
        d = np.round(((p - a) ** 2).sum(axis=1), 9)
        order = sorted(range(len(p)), key=lambda j: (d[j], j))
        out[i] = [(j, d[j]) for j in order if limit is None or d[j] <= limit][:k]
    return out


@pytest.mark.parametrize("limit", [None, 1.45, 0.3])
@pytest.mark.parametrize("question_bytes", [1 << 20, 0])
def test_nearest_matches_brute_force(spark, limit, question_bytes):
    """A third of the passages are one repeated vector, so one cell and many ties are hot."""
    rng = np.random.default_rng(11)
    p = rng.normal(size=(300, 8))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    p[:100] = p[0]
    q = np.vstack([p[0], rng.normal(size=(20, 8))])
    q[1:] /= np.linalg.norm(q[1:], axis=1, keepdims=True)
    rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    qs = spark.createDataFrame(rows(q), "question_id long, embedding array<double>").repartition(3)
    ps = spark.createDataFrame(rows(p), "passage_id long, embedding array<double>").repartition(5)
    got = retrieval.nearest(qs, ps, 5, limit, question_bytes=question_bytes, chunk_rows=40, block_rows=7).collect()
    want = brute(q, p, 5, limit)
    seen = {}
    for r in sorted(got, key=lambda r: (r["question_id"], r["rank"])):
        seen.setdefault(r["question_id"], []).append((r["passage_id"], r["distance"]))
    assert {i: [j for j, _ in v] for i, v in seen.items()} == {i: [j for j, _ in v] for i, v in want.items() if v}
    for i, v in seen.items():
        assert np.allclose([d for _, d in v], [d for _, d in want[i]], atol=1e-8)


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e9, 1e200])
def test_few_pairs_get_a_distance_and_none_is_lost(monkeypatch, scale):
    """Half of the rows are one vector; some are far longer than the others."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)) * scale
    x[:2000], x[3990:] = x[0], x[3990:] * 1000
    keys = rng.permutation(4000)
    taken = []
    take = retrieval.Nearest._take
    monkeypatch.setattr(retrieval.Nearest, "_take", lambda self, r, *rest: (taken.append(len(r)), take(self, r, *rest)))
    best = retrieval.Nearest(keys, x, 5, None, True)
    for i in range(0, 4000, 1500):
        best.add(keys[i:i + 1500], x[i:i + 1500])
    found = best.found().sort_values(["distance", "_p"])
    # Far below the rounding of distances all are equal, far above single precision all are computed.
    assert scale in (1e-12, 1e200) or sum(taken) < 0.15 * 4000 * 4000
    if scale > 1e100:
        return
    for i in (0, 7, 2500, 3000, 3995):
        d = np.round(((x - x[i]) ** 2).sum(1), 9)
        want = [(int(keys[j]), d[j]) for j in np.lexsort((keys, d)) if j != i][:5]
        got = found[found["_q"] == keys[i]]
        assert got["_p"].tolist() == [j for j, _ in want] and np.allclose(got["distance"], [v for _, v in want], rtol=1e-9)


def test_each_block_of_questions_has_a_task_of_its_own(spark):
    """Nine blocks over the few partitions of a test session would share some."""
    x = np.random.default_rng(3).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    q = rows.where("id < 60").select(F.col("id").alias("_q"), F.col("v").alias("_qv"))
    p = rows.select(F.col("id").alias("_p"), F.col("v").alias("_pv"))
    found = retrieval._by_block(q, p, 5, None, True, 60, 1000, 7)
    blocks = found.select(F.spark_partition_id().alias("task"), F.pmod(F.xxhash64("_q"), F.lit(9)).alias("block")).distinct().collect()
    assert len({r["task"] for r in blocks}) == len({r["block"] for r in blocks}) == len(blocks) > 5
    assert len(set(retrieval._homes(spark, 100))) == 100


@pytest.mark.parametrize("limit", [None, 9.0])
def test_questions_in_many_steps_meet_passages_in_parts(monkeypatch, limit):
    """Each part concerns other questions, so steps are cut unevenly and some see nothing for a while."""
    for name, value in (("STEP", 16), ("FIRST", 4), ("MOST", 11)):
        monkeypatch.setattr(retrieval.Nearest, name, value)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(200, 6)), 1)
    x[50:90] = x[50]
    best = retrieval.Nearest(np.arange(200), x, 5, limit, True)
    middle = np.arange(0, 200, 3)
    for part in np.array_split(rng.permutation(200), 7):
        best.add(part, x[part], middle)
        best.add(part, x[part], np.setdiff1d(np.arange(200), middle))
    found = best.found().sort_values(["_q", "distance", "_p"])
    for i in range(200):
        d = np.round(((x - x[i]) ** 2).sum(1), 9)
        want = [int(j) for j in np.lexsort((np.arange(200), d)) if j != i and (limit is None or d[j] <= limit)][:5]
        assert found[found["_q"] == i]["_p"].tolist() == want


def test_small_cells_share_a_chunk_and_questions_few_blocks():
    first, count = retrieval._dealt(np.array([0, 5, 120, 30, 20, 40]), 50)
    assert count.tolist() == [0, 1, 3, 1, 1, 1] and first[2] == 0 and [int(f) for f in first[[5, 3, 4, 1]]] == [3, 4, 4, 5]
    assert [retrieval.blocks_of(n, retrieval.BLOCK_ROWS, 12) for n in (100, 10_000, 100_000, 600_000)] == [1, 5, 12, 12]


def test_quantised_lists_find_what_the_exact_search_finds(spark):
    """A third of the passages are one vector, so one list is hot and is cut into chunks."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 8))
    p = middles[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 8))
    p[:200] = p[0]
    q = np.vstack([p[0], middles[rng.integers(0, 12, 40)] + 0.3 * rng.normal(size=(40, 8))])
    rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    qs = spark.createDataFrame([*rows(q), (99, None)], "question_id long, embedding array<double>")
    ps = spark.createDataFrame([*rows(p), (9999, None)], "passage_id long, embedding array<double>").repartition(3)
    index = quantized.fit(ps, parts=4)
    codes = quantized.indexed(ps, index)
    assert codes.count() == 600 and 1 <= index.visits <= len(index.centres)
    exact = retrieval.nearest(qs, ps, 5, None)
    found = quantized.nearest(qs, codes, ps, index, 5, None, rerank=250, chunk_rows=30, block_rows=9)
    row = quantized.recall(found, exact).first()
    assert row["n_exact"] == 205 and row["recall"] >= 0.9
    own = {(r["question_id"], r["passage_id"]): r["distance"] for r in found.collect()}
    assert all(abs(d - ((q[a] - p[b]) ** 2).sum()) < 1e-8 for (a, b), d in own.items())
    # All lists and all codes: nothing is lost.
    whole = quantized.nearest(qs, codes, ps, index, 5, None, visits=len(index.centres), rerank=600)
    assert quantized.recall(whole, exact).first()["recall"] == 1.0


def test_confidence(spark):
    qs = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    found = spark.createDataFrame([(1, 1.2), (1, 1.0), (2, None), (2, 9.0)], "question_id long, distance double")
    got = {r["question_id"]: r["confidence"] for r in retrieval.confidence_scores(qs, found).collect()}
    assert got[1] == pytest.approx(0.2413793) and got[2] == 0.25 and got[3] == 0.0


def test_passages_and_contexts(spark):
    survey = spark.createDataFrame([(7, 1, None, "How?", "write me at a@b.com"), (7, 2, None, None, "fine"), (7, 3, None, "x", "")], "dataset_id long, id long, response_date date, question string, response_text string")
    rows = {r["passage_id"]: r for r in retrieval.survey_passages(survey).collect()}
    assert rows["ds7_row1"]["text"] == "Survey question: How?\nPatron feedback response: write me at a@b.com"
    assert rows["ds7_row2"]["text"] == "Patron feedback response: fine" and len(rows) == 2
    metric = spark.createDataFrame([(8, 1, "2024-01-01", "visits", 5.0, "main"), (8, 2, None, None, None, "")], "dataset_id long, id long, date string, metric_name string, metric_value double, category string")
    texts = [r["text"] for r in retrieval.metric_passages(metric).orderBy("passage_id").collect()]
    assert texts == ["visits: 5.0 on 2024-01-01 (Category: main)", "metric: 0 on "]
    assert retrieval.metric_passages(metric, "circulation").orderBy("passage_id").first()["text"] == "Circulation checkout: visits material checked out on 2024-01-01 by main patron"
    passages = retrieval.survey_passages(survey)
    asked = spark.createDataFrame([(1, "what?"), (2, "why?")], "question_id long, question string")
    found = spark.createDataFrame([(1, 1, "ds7_row2", 0.1), (1, 2, "ds7_row1", 0.2)], "question_id long, rank int, passage_id string, distance double")
    full = retrieval.with_passage_text(found, passages)
    got = {r["question_id"]: r for r in retrieval.contexts(asked, full).collect()}
    assert got[1]["context"] == "Source 1: Patron feedback response: fine\n\nSource 2: Survey question: How?\nPatron feedback response: write me at [EMAIL]"
    prompt = retrieval.PROMPT_HEAD + "Relevant data:\n" + got[1]["context"] + "\n\nQuestion: what?\n\n" + retrieval.PROMPT_TAIL
    assert got[1]["estimated_tokens"] == len(prompt) // 4 and got[1]["status"] == "ready" and got[2]["status"] == "no_relevant_data"
    history = spark.createDataFrame([(1, "q", "a" * 20000)], "question_id long, question string, answer string")
    assert {r["status"] for r in retrieval.contexts(asked, full, history).collect()} == {"context_too_large", "no_relevant_data"}
    cited = retrieval.citations(full).first()
    assert cited["n_citations"] == 2 and [c["source_number"] for c in cited["citations"]] == [1, 2]


def test_index_status_and_history(spark):
    datasets = spark.createDataFrame([(1, "pending"), (2, "ready"), (3, None)], "dataset_id long, indexing_status string")
    passages = spark.createDataFrame([(1,), (1,), (2,)], "dataset_id long")
    assert [r["dataset_id"] for r in retrieval.not_indexed(datasets, passages).collect()] == [3]
    assert {r["dataset_id"]: r["indexing_status"] for r in retrieval.sync_status(datasets, passages).collect()} == {1: "completed", 2: "ready", 3: "pending"}
    turns = spark.createDataFrame([(1, i, "u", "x" * 40) for i in range(9)], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in retrieval.recent_turns(turns).collect()) == [4, 5, 6, 7, 8]
    assert retrieval.history_budget(turns).first()["tokens"] == 50


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "study room booking"), (2, "printer is broken"), (3, "")], "id long, text string")
    embedded, model = retrieval.hashed_embedding(df)
    asked, _ = retrieval.hashed_embedding(spark.createDataFrame([(1, "is the printer broken")], "question_id long, text string"), model=model)
    best = retrieval.nearest(asked, embedded.withColumnRenamed("id", "passage_id"), 1).first()
    assert best["passage_id"] == 2
    encoded = retrieval.encode(df, "id", "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=2).collect()
    assert {r["id"]: r["embedding"][0] for r in encoded} == {1: 18.0, 2: 17.0, 3: 0.0}


SCENARIO = st.tuples(st.lists(st.integers(1, 25), unique=True, max_size=20), st.sets(st.integers(1, 25), max_size=8), st.integers(0, 20))


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(SCENARIO, min_size=3, max_size=8), st.integers(0, 6))
def test_retrieval_laws(spark, cases, k):
    found = [(q, i + 1, f"p{p}") for q, (docs, _, _) in enumerate(cases) for i, p in enumerate(docs)]
    known = [(q, f"p{p}") for q, (_, rel, _) in enumerate(cases) for p in rel]
    retrieved = spark.createDataFrame(found, "question_id long, rank int, passage_id string")
    relevant = spark.createDataFrame(known, "question_id long, passage_id string")
    counts = spark.createDataFrame([(q, len(rel)) for q, (_, rel, _) in enumerate(cases)], "question_id long, n_relevant long")
    rows = {r["question_id"]: r for r in evaluation.question_metrics(counts, evaluation.mark_hits(retrieved, relevant), k).collect()}
    for q, (docs, rel, _) in enumerate(cases):
        hits = len({*docs[:k]} & rel)
        first = next((i + 1 for i, p in enumerate(docs[:20]) if p in rel), None)
        assert rows[q]["precision_at_k"] == pytest.approx(hits / k if k else 0.0)
        assert rows[q]["recall_at_k"] == pytest.approx(hits / len(rel) if rel else 0.0)
        assert rows[q]["reciprocal_rank"] == pytest.approx(1 / first if first else 0.0)


def test_empty_question_set(spark):
    empty = spark.createDataFrame([], "question_id long, precision_at_k double, recall_at_k double, reciprocal_rank double")
    assert tuple(evaluation.question_set_means(empty).first()) == (0, 0.0, 0.0, 0.0)


def test_synthetic_questions_repeat(spark):
    rows = spark.createDataFrame([(f"p{i}", "survey", "Opening Hours", "", "") for i in range(30)], "passage_id string, dataset_type string, question string, metric_name string, category string")
    a, b = evaluation.synthetic_questions(rows, 5).collect(), evaluation.synthetic_questions(rows.repartition(4), 5).collect()
    assert sorted(a) == sorted(b) and a[0]["question"] == "What do respondents say about opening hours?"
    assert evaluation.synthetic_questions(rows, 5, seed=1).collect() != a


def test_restarts_do_not_decode_the_cached_vectors_in_every_round(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    from gaugeworks.operators import themes

    vectors = spark.createDataFrame([(Vectors.dense(float(i % 3), float(i // 30)),) for i in range(60)], ["features"]).persist()
    levels, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *rest: (levels.append(df.storageLevel.useMemory), fit(self, df, *rest))[1])
    best = themes._best_of(vectors, 3, 7, 3)
    costs = [fit(KMeans(k=3, seed=7 + i, maxIter=300, tol=1e-4), vectors).summary.trainingCost for i in range(3)]
    vectors.unpersist()
    assert levels == [False] * 3 and best.summary.trainingCost == min(costs)


def test_codes_are_scanned_as_the_vectors_they_stand_for_and_lists_share_chunks(spark):
    x = np.random.default_rng(8).normal(size=(300, 8))
    ps = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "passage_id long, embedding array<double>")
    index = quantized.fit(ps, parts=4)
    own = index.lists(x)[:, 0]
    codes = index.codes(x, own)
    for i in (0, 150, 299):
        rest = (x[i] - index.centres[own[i]]).reshape(4, 2)
        apart = sum(((rest[p] - index.words[p][codes[i, p]]) ** 2).sum() for p in range(4))
        assert np.isclose(((x[i] - index.decoded(own[i], codes[i:i + 1])[0]) ** 2).sum(), apart)
    first, cut = quantized._dealt(np.bincount(own, minlength=len(index.centres)), 1000)
    assert len(index.centres) > 1 and set(first) == {0} and cut.max() == 1
