"""Queries: personal data, questions, sentiment, themes, retrieval and its evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions import pii
from gaugeworks.functions.text import normalized_key
from gaugeworks.operators import describe, evaluation, quantized, questions, retrieval, sentiment, themes
from gaugeworks.plans.numbers import REGISTRY_SQL, registry_frame
from gaugeworks.plans.registry import query, table
from gaugeworks.session import kept

P = K.PII_PATTERNS


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _redact_sql(source: str, key: str, text: str) -> str:
    """Counts and replacement kind by kind, each on the text the previous kind left."""
    inner = f"SELECT {key}, {text} AS t FROM {source}"
    kept = key
    for kind, pattern in P.items():
        n = f"len(regexp_extract_all(t, {_quoted(pattern)}))"
        inner = f"SELECT {kept}, CAST(coalesce({n}, 0) AS INTEGER) AS n_{kind}, regexp_replace(t, {_quoted(pattern)}, '[{kind.upper()}]', 'g') AS t FROM ({inner})"
        kept += f", n_{kind}"
    return inner


@query("pii_detect", " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, string_agg(m, '|' ORDER BY i) AS matches FROM (SELECT doc_id, unnest(l) AS m, generate_subscripts(l, 1) AS i "
    f"FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(p)}) AS l FROM documents)) GROUP BY doc_id" for kind, p in P.items()
))
def pii_detect(spark, sf):
    found = _docs(spark, sf).select("doc_id", F.explode(pii.detect("text")).alias("kind", "m"))
    return found.select("doc_id", "kind", F.array_join("m", "|").alias("matches"))


@query("pii_redact", f"SELECT doc_id, n_email, n_phone, n_ssn, n_address, t AS redacted_text FROM ({_redact_sql('documents', 'doc_id', 'text')})")
def pii_redact(spark, sf):
    return pii.redact(_docs(spark, sf).select("doc_id", "text"), "text").drop("text")


@query("pii_flag", "SELECT doc_id, kinds <> '' AS has_pii, kinds AS pii_kinds FROM (SELECT doc_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN '{kind}' END" for kind, p in P.items()) + ") AS kinds FROM documents)")
def pii_flag(spark, sf):
    flagged = pii.flag(_docs(spark, sf), "text")
    return flagged.select("doc_id", "has_pii", F.array_join("pii_kinds", ",").alias("pii_kinds"))


PII_TOTALS_SQL = (
    f"SELECT kind, CAST(total AS BIGINT) AS total FROM (UNPIVOT (SELECT sum(n_email) AS email, sum(n_phone) AS phone, sum(n_ssn) AS ssn, sum(n_address) AS address "
    f"FROM ({_redact_sql('documents', 'doc_id', 'text')})) ON email, phone, ssn, address INTO NAME kind VALUE total)"
)


@query("pii_totals", PII_TOTALS_SQL)
def pii_totals(spark, sf):
    return pii.redaction_totals(_docs(spark, sf), "text")


@query("pii_safe", "SELECT lang, count(*) AS n FROM documents WHERE NOT (" + " OR ".join(f"regexp_matches(text, {_quoted(p)})" for p in P.values()) + ") GROUP BY ALL")
def pii_safe(spark, sf):
    return _docs(spark, sf).where(pii.is_clean("text")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_PARTS = ", ".join(
    f"CASE WHEN len(regexp_extract_all(text, {_quoted(p)})) > 0 THEN len(regexp_extract_all(text, {_quoted(p)})) || ' {kind}' "
    f"|| CASE WHEN len(regexp_extract_all(text, {_quoted(p)})) > 1 THEN 's' ELSE '' END END" for kind, p in P.items()
)


@query("pii_summary", f"SELECT doc_id, CASE WHEN s = '' THEN 'No PII detected' ELSE 'PII detected: ' || s END AS summary FROM (SELECT doc_id, concat_ws(', ', {_PARTS}) AS s FROM documents)")
def pii_summary(spark, sf):
    return _docs(spark, sf).select("doc_id", pii.summary("text").alias("summary"))


@query("pii_custom", r"""
    SELECT doc_id, len(regexp_extract_all(text, '\bhttps?://\S+')) AS n_link FROM documents WHERE regexp_matches(text, '\bhttps?://\S+')""")
def pii_custom(spark, sf):
    counted = pii.redact(_docs(spark, sf).select("doc_id", "text"), "text", {"link": r"\bhttps?://\S+"})
    return counted.where(F.col("n_link") > 0).select("doc_id", F.col("n_link").cast("long").alias("n_link"))


@query("normalized_keys", r"""
    SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_key, count(*) AS copies, min(doc_id) AS first_doc_id
    FROM documents GROUP BY 1 HAVING count(*) > 1""")
def normalized_keys(spark, sf):
    from gaugeworks.sources.intake import duplicates

    keyed = _docs(spark, sf).select("doc_id", F.sha2(normalized_key("text"), 256).alias("text_key"))
    return duplicates(keyed, "text_key", "doc_id")


# Questions.


def _rule_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains({text}, {_quoted(w)})' for w in words)} THEN '{name}'" for name, words in K.INTENT_HINTS
    )
    return f"CASE {cases} ELSE 'retrieval' END"


QUESTIONS_SQL = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


def _questions(spark, sf):
    return table(spark, sf, "conversations").where(F.col("role") == "user")


@query("intent_classify", f"""
    SELECT conv_id, turn, intent, intent IN ('qualitative', 'retrieval', 'reporting') AS needs_evidence
    FROM (SELECT conv_id, turn, {_rule_sql('lower(text)')} AS intent FROM ({QUESTIONS_SQL}))""")
def intent_classify(spark, sf):
    return questions.classify_questions(_questions(spark, sf)).select("conv_id", "turn", "intent", "needs_evidence")


@query("intent_of_documents", f"SELECT {_rule_sql('lower(text)')} AS intent, count(*) AS n FROM documents GROUP BY 1")
def intent_of_documents(spark, sf):
    return questions.classify_questions(_docs(spark, sf)).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


_PROFILES_SQL = f"SELECT name, dataset_type, description IS NOT NULL AS has_text, usage_notes IS NOT NULL AS has_numeric FROM ({REGISTRY_SQL})"


def _served(spark, sf):
    return registry_frame(spark, sf).select(
        "name", "dataset_type", F.col("description").isNotNull().alias("has_text"), F.col("usage_notes").isNotNull().alias("has_numeric")
    )


@query("question_targets", f"""
    SELECT key, intent, name AS dataset_name FROM (
        SELECT conv_id || ':' || turn AS key, lower(text) AS t, {_rule_sql('lower(text)')} AS intent FROM ({QUESTIONS_SQL})) q, ({_PROFILES_SQL}) p
    WHERE contains(t, lower(name)) OR contains(t, dataset_type)
       OR CASE intent WHEN 'qualitative' THEN has_text WHEN 'quantitative' THEN has_numeric ELSE true END""")
def question_targets(spark, sf):
    asked = _questions(spark, sf).withColumn("key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return questions.target_datasets(asked, _served(spark, sf), "key")


@query("token_budget", """
    SELECT conv_id, count(*) AS turns, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, sum(length(text) // 4) <= 4000 AS within_budget
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id""")
def token_budget(spark, sf):
    return retrieval.history_budget(table(spark, sf, "conversations"))


@query("recent_turns", """
    SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5""")
def recent_turns(spark, sf):
    return retrieval.recent_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


# Sentiment. The prose is invented, so the registered list is words that do occur in it.

WORD_LIST = {
    "the": (0.2, 0.1), "and": (0.5, 0.2), "best": (0.9, 0.4), "free": (0.3, 0.6), "with": (0.1, 0.3), "this": (0.4, 0.9),
    "la": (-0.3, 0.2), "der": (-0.6, 0.5), "que": (-0.9, 0.8), "von": (-0.2, 0.4), "les": (-0.4, 0.1), "from": (-0.1, 0.7),
}
_LEXICON_SQL = "(VALUES " + ", ".join(f"('{w}', {p}, {s})" for w, (p, s) in WORD_LIST.items()) + ") AS l(word, polarity, subjectivity)"
SENTIMENT_SQL = f"""
    SELECT d.doc_id, d.lang, CAST(coalesce(h.hits, 0) AS INTEGER) AS hits, coalesce(h.p, 0.0) AS polarity, coalesce(h.s, 0.0) AS subjectivity,
           CASE WHEN coalesce(h.p, 0.0) > 0.1 THEN 'positive' WHEN coalesce(h.p, 0.0) < -0.1 THEN 'negative' ELSE 'neutral' END AS category
    FROM documents d LEFT JOIN (
        SELECT doc_id, count(*) AS hits, avg(CAST(polarity AS DOUBLE)) AS p, avg(CAST(subjectivity AS DOUBLE)) AS s
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents) JOIN {_LEXICON_SQL} USING (word)
        GROUP BY doc_id) h USING (doc_id)"""


def _scored(spark, sf):
    return sentiment.lexicon_sentiment(_docs(spark, sf), "text", WORD_LIST)


@query("lexicon_sentiment", SENTIMENT_SQL, "polarity subjectivity", polarity=12, subjectivity=12)
def lexicon_sentiment(spark, sf):
    return _scored(spark, sf).select("doc_id", "lang", "hits", "polarity", "subjectivity", "category")


@query("lexicon_sentiment_table", SENTIMENT_SQL.replace("AS INTEGER", "AS BIGINT"), "polarity subjectivity", polarity=12, subjectivity=12)
def lexicon_sentiment_table(spark, sf):
    entries = spark.createDataFrame([(w, p, s) for w, (p, s) in WORD_LIST.items()], "word string, polarity double, subjectivity double")
    rows = sentiment.lexicon_sentiment_table(_docs(spark, sf), "doc_id", "text", entries)
    return rows.select("doc_id", "lang", "hits", "polarity", "subjectivity", "category")


@query("sentiment_mix", f"""
    SELECT lang, count(*) AS total, count(category) AS processed, CAST(0 AS BIGINT) AS skipped,
           avg(CAST(category = 'positive' AS INTEGER)) AS positive, avg(CAST(category = 'neutral' AS INTEGER)) AS neutral,
           avg(CAST(category = 'negative' AS INTEGER)) AS negative, 'ok' AS status FROM ({SENTIMENT_SQL}) GROUP BY lang""", "positive neutral negative")
def sentiment_mix(spark, sf):
    return sentiment.dataset_sentiment(_docs(spark, sf), "text", ("lang",), _scored(spark, sf))


@query("sentiment_counts", f"SELECT lang, category, count(*) AS n FROM ({SENTIMENT_SQL}) GROUP BY ALL")
def sentiment_counts(spark, sf):
    return describe.sentiment_counts(_scored(spark, sf), "category", ("lang",))


@query("survey_score_stats", f"""
    SELECT measure, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std_dev, min(x) AS min, max(x) AS max FROM (
        SELECT 'sentiment_score' AS measure, polarity AS x FROM ({SENTIMENT_SQL})
        UNION ALL SELECT 'response_length', CAST(length(text) AS DOUBLE) FROM documents WHERE text <> '') GROUP BY measure""", "mean median std_dev min max")
def survey_score_stats(spark, sf):
    return describe.survey_statistics(_scored(spark, sf), "text", "polarity")


def _vowel_model():
    """A stand-in for a model: label chances from the share of vowels."""

    def score(texts):
        share = np.array([sum(c in "aeiou" for c in t.lower()) / max(len(t), 1) for t in texts])
        raw = np.stack([np.abs(share - 0.25), np.full(len(texts), 0.05), np.abs(share - 0.4)], axis=1)
        return raw / raw.sum(axis=1, keepdims=True)

    return score


VOWELS_SQL = """
    SELECT doc_id, abs(share - 0.25) AS a, 0.05 AS b, abs(share - 0.4) AS c FROM (
        SELECT doc_id, length(regexp_replace(lower(coalesce(text, '')), '[^aeiou]', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS share FROM documents)"""


@query("model_sentiment", f"""
    SELECT count(*) AS total, count(*) AS processed, 0::BIGINT AS skipped, avg((best = 3)::INTEGER) AS positive, avg((best = 2)::INTEGER) AS neutral, avg((best = 1)::INTEGER) AS negative,
        avg(100 * greatest(a, b, c) / (a + b + c)) AS average_confidence, 0::BIGINT AS failed
    FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS best FROM ({VOWELS_SQL}))""", "positive neutral negative average_confidence")
def model_sentiment(spark, sf):
    scored = sentiment.model_sentiment(_docs(spark, sf), "doc_id", "text", _vowel_model)
    return sentiment.mean_confidence(scored)


# Themes.


def _themes(spark, sf):
    return themes.extract_themes(_scored(spark, sf).select("doc_id", "text", "category"), "doc_id", "text", "category")


@query("theme_cover", """
    SELECT count(*) AS texts, 5::BIGINT AS themes, true AS numbered, true AS keyed FROM documents WHERE text IS NOT NULL AND text <> ''""")
def theme_cover(spark, sf):
    """What holds of any themes: they cover every text once, are numbered by size, and have keywords."""
    found = _themes(spark, sf).table
    return found.agg(
        F.sum("frequency").alias("texts"), F.count(F.lit(1)).alias("themes"), F.bool_and(F.col("theme_id").between(1, 5)).alias("numbered"), F.bool_and(F.size("keywords") > 0).alias("keyed"),
    )


@query("themes")
def theme_table(spark, sf):
    return themes.export_table(_themes(spark, sf).table)


@query("theme_quotes")
def theme_quotes(spark, sf):
    return themes.summary_lines(_themes(spark, sf).table)


@query("keyword_quotes", """
    SELECT lang, doc_id, text, r AS rank FROM (
        SELECT lang, doc_id, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY abs(length(text) - 100), doc_id) AS INTEGER) AS r
        FROM documents WHERE contains(lower(text), 'the')) WHERE r <= 3""")
def keyword_quotes(spark, sf):
    return themes.representative_quotes(_docs(spark, sf), "doc_id", "text", F.lit("the"), ("lang",))


# Retrieval.


@query("passages_survey", """
    SELECT 'ds1_row' || doc_id AS passage_id, 'Survey question: ' || lang || chr(10) || 'Patron feedback response: ' || text AS text
    FROM documents WHERE text <> ''""")
def passages_survey(spark, sf):
    rows = _docs(spark, sf).select(
        F.lit(1).cast("long").alias("dataset_id"), F.col("doc_id").alias("id"), F.lit(None).cast("date").alias("response_date"),
        F.col("lang").alias("question"), F.col("text").alias("response_text"),
    )
    return retrieval.survey_passages(rows).select("passage_id", "text")


def _metric_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.lit(2).cast("long").alias("dataset_id"), F.col("event_id").alias("id"), F.to_date("ts").alias("date"),
        F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("category"),
    )


@query("passages_metric", """
    SELECT 'ds2_row' || event_id AS passage_id, event_type || ': ' || CASE WHEN value = 0 THEN '0' ELSE CAST(value AS VARCHAR) END || ' on ' || CAST(CAST(ts AS DATE) AS VARCHAR)
           || ' (Category: user ' || user_id || ')' AS text FROM events""")
def passages_metric(spark, sf):
    rows = _metric_rows(spark, sf)
    return retrieval.metric_passages(rows).select("passage_id", "text")


@query("passages_circulation", """
    SELECT 'ds2_row' || event_id AS passage_id, 'Circulation checkout: ' || event_type || ' material checked out on ' || CAST(CAST(ts AS DATE) AS VARCHAR)
           || ' by user ' || user_id || ' patron' AS text FROM events""")
def passages_circulation(spark, sf):
    return retrieval.metric_passages(_metric_rows(spark, sf), "circulation").select("passage_id", "text")


@query("embedded_passages", r"""
    SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') THEN 1.0 ELSE 0.0 END AS norm FROM documents""", "norm")
def embedded_passages(spark, sf):
    embedded, _ = retrieval.hashed_embedding(_docs(spark, sf))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return embedded.select("doc_id", F.round(norm, 4).alias("norm"))


@query("not_indexed", f"""
    SELECT dataset_id, name FROM ({REGISTRY_SQL}) r
    WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND CAST(substr(d.source, 4) AS BIGINT) = r.dataset_id)""")
def not_indexed(spark, sf):
    return retrieval.not_indexed(registry_frame(spark, sf), _toxic(spark, sf)).select("dataset_id", "name")


def _toxic(spark, sf):
    marked = table(spark, sf, "labels").where(F.col("toxic") == 1)
    return _docs(spark, sf).join(marked, "doc_id").select(F.substring("source", 4, 20).cast("long").alias("dataset_id"))


@query("sync_status", f"""
    SELECT dataset_id, CASE WHEN has AND coalesce(indexing_status, '') <> 'completed' THEN 'completed' ELSE coalesce(indexing_status, 'pending') END AS indexing_status
    FROM (SELECT *, EXISTS (SELECT 1 FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND CAST(substr(d.source, 4) AS BIGINT) = r.dataset_id) AS has FROM ({REGISTRY_SQL}) r)""")
def sync_status(spark, sf):
    return retrieval.sync_status(registry_frame(spark, sf), _toxic(spark, sf)).select("dataset_id", "indexing_status")


DISTANCES_SQL = """
    SELECT a.vec_id AS question_id, b.vec_id AS passage_id, a.label AS question_label, b.label AS passage_label,
           round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ** 2, 9) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
NEAREST_SQL = f"""
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, passage_id) AS rank FROM ({DISTANCES_SQL}) WHERE distance <= 1.45"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "passage_id").withColumnRenamed("label", "passage_label")


def _asked(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "question_id").withColumnRenamed("label", "question_label")


def _nearest(spark, sf, k=K.TOP_K, **how):
    return retrieval.nearest(_asked(spark, sf), _vectors(spark, sf), k, exclude_same_key=True, **how)


@query("knn_top5", f"SELECT question_id, CAST(rank AS INTEGER) AS rank, passage_id, distance FROM ({NEAREST_SQL}) WHERE rank <= 5", "distance")
def knn_top5(spark, sf):
    return _nearest(spark, sf)


@query("knn_blocks", f"SELECT question_id, CAST(rank AS INTEGER) AS rank, passage_id, distance FROM ({NEAREST_SQL}) WHERE rank <= 5", "distance")
def knn_blocks(spark, sf):
    return _nearest(spark, sf, question_bytes=0)


@query("knn_quantized_recall", f"""
    SELECT count(*) AS n_exact, true AS is_enough, 0::BIGINT AS n_wrong FROM ({NEAREST_SQL}) WHERE rank <= 5""")
def knn_quantized_recall(spark, sf):
    """Inverted lists of codes against the exact search: recall of 0.9 and exact distances."""
    asked, vectors = _asked(spark, sf), _vectors(spark, sf)
    index = quantized.fit(vectors)
    # Both are read twice, so they are written once.
    found = kept(quantized.nearest(asked, quantized.indexed(vectors, index), vectors, index, exclude_same_key=True), "found")
    exact = kept(_nearest(spark, sf), "exact")
    close = F.abs(F.col("f.distance") - F.col("e.distance")) < 1e-6
    wrong = found.alias("f").join(exact.alias("e"), ["question_id", "passage_id"]).where(~close).agg(F.count(F.lit(1)).alias("n_wrong"))
    return quantized.recall(found, exact).select("n_exact", (F.col("recall") >= 0.9).alias("is_enough")).crossJoin(F.broadcast(wrong))


CONFIDENCE_SQL = f"""
    SELECT e.vec_id AS question_id, coalesce(avg(CASE WHEN distance IS NOT NULL THEN greatest(0, least(1, 1 - distance / 1.45)) END), 0.0) AS confidence, count(distance) AS n_passages
    FROM embeddings e LEFT JOIN (SELECT * FROM ({NEAREST_SQL}) WHERE rank <= 5) n ON n.question_id = e.vec_id GROUP BY e.vec_id"""


@query("confidence", CONFIDENCE_SQL, "confidence")
def confidence(spark, sf):
    return retrieval.confidence_scores(_asked(spark, sf), _nearest(spark, sf))


@query("evidence_labels", f"""
    SELECT label, count(*) AS n FROM (
        SELECT CASE WHEN confidence >= 0.65 AND n_passages >= 3 THEN 'High' WHEN confidence >= 0.35 AND n_passages >= 2 THEN 'Medium' ELSE 'Low' END AS label
        FROM ({CONFIDENCE_SQL})) GROUP BY label""")
def evidence_labels(spark, sf):
    scored = retrieval.confidence_scores(_asked(spark, sf), _nearest(spark, sf))
    assessed = questions.assess_evidence(
        scored.withColumn("intent", F.lit("retrieval")).withColumn("question", F.lit("")), citations="n_passages"
    )
    return assessed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _passage_table(spark, sf):
    """A text for every vector, from the document of the same number where there is one."""
    docs = _docs(spark, sf).select(F.col("doc_id").alias("passage_id"), "text", F.col("source").alias("_s"), "lang")
    return _vectors(spark, sf).select("passage_id").join(docs, "passage_id").select(
        "passage_id", "text", F.substring("_s", 4, 20).cast("long").alias("dataset_id"),
        F.lit("survey").alias("dataset_type"), F.col("lang").alias("date"),
    )


_CITED_SQL = f"""
    SELECT question_id, rank, CAST(substr(source, 4) AS BIGINT) AS dataset_id, lang, text FROM ({NEAREST_SQL}) n JOIN documents d ON d.doc_id = n.passage_id WHERE rank <= 5"""


@query("citations", f"""
    SELECT question_id, string_agg(rank || ':' || dataset_id || ':survey:' || lang, ' ' ORDER BY rank) AS citations, count(*) AS n_citations
    FROM ({_CITED_SQL}) GROUP BY question_id""")
def citations(spark, sf):
    found = retrieval.with_passage_text(_nearest(spark, sf), _passage_table(spark, sf))
    cited = retrieval.citations(found)
    line = lambda c: F.concat_ws(":", c["source_number"].cast("string"), c["dataset_id"].cast("string"), c["dataset_type"], c["date"])
    return cited.select("question_id", F.array_join(F.transform("citations", line), " ").alias("citations"), "n_citations")


@query("contexts", f"""
    SELECT question_id, tokens AS estimated_tokens, CASE WHEN n = 0 THEN 'no_relevant_data' WHEN tokens > 4000 THEN 'context_too_large' ELSE 'ready' END AS status FROM (
        SELECT q.question_id, count(c.rank) AS n,
               CAST(floor(({len(retrieval.PROMPT_HEAD) + len(retrieval.PROMPT_TAIL)} + 29 + length(coalesce(string_agg('Source ' || c.rank || ': ' || t, chr(10) || chr(10) ORDER BY c.rank), '')) + length(any_value(q.question))) / 4) AS BIGINT) AS tokens
        FROM (SELECT vec_id AS question_id, 'label ' || label AS question FROM embeddings) q
        LEFT JOIN (SELECT x.question_id, x.rank, r.t FROM ({_CITED_SQL}) x JOIN ({NEAREST_SQL}) n USING (question_id, rank)
                   JOIN ({_redact_sql('documents', 'doc_id', 'text')}) r ON r.doc_id = n.passage_id) c USING (question_id)
        GROUP BY q.question_id)""")
def contexts(spark, sf):
    asked = _asked(spark, sf).withColumn("question", F.concat(F.lit("label "), F.col("question_label").cast("string")))
    found = retrieval.with_passage_text(_nearest(spark, sf), _passage_table(spark, sf))
    return retrieval.contexts(asked, found).select("question_id", "estimated_tokens", "status")


METRICS_SQL = f"""
    SELECT e.vec_id AS question_id, count(*) FILTER (hit AND rank <= 5) / 5.0 AS precision_at_k,
           CASE WHEN any_value(c.n) > 0 THEN count(*) FILTER (hit AND rank <= 5) * 1.0 / any_value(c.n) ELSE 0.0 END AS recall_at_k,
           coalesce(1.0 / min(rank) FILTER (hit AND rank <= 20), 0.0) AS reciprocal_rank
    FROM embeddings e JOIN (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) c USING (label)
    LEFT JOIN (SELECT *, question_label = passage_label AS hit FROM ({NEAREST_SQL}) WHERE rank <= 20) n ON n.question_id = e.vec_id GROUP BY e.vec_id"""


def _metrics(spark, sf):
    """Relevant passages share the question's label, so hits need the two labels and not a list of pairs."""
    asked, vectors = _asked(spark, sf), _vectors(spark, sf)
    found = _nearest(spark, sf, K.MRR_DEPTH)
    marked = found.join(vectors.select("passage_id", "passage_label"), "passage_id").join(asked.select("question_id", "question_label"), "question_id")
    marked = marked.withColumn("hit", F.col("question_label") == F.col("passage_label"))
    sizes = vectors.groupBy(F.col("passage_label").alias("question_label")).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    counts = asked.select("question_id", "question_label").join(sizes, "question_label").select("question_id", "n_relevant")
    return evaluation.question_metrics(counts, marked)


@query("retrieval_metrics", METRICS_SQL, "precision_at_k recall_at_k reciprocal_rank")
def retrieval_metrics(spark, sf):
    return _metrics(spark, sf)


@query("retrieval_means", f"""
    SELECT count(*) AS n_queries, avg(precision_at_k) AS avg_precision_at_k, avg(recall_at_k) AS avg_recall_at_k, avg(reciprocal_rank) AS avg_mrr FROM ({METRICS_SQL})""",
    "avg_precision_at_k avg_recall_at_k avg_mrr")
def retrieval_means(spark, sf):
    return evaluation.question_set_means(_metrics(spark, sf))


@query("judged_metrics", f"""
    WITH pairs AS (SELECT d.doc_id AS passage_id, v.vec_id AS question_id FROM labels d JOIN embeddings v ON v.vec_id = d.doc_id + 1 WHERE d.quality = 1),
    n AS (SELECT question_id, count(*) AS c FROM pairs GROUP BY ALL)
    SELECT n.question_id, count(p.passage_id) FILTER (rank <= 5) / 5.0 AS precision_at_k, count(p.passage_id) FILTER (rank <= 5) * 1.0 / any_value(n.c) AS recall_at_k,
           coalesce(1.0 / min(rank) FILTER (p.passage_id IS NOT NULL AND rank <= 20), 0.0) AS reciprocal_rank
    FROM n LEFT JOIN (SELECT * FROM ({NEAREST_SQL}) WHERE rank <= 20) k ON k.question_id = n.question_id
    LEFT JOIN pairs p ON p.question_id = k.question_id AND p.passage_id = k.passage_id GROUP BY n.question_id""",
    "precision_at_k recall_at_k reciprocal_rank")
def judged_metrics(spark, sf):
    good = table(spark, sf, "labels").where(F.col("quality") == 1)
    ids = _asked(spark, sf).select("question_id")
    pairs = good.select(F.col("doc_id").alias("passage_id"), (F.col("doc_id") + 1).alias("question_id")).join(ids, "question_id", "left_semi")
    marked = evaluation.mark_hits(_nearest(spark, sf, K.MRR_DEPTH), pairs)
    return evaluation.question_metrics(evaluation.relevant_counts(pairs), marked)


@query("synthetic_questions", """
    SELECT 'What are the usage statistics for ' || event_type || '?' AS question, 'ds2_row' || event_id AS passage_id
    FROM events ORDER BY md5('ds2_row' || event_id || ':42'), 2 LIMIT 10""")
def synthetic_questions(spark, sf):
    rows = retrieval.metric_passages(_metric_rows(spark, sf))
    return evaluation.synthetic_questions(rows, 10)


@query("evaluation_history", f"""
    SELECT label, ts, avg_precision_at_k FROM (
        SELECT e.label, DATE '2024-01-01' + CAST(e.label AS INTEGER) AS ts, avg(precision_at_k) AS avg_precision_at_k
        FROM ({METRICS_SQL}) m JOIN embeddings e ON e.vec_id = m.question_id GROUP BY ALL) ORDER BY ts DESC LIMIT 10""", "avg_precision_at_k")
def evaluation_history(spark, sf):
    labels = _asked(spark, sf).select("question_id", F.col("question_label").alias("label"))
    runs = _metrics(spark, sf).join(labels, "question_id").groupBy("label").agg(F.avg("precision_at_k").alias("avg_precision_at_k"))
    runs = runs.select("label", F.date_add(F.lit("2024-01-01").cast("date"), F.col("label")).alias("ts"), "avg_precision_at_k")
    return evaluation.history(runs)
