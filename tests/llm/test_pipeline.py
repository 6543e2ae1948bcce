import struct

import brute
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeworks.llm import decontaminate, toxicity
from gaugeworks.llm.queries import labelled, word_tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents with a column more, a row twice and a copy of another text under a used id."""
    given = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("more", F.col("doc_id") * 2)
    again = given.where("doc_id = 7").union(given.where("doc_id = 11").withColumn("doc_id", F.lit(12).cast("long")))
    return given.union(again).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_equals_its_plain_form(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    # Toxicity: the rows that the fitted model scores below one half.
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(labelled(docs, labels, "toxic", toxicity.SAMPLE))
    scores = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    after = corpus_pipeline.STAGES[0][1](spark, before, DATA).cache()
    assert after.columns == docs.columns and rows(after) == rows(before.where(~F.col("doc_id").isin([i for i, s in scores.items() if s >= 0.5])))
    # Near copies: one row of every component.
    before, after = after, corpus_pipeline.STAGES[1][1](spark, after, DATA).cache()
    given = [(r.doc_id, r.text) for r in before.collect()]
    marked = brute.near_components(given)
    texts = {}
    for (i, t), (_, c) in zip(given, marked, strict=True):
        texts.setdefault(c, []).append((i, t))
    kept = [(r.doc_id, r.text) for r in after.collect()]
    # Components are named by their smallest id; wordless rows are alone.
    assert {i for i, _ in kept} >= {min(members)[0] for members in texts.values()} and len(set(kept)) == len(kept)
    assert set(rows(after)) <= set(rows(before)) and after.columns == docs.columns
    # Repeated windows.
    before, after = after, corpus_pipeline.STAGES[2][1](spark, after, DATA).cache()
    given = [(r.doc_id, r.text) for r in before.collect()]
    # A text that loses nothing is left as it is.
    want = sorted((i, kept if removed else text) for (i, text), (_, removed, kept) in zip(given, brute.kept_words(given), strict=True))
    assert sorted((r.doc_id, r.text) for r in after.collect()) == want and all(r.n_chars == len(r.text) for r in after.collect())
    # Benchmark items.
    before, after = after, corpus_pipeline.STAGES[3][1](spark, after, DATA).cache()
    found = decontaminate.matches(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    gone = {r.id for r in found.collect()}
    assert rows(after) == rows(before.where(~F.col("doc_id").isin(list(gone)))) and after.columns == docs.columns
    # Encoding.
    tokenizer = Tokenizer.from_file(word_tokenizer())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = {}
    for r in after.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.STAGES[4][1](spark, after, DATA).collect()}
    assert got == want
