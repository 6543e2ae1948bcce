import hashlib

import brute
import numpy as np
from pyspark.sql import functions as F

from gaugeworks.llm import blocks as B
from gaugeworks.llm import components, jaccard, substrings
from gaugeworks.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
# Names that the operators use inside.
CLASHING = "doc_id long, text string, id string, key long, hash int, group string, c0 date, blob binary, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "g", None, b"b", 3) for i, t in rows], CLASHING)


def test_substrings_equal_brute_force_and_carry_columns(spark, texts):
    docs = frame(spark, texts).repartition(5)
    got = sorted((r.row.doc_id is None, r.row.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.repeated_words(docs).collect())
    want = sorted((i is None, i or 0, *found) for (i, _), found in zip(texts, brute.kept_words(texts), strict=True))
    assert got == want
    out = substrings.drop_repeats(docs)
    assert out.dtypes == docs.dtypes and out.count() == docs.count()
    row = out.filter("doc_id = 0").first()
    assert (row.id, row.key, row.hash, row.group, row.blob, row.row, row.text) == ("x", 1, 2, "g", b"b", 3, texts[0][1])


def test_substrings_intervals_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage), (2, f"a b {passage} c"), (3, f"{passage} x {passage}")]
    got = {r.row.doc_id: (r.starts, r.ends) for r in substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([], []), 2: ([2], [32]), 3: ([0, 31], [30, 61])}


def test_substrings_of_equal_ids_and_empty_table(spark):
    text = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (1, f"{text} more")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.repeated_words(docs).collect()] == [0, 0, 0]
    assert substrings.repeated_words(docs.limit(0)).count() == 0


def test_substring_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring_dedup"](spark, SMALL).collect()}
    assert got == {i: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, m, kept) in zip(rows, brute.kept_words(rows), strict=True)}


def test_near_copies_equal_brute_force(spark, texts):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_duplicates(frame(spark, texts).repartition(5)).collect())
    want = sorted((i is None, i or 0, n, c or 0) for (i, _), (n, c) in zip(texts, brute.near_components(texts), strict=True))
    assert got == want


def test_near_copies_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_jaccard_join"](spark, SMALL).collect()}
    assert got == {i: found for (i, _), found in zip(rows, brute.near_components(rows), strict=True)}


def test_chains_of_links_and_hot_shingles(spark, monkeypatch):
    # Small parts, so that hot groups are cut, leaders meet again and cells have several queries' parts.
    for name, value in (("PART", 4), ("MEMBERS", 3), ("QUERIES", 2), ("HOT", 5)):
        monkeypatch.setattr(jaccard, name, value)
    words = [f"v{i}" for i in range(400)]
    shared = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join(words[i * 4:i * 4 + 40])) for i in range(60)]
    rows += [(100 + i, " ".join(shared + words[i:i + 9])) for i in range(60)]
    rows += [(200 + i, " ".join(shared[:25] + words[300 + i:304 + i])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: found for (i, _), found in zip(rows, brute.near_components(rows), strict=True)}


def in_blocks(spark, parts):
    """One frame with a partition, so a block, per list of rows."""
    return spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(list), "doc_id long, text string")


def test_rows_repeated_in_several_blocks_chain_their_copies(spark):
    words = [f"v{i}" for i in range(300)]
    text = lambda k: " ".join(words[k * 60:k * 60 + 60])
    near = text(2) + " other end"
    parts = [
        # Row 3 has a copy in one block and is a copy in the next, and so on down to 1.
        [(3, text(0)), (5, text(0)), (10, text(1)), (20, near)], [(2, text(0)), (3, text(0))], [(1, text(0)), (2, text(0))],
        # Row 14 is a copy of two rows that never meet.
        [(12, text(1)), (14, text(1))], [(11, text(1)), (14, text(1))],
        # Equal ids and sets, different texts, in both orders, beside a near copy.
        [(30, text(2)), (30, text(2).upper())], [(30, text(2).upper()), (30, text(2))],
    ]
    rows = [r for part in parts for r in part]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(in_blocks(spark, parts)).collect())
    assert got == sorted((i, n, c) for (i, _), (n, c) in zip(rows, brute.near_components(rows), strict=True))
    assert {i: c for i, _, c in got} == {1: 1, 2: 1, 3: 1, 5: 1, 10: 10, 11: 10, 12: 10, 14: 10, 20: 20, 30: 20}


def test_one_of_each_and_empty_table(spark):
    text = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text, 1), (3, text + " q", 2), (9, "other words", 3), (None, text, 4), (None, "alone", 5), (None, None, 6), (7, None, 7)], "doc_id long, text string, key int").withColumnRenamed("key", "root")
    assert sorted((r.doc_id or 0, r.root) for r in jaccard.one_of_each(docs).collect()) == [(0, 5), (0, 6), (3, 2), (7, 7), (9, 3)]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs.limit(0)).columns == ["doc_id", "text", "root"]


def test_one_of_each_keeps_one_row_of_every_text(spark):
    words = [f"v{i}" for i in range(200)]
    one, two = " ".join(words[:60]), " ".join(words[100:160])
    # Row 5 has a copy of an earlier text and a text of its own; row 9 is there twice, in one block and in two.
    rows = [(3, one), (5, one), (5, two), (7, two + " more"), (9, "same words here"), (9, "same words here"), (8, "x y z"), (8, "x y z")]
    docs = in_blocks(spark, [rows[:5], rows[5:7], rows[7:]]).withColumn("source", F.lit("a"))
    kept = sorted((r.doc_id, r.text, r.source) for r in jaccard.one_of_each(docs).collect())
    assert kept == [(3, one, "a"), (5, two, "a"), (8, "x y z", "a"), (9, "same words here", "a")]


def test_one_large_group_of_near_copies_becomes_few_classes(spark, monkeypatch):
    for name, value in (("PART", 8), ("MEMBERS", 4), ("QUERIES", 4), ("HOT", 6)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(components, "SHARED", 10)
    rnd = __import__("random").Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rnd.randint(0, 2)):
            copy[rnd.randrange(100)] = f"c{rnd.randrange(50)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: found for (i, _), found in zip(rows, brute.near_components(rows), strict=True)}
    assert jaccard.one_of_each(docs).count() == len({c for _, c in got.values()})


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 7), (300, 299), (299, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {100 + i: 100 for i in range(50)} | {299: 299, 300: 299}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_word_hashes_go_piece_by_piece(monkeypatch):
    """Cuts between pieces change no hash, and beside the words little is held at once."""
    import tracemalloc

    random = np.random.default_rng(2)
    words = [bytes(random.integers(97, 123, int(n)).tolist()) for n in random.integers(1, 12, 300_000)]
    words[7:9], words[2000] = [b"", b""], b"x" * 3000
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    tracemalloc.start()
    found = B.word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(data)
    monkeypatch.setattr(B, "PIECE_BYTES", 1 << 40)
    assert (found == B.word_hashes(data, starts, ends)).all()
    for size in (1, 10, 64):
        monkeypatch.setattr(B, "PIECE_BYTES", size)
        assert (B.word_hashes(data, starts[:5000], ends[:5000]) == found[:5000]).all()


def test_columns_of_several_classes_are_found_in_one_pass_over_the_prefixes(spark, monkeypatch):
    tokens = lambda *parts: np.concatenate([np.arange(a, b, dtype=np.uint64) for a, b in parts]).tobytes()
    near = [(1, 40, tokens((0, 40))), (2, 40, tokens((0, 38), (100, 102))), (3, 40, tokens((0, 20), (200, 220))), (4, 40, tokens((300, 340)))]
    sets = spark.createDataFrame(near, "key long, n long, tokens binary")
    plans, stored = [], jaccard.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(jaccard, "stored", seen)
    for some in (3, None):
        plans.clear()
        links = jaccard._links_between(sets, sets.select("key", F.col("key").alias("class")), 75, some)
        assert {tuple(sorted(r)) for r in links.collect()} == {(1, 2)}
        searched = [plan for plan in plans if "MapInArrow" in plan]
        # The places of shingles are not shuffled with them.
        assert len(searched) == 1 and "struct<token" not in searched[0]


def test_one_of_each_does_not_shuffle_texts_for_few_marked_rows(spark, texts, monkeypatch):
    docs = frame(spark, texts)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard.one_of_each(docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        sent = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(jaccard, "SENT_KEYS", -1)
    assert sent == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(docs).collect())


def test_blocks_give_memory_back_after_every_batch(monkeypatch):
    import pyarrow as pa

    given = []
    monkeypatch.setattr(B, "release", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None, "c d e"]})
    assert sum(b.num_rows for b in B.blocks(iter([batch, batch.slice(0, 0), batch]), size=3)) == 6 and len(given) == 2
