import gzip
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import neighbours, sharding, warc
from gaugeworks.llm.queries import QUERIES, SHARDS
from gaugeworks.session import scratch_path

DATA = "/root/testdata/sf0.01"


# Archives

def expected_records(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    largest = {}
    for i, p in payloads:
        if i is not None:
            largest[p] = max(largest.get(p, i), i)
    alone = Counter(p for _, p in payloads)
    out = []
    for i, p in payloads:
        target = largest.get(p) if len(p) >= 1000 and alone[p] > 1 and largest.get(p) != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if target is None else "revisit", target))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(1)
    noise = "".join(rnd.choices("abcdefghij é", k=30_000))
    rows = [(i, f"http://a/{i}", noise[i * 100:i * 100 + rnd.randint(0, 4000)]) for i in range(60)]
    rows += [(100 + i, "u", noise[:1500]) for i in range(30)] + [(200 + i, "u", "short") for i in range(3)]
    rows += [(300, None, None), (301, "line\r\nbreak", ""), (None, "n", noise[:1500]), (129, "u", noise[:1500]), (302, "big", noise * 40), (400, "x", "y" * 999), (401, "x", "y" * 999), (402, "x", "z" * 1000), (403, "x", "z" * 1000)]
    return rows


@pytest.mark.parametrize("size", [300, 5_000, 8 << 20])
def test_archives_come_back_whole_at_any_range(spark, pages, size):
    df = spark.createDataFrame([(*r, "c", 7) for r in pages], "page_id long, url string, html string, digest string, size int").repartition(3)
    archives = warc.write(df, scratch_path(spark, "warc"))
    got = warc.read(archives, size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected_records([(i, h) for i, _, h in pages]), key=key)
    assert all((hashlib.sha1(r.payload).hexdigest() == r.payload_digest) if r.record_type == "response" else r.payload is None for r in got)


def test_archives_are_plain_warc(spark, pages):
    archives = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch_path(spark, "warc")).collect()
    for archive in archives:
        with gzip.open(archive.path) as file:
            assert file.read().count(b"WARC/1.1\r\n") == archive.records


def test_damage_and_false_magic_cost_only_their_record():
    make = lambda i, body: warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), None)
    inner = make(99, b"inner")
    members = [make(1, b"a" * 500), make(2, warc._MAGIC * 50), make(3, random.Random(0).randbytes(3000) + inner), make(4, b"")]
    data = members[0] + warc._MAGIC + b"junk" + members[1] + members[2][:200] + b"\0" * 50 + members[3]

    def ids(window_size):
        out = []
        for start in range(0, len(data), window_size):
            window = warc._Window(io.BytesIO(data), start, len(data))
            out += [h["x-page-id"] for _, h, _ in warc.records_in(window, start, min(start + window_size, len(data)))]
        return out

    assert all(ids(size) == ["1", "2", "4"] for size in (50, 333, 100_000))


def test_urls_of_any_length_come_back(spark):
    rnd = random.Random(2)
    rows = [(i, "data:" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k)), f"page {i}") for i, k in enumerate((10, 1 << 16, 200_000, 3_000_000))]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in got) == rows


def test_a_record_lost_on_reading_is_an_error(spark, pages, monkeypatch):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    read = warc.read
    monkeypatch.setattr(warc, "read", lambda archives: read(archives).filter("page_id <> 300"))
    with pytest.raises(ValueError):
        warc.round_trip(df)


def test_archives_of_no_page(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").limit(0)
    assert warc.round_trip(df).count() == 0


def test_archive_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_warc"](spark, DATA).collect()), key=key) == sorted(expected_records(rows), key=key)


# Vectors

def exact(vectors, is_query, k):
    """``vectors`` by id, each usable."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(float)
    out = {}
    for i in ids[[bool(is_query(i)) for i in ids]]:
        scores = x @ np.array(vectors[i], np.float32).astype(float)
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_query_recall(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got, want = answers(QUERIES["op5_nearest_neighbours"](spark, DATA)), exact(vectors, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values()) and recall(got, want) >= 0.9
    for q, near in got.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(s == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), abs=1e-12) for i, s in near)


def test_many_vectors_in_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 3
    vectors = {i: (centres[i % 30] + rng.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    for i in range(0, 3000, 3):
        vectors[i] = vectors[0]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, rep int, bucket string").repartition(4)
    got, want = answers(neighbours.search(df, F.col("vec_id") % 100 == 0, 10)), exact(vectors, lambda i: i % 100 == 0, 10)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert got[300][:3] == [(i, pytest.approx(got[300][0][1])) for i in (0, 3, 6)]


def test_outliers_of_dense_clusters_find_all_that_they_can(spark, monkeypatch):
    # Small buckets, so that outliers share theirs with few others.
    for name, value in (("OCCUPANCY", 4), ("WIDTH", 0.3), ("PART", 100)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 24))
    x = np.concatenate((centres[np.arange(980) % 20] + 0.02 * rng.normal(size=(980, 24)), rng.normal(size=(20, 24))))
    vectors = {i: v for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist())}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(4)
    chosen = lambda i: (i >= 980) | (i % 100 == 0)
    got, want = answers(neighbours.search(df, chosen(F.col("vec_id")), 20)), exact(vectors, chosen, 20)
    assert set(got) == set(want) and all(len(near) == 20 for near in got.values()) and recall(got, want) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [2.0, 0.0]), (22, None), (23, []), (24, [0.0, -0.0]), (25, [nan, 1.0]), (26, [inf, 1.0]), (27, [None, 1.0]), (28, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, None), (21, [2.0, 0.0]), (30, [1.0, 0.0]), (60, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(neighbours.search(df, F.col("vec_id") % 20 == 0, 20))
    assert got == {
        0: [(21, 2.0), (30, 1.0), (20, 0.5), (60, -1.0)], 20: [(21, 1.0), (0, 0.5), (30, 0.5), (60, -0.5)], 60: [(20, -0.5), (0, -1.0), (30, -1.0), (21, -2.0)],
    }
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert neighbours.search(df.filter("vec_id = 0"), F.lit(True), 20).count() == 0


def test_probes_come_by_score():
    rng = np.random.default_rng(0)
    for m in (0, 1, 3, 5):
        fraction = rng.uniform(size=m)
        order = neighbours.probe_order(fraction, 10_000)
        score = [sum(fraction[j] ** 2 if s < 0 else (1 - fraction[j]) ** 2 if s > 0 else 0 for j, s in enumerate(p)) for p in order]
        assert len(set(order)) == len(order) == 3**m and score == sorted(score)


# Shards

def test_table_is_even_and_stable():
    many, fewer = sharding.claims(SHARDS, 2003), sharding.claims(SHARDS[:-1], 2003)
    counts = Counter(many).values()
    assert set(many) == set(range(16)) and max(counts) - min(counts) <= 1
    stayed = sum(a == b for a, b in zip(many, fewer, strict=True) if a != 15) / sum(a != 15 for a in many)
    assert stayed > 0.9


def test_placement_equals_a_plain_one_and_stays_native(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    placed = QUERIES["op10_sharding"](spark, DATA)
    table = sharding.claims(SHARDS)
    for r in placed.collect():
        assert r.shard == SHARDS[table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS]]
    assert placed.count() == docs.count()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    assert sum(r.n_rows for r in sharding.balance(placed).collect()) == docs.count()


def test_odd_keys_and_settings(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("", 4)], "`k.y` string, slot int")
    got = sharding.place(df, "k.y", ["s1", "s2"], 211, into="to").collect()
    assert len(got) == 4 and len({r.to for r in got if r["k.y"] == "a"}) == 1 and {r.slot for r in got} == {1, 2, 3, 4}
    assert sharding.place(df.limit(0), "k.y", ["s1"], 211).count() == 0
    for shards, slots, into in (([], 211, "to"), (["a", "a"], 211, "to"), (["a"], 212, "to"), (["a", "b", "c"], 211, "to"), (["a"], 211, "slot")):
        with pytest.raises(ValueError):
            sharding.place(df, "k.y", shards, slots, into)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ties_between_different_vectors_go_to_the_smaller_id(spark, kind):
    rnd = random.Random(9)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, round(rnd.uniform(-3, 3), 6), round(rnd.uniform(-3, 3), 6)]) for i in range(1, 300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    got = neighbours.search(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.5) for i in range(1, 6)]


def test_scores_of_double_vectors_keep_their_precision(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0 + 1e-12, 3.0]), (2, [1.0, 2.0]), (3, [1e39, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2]
    assert got[1].score == 1.0 + 1e-12 + 3e-9 and got[0].score == 1e39
