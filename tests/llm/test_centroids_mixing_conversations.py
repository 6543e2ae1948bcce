import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import centroids, conversations, mixing
from gaugeworks.llm.queries import ORACLES, QUERIES, damaged
from gaugeworks.llm.statements import WORD

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# Centroids


def clustered(rows, k, rounds, length, scale=64):
    """Plain restatement: ``(id, cluster, distance)`` and the centroids."""
    most = centroids.most_component(length)
    kept = [(i, v) for i, v in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [int(max(-most, min(most, np.floor(scale * x)))) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        points = [[sum(column) // len(column) for column in zip(*members[c], strict=True)] if c in members else p for c, p in enumerate(points)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], points


def vectors(seed=1, length=6, count=300):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-3, 3) for _ in range(length)] for _ in range(5)]
    rows = [(i, [m + rnd.gauss(0, 0.4) for m in rnd.choice(middles)]) for i in range(count)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * (length + 1)), (1003, [NAN] + [1.0] * (length - 1)), (1004, [INF] * length), (1005, [None] * length)]
    rows += [(1006, [1e30] * length), (1007, [-1e300] * length), (None, [0.5] * length), (None, [0.5] * length), rows[3], rows[3], (1008, rows[4][1]), (1009, [0.0] * length)]
    return rows


def order(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("k", "pivots"), [(16, 3), (7, 0), (500, 8)])
def test_clusters_are_those_of_plain_search(spark, k, pivots):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, numbers string").repartition(5)
    found, points = centroids.cluster(df, k=k, rounds=3, length=6, pivots=pivots)
    want, centres = clustered(rows, k, 3, 6)
    assert points.points.tolist() == centres
    assert sorted((tuple(r) for r in found.select("id", "cluster", "distance").collect()), key=order) == sorted(want, key=order)
    shown = centroids.described(found, points).collect()
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    assert {r.inertia for r in shown} == {min(sum(inertia.values()), centroids.MOST_LONG)}
    assert all(r.cluster_inertia == min(inertia[r.cluster], centroids.MOST_LONG) for r in shown)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in shown)


def test_pivots_spare_distances_of_far_centroids(spark):
    df = spark.createDataFrame(vectors(3, 4, 400)[:400], "vec_id long, embedding array<double>")
    found, points = centroids.cluster(df, k=16, rounds=2, length=4)
    assert found.agg(F.avg("n_exact")).first()[0] < 0.6 * len(points.points)


def test_far_vectors_tie_towards_the_smaller_centroid():
    points = np.array([[0, 0], [4, 0], [0, 4]])
    pivots = np.array([[0, 0], [100, 3]])
    model = centroids.Centroids(points, centroids._to_pivots(points, pivots))
    x = np.array([[2, 0], [2, 2], [2, 4], [0, 2], [1 << 20, 1 << 20]])
    which, best, _ = model.nearest(x, centroids._to_pivots(x, pivots))
    assert which.tolist() == [0, 0, 2, 0, 1] and best.tolist()[:4] == [4, 8, 4, 4]


def test_no_vectors_give_no_clusters(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    for rows in (df, df.limit(0)):
        found, points = centroids.cluster(rows)
        assert centroids.described(found, points).collect() == [] and len(points.points) == 0


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_source_mixing"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


# Mixing


def filled(sizes, weights, share=1.5, most=2.0):
    total, full = share * sum(sizes), set()
    while True:
        rest = sum(w for i, w in enumerate(weights) if i not in full)
        level = (total - sum(most * sizes[i] for i in full)) / rest if rest else 0
        over = {i for i, w in enumerate(weights) if i not in full and level * w > most * sizes[i]}
        if not over:
            return [most * s if i in full else level * w for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        full |= over


@pytest.fixture(scope="module")
def mixed_docs():
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "é", "", None, "Z"]) if i % 3 else "hot") for i in range(400)]
    rows += [(400, "x " * 9000, "b"), (401, None, "a"), (402, "", "empty"), (None, "p q", "a"), (None, None, None), (403, " \x0b\t", None)]
    return rows + [(404, "again and again", "a")] * 7 + [(405, "a b", "small"), (404, "other text", "a"), (406, "a b c", "Z")]


@pytest.mark.parametrize("block", [1, 64])
def test_mix_takes_every_target(spark, mixed_docs, block):
    df = spark.createDataFrame([(*r, 5, "x") for r in mixed_docs], "doc_id long, text string, source string, size int, target string").repartition(4)
    laid, slots = mixing.planned(df, block=block)
    size = lambda t: len([w for w in (t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w])
    rows = laid.collect()
    assert Counter((r.id, r.size, r.source) for r in rows) == Counter((i, size(t), s) for i, t, s in mixed_docs)
    names = sorted({s for _, _, s in mixed_docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s in mixed_docs if s == n) for n in names]
    targets = dict(zip(names, filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    assert all(r.target == pytest.approx(targets[r.source]) for r in rows)
    mix = mixing.mix(laid, slots, block).collect()
    number = {r.number: r.source for r in rows}
    taken, per_slot, seen, length = Counter(), Counter(), Counter(), {(r.number, r.start): r.size for r in rows if r.size}
    for r in mix:
        assert 0 <= r["from"] < r.to <= length[r.number, r.start]
        taken[number[r.number]] += r.to - r["from"]
        per_slot[r.slot, r.number] += r.to - r["from"]
        for word in range(r["from"], r.to):
            seen[r.number, r.start, r.round, word] += 1
    assert all(taken[s] == int(r.target) for s, r in {r.source: r for r in rows}.items())
    assert max(seen.values()) == 1 and max(r.round for r in mix) <= 1
    assert len({s for s, _ in per_slot}) == len(per_slot)
    assert sum(v != block for v in per_slot.values()) <= len(names)


def test_schedule_keeps_every_prefix_near_the_weights(spark):
    quotas = [100_000, 50_000, 7_000, 300_000, 1]
    sources = spark.createDataFrame(list(enumerate(quotas, 1)), "number long, quota long")
    rows = sorted((tuple(r) for r in mixing.scheduled(sources, 10).select("slot", "number", "rank").collect()))
    assert Counter(n for _, n, _ in rows) == {n: -(-q // 10) for n, q in enumerate(quotas, 1)}
    assert [r for _, n, r in rows if n == 4] == list(range(30_000))
    so_far = Counter()
    for at, (_, n, _) in enumerate(rows, 1):
        so_far[n] += 1
        if at % 500 == 0 and at < len(rows) - 50:
            assert all(abs(so_far[i] - at * q / sum(quotas)) < 12 for i, q in enumerate(quotas, 1))


def test_many_equal_rows_are_laid_out_each(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    df = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d e", "s")], "doc_id long, text string, source string")
    laid, slots = mixing.planned(df, block=4)
    rows = laid.collect()
    assert len(rows) == 51 and len({r.start for r in rows}) == 51
    assert sum(r.to - r["from"] for r in mixing.mix(laid, slots, 4).collect()) == 228


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, None), (2, "", "a")]):
        laid, slots = mixing.planned(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        assert mixing.mix(laid, slots).collect() == []
        assert [(r.size, r.target) for r in laid.collect()] == [(0, 0.0)] * len(rows)


def test_mixing_runs_without_python_workers(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    laid, slots = mixing.planned(df)
    plan = mixing.mix(laid, slots)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert df.filter(mixing.word_count(F.col("text")) != F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))).isEmpty()


# Conversations


def fixed(role):
    return " " if role is None else role


def brute(rows):
    """Counts, cost, audit and repaired lines of one conversation, by search over all edits by cost."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    layer = {"": (0, "", ())}

    def keep(into, state, option):
        if state not in into or option[:2] < into[state][:2]:
            into[state] = option

    for (_, role, text), fault in zip(rows, faults, strict=True):
        for _ in range(3):
            for state, (cost, done, lines) in list(layer.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (state, letter) in grammar:
                        keep(layer, letter, (cost + 2, done + "I", (*lines, f"{name}:")))
        new: dict = {}
        for state, (cost, done, lines) in layer.items():
            keep(new, state, (cost + 3, done + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in grammar:
                keep(new, grammar[state, role[:1]], (cost + extra, done + "K", (*lines, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if (state, name[0]) in grammar:
                    keep(new, name[0], (cost + 2 + extra, done + "R", (*lines, f"{name}:{text}")))
        layer = new
    for _ in range(3):
        for state, (cost, done, lines) in list(layer.items()):
            for letter, name in (("u", "user"), ("a", "assistant")):
                if (state, letter) in grammar:
                    keep(layer, letter, (cost + 2, done + "I", (*lines, f"{name}:")))
    cost, done, lines = min((layer[s] for s in ("", "a") if s in layer), key=lambda o: o[:2])
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, done, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = fixed(role), fixed(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        elif kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "s"]
    texts = ["Yes.", "no", "Why? ", "", None, " \n", "ends!\t", "open ", "é.", "a" * 40 + "1.", "a" * 40 + "0."]
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 9)):
            usual = ("user", "assistant")[turn % 2]
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None, 3]), usual if rnd.random() < 0.6 else rnd.choice(roles), "Fine." if rnd.random() < 0.3 else f"t{rnd.random()}." if rnd.random() < 0.6 else rnd.choice(texts)))
    for conv in range(1000, 1100):
        rows += [(conv, 0, "user", "Hello there."), (conv, 1, "assistant", "Hi.")]
    rows += [(None, 0, "user", "x."), (None, None, None, None), (5000, 10**12, "user", "late."), (5000, 0, "assistant", "early.")]
    rows += [(6000, t, ("user", "assistant")[t % 2] if rnd.random() < 0.8 else "system", f"turn {t}" + rnd.choice([".", ""])) for t in range(3000)]
    rows += [(7000, 0, "user", "w " * 400_000 + "."), rows[0], rows[0]]
    return rows


def test_repairs_equal_a_search_over_all_edits(spark, talks):
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, audit string, state int").repartition(6)
    path = "conversations"
    got = repaired_columns(spark, df, path)
    want = {conv: brute(rows) for conv, rows in damage(talks).items()}
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def repaired_columns(spark, df, name):
    from gaugeworks.session import scratch_path

    folder = scratch_path(spark, name)
    df.write.parquet(f"{folder}/conversations.parquet")
    return QUERIES["op13_conversation_repair"](spark, folder).collect()


def test_conversations_without_turns_and_empty_tables(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repaired_columns(spark, df, "gone")] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repaired_columns(spark, df.limit(0), "none") == []


def test_common_signatures_are_shared_by_salts(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SHARED", 7)
    rows = [(c, t, r, f"{c} {t}.") for c in range(100) for t, r in enumerate(("user", "assistant", "assistant"))]
    found = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 100 and {(r.signature, r.cost, r.audit) for r in found} == {("uaa", 2, "KKIK")}


def test_common_ends_are_computed_once():
    signatures = ["ua" * 50, "s" + "ua" * 50, "d" + "ua" * 50, "du" + "ua" * 50]
    ordered = sorted(signatures, key=lambda s: s[::-1])
    made = [new for _, _, new in conversations.solutions(iter(ordered))]
    assert sum(made) == 100 + 1 + 1 + 2
    for (cost, audit, _), signature in zip(conversations.solutions(iter(ordered)), ordered, strict=True):
        assert (cost, audit) == next((c, a) for c, a, _ in conversations.solutions(iter([signature])))


def test_turns_are_given_in_order(spark, talks):
    df = spark.createDataFrame(talks[:300], "conv_id long, turn long, role string, text string")
    repaired = conversations.repair(df)
    rows = conversations.turns(df, repaired).collect()
    audits = {r.id: r.audit for r in repaired.collect()}
    for conv in {r.id for r in rows}:
        own = [r for r in rows if r.id == conv]
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert "".join(r.edit for r in own) == audits[conv].replace("D", "")
        letters = "".join(r.role[:1] for r in own)
        assert letters.lstrip("s") in ("ua" * (len(own) // 2), "")
    assert damaged(df).columns == ["conv_id", "turn", "role", "text"]
