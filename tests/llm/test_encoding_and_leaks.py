import random
import struct

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import bpe, decontaminate
from gaugeworks.llm.queries import QUERIES, word_tokenizer

SMALL = "/root/testdata/sf0.001"
ODD = [
    "Hello wörld's  don't 'RE ΑΣ İx é <|endoftext|>foo\x1cbar\x85baz a\xa0b १२३ 12 «x» !!'s naïve﻿z ​q", None, "", "   ",
    "<|startoftext|><|endoftext|>", "½²ªº ÀÉ ß×÷ ''s '", "日本語 тест ﬁ Å Å é   x　y", "A" * 5000, "I'll we've\tI'm\r\nhe'd", "a" * 200_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


@pytest.fixture(scope="module")
def rules():
    with open(word_tokenizer(), encoding="utf-8") as file:
        return bpe.WordEncoder(file.read())


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)


def test_odd_texts_are_encoded_as_by_the_library(spark, tokenizer):
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)] + [(None, "null id", 1, 2), (3, "again", 1, 2), (3, "again", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens int").repartition(3)
    got = sorted((r.id or 0, r.n_tokens, r.ids, r.decoded) for r in bpe.encode(docs, word_tokenizer()).collect())
    assert got == sorted((i or 0, *expected(tokenizer, t)) for i, t, *_ in rows)


def test_query_equals_the_library(spark, tokenizer):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        count, ids, decoded = expected(tokenizer, r.text)
        assert got[r.doc_id] == (count, brute.sha(ids), brute.sha(decoded.encode()))


def test_decoding_alone_and_empty_table(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    encoded = bpe.encode(docs, word_tokenizer())
    again = bpe.decode(encoded.withColumnRenamed("decoded", "before"), word_tokenizer()).collect()
    assert all(r.before == r.decoded for r in again)
    assert bpe.encode(docs.limit(0), word_tokenizer()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_of_any_text(tokenizer, rules, text):
    words = rules.words(text)
    assert [i for ids in rules.ids(words).to_pylist() for i in ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def edited(text, edits, rnd):
    letters = list(text)
    for _ in range(edits):
        at, kind = rnd.randrange(1, len(letters) - 1), rnd.choice("ids")
        letters[at:at + (kind != "i")] = [] if kind == "d" else [rnd.choice("abcdefgh")]
    return "".join(letters)


@pytest.fixture(scope="module")
def leaks():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, say(rnd.randint(8, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (53, "zz yy"), (54, "zz yy")]
    docs = [(i, say(150)) for i in range(20)]
    for i, (_, item) in enumerate(items[:12]):
        docs.append((100 + i, f"{say(30)} {item.upper()}!\n{say(30)}"))
        for edits in (2, 6, 12, 20):
            docs.append((200 + 100 * edits + i, f"{say(30)} {edited(item, edits, rnd)} {say(30)}"))
    docs += [(900, None), (901, ""), (902, "zz, YY"), (903, "zzz yy"), (None, items[0][1]), (905, items[1][1]), (905, items[1][1]), (906, f"{items[2][1]} {say(60)} {items[2][1]}")]
    return items, docs


def test_leaks_equal_brute_force(spark, leaks):
    items, docs = leaks
    found = decontaminate.matches(
        spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, item_id string, distance int").repartition(3), spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    got = {(r.id, r.item_id): r.distance for r in sorted(found, key=lambda r: -r.distance)}
    want = {}
    for d, text in docs:
        for i, item in items:
            item_text = decontaminate.normal(item or "")
            if item_text and text:
                distance = brute.edit_distance_inside(item_text, decontaminate.normal(text))
                if distance <= int(decontaminate.RATE * len(item_text)):
                    want[d, i] = distance
    assert got == want
    assert sum(1 for r in found if r.id == 905) == 2 and sum(1 for r in found if r.id == 906) == 2
    texts = dict(docs)
    for r in found:
        if r.distance == 0 and r.id is not None:
            assert decontaminate.normal(texts[r.id][r.start:r.end]) == decontaminate.normal(dict(items)[r.item_id])


def test_slices_of_a_large_benchmark_and_cleaning(spark, leaks, monkeypatch):
    items, docs = leaks
    table, bench = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, id int"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((-1 if r.id is None else r.id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.matches(table, bench).collect())
    left = sorted(-1 if r.doc_id is None else r.doc_id for r in decontaminate.clean(table, bench).collect())
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 700)
    assert sorted((-1 if r.id is None else r.id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.matches(table, bench).collect()) == whole
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in decontaminate.clean(table, bench).collect()) == left
    assert sorted(left) == sorted(i for i in (-1 if i is None else i for i, _ in docs) if i not in {w[0] for w in whole})
    assert decontaminate.clean(table, bench).dtypes == table.dtypes


def test_empty_tables(spark, leaks):
    items, docs = leaks
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.matches(table.limit(0), bench).count() == 0
    assert decontaminate.matches(table, bench.limit(0)).count() == 0
    assert decontaminate.clean(table, bench.limit(0)).count() == len(docs)


def test_leak_query_finds_every_whole_item(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SMALL).collect()}
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if decontaminate.normal(i.text) in decontaminate.normal(d.text)}
    assert whole <= found


def test_words_of_a_block_are_not_held_as_strings(monkeypatch):
    """Cut or whole, a block has the same words; its strings take a fraction of what they did."""
    import tracemalloc

    import public_tokenizers

    from gaugeworks.llm import bpe

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        rules = bpe.WordEncoder(file.read())
    texts = ["", *[" ".join(f"w{(i * j) % 977}" for j in range(400)) for i in range(1500)]]
    got, peaks = [], []
    for most in (10**9, bpe.HELD_WORDS):
        monkeypatch.setattr(bpe, "HELD_WORDS", most)
        tracemalloc.start()
        places, first, words = bpe._distinct(rules, texts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        got.append((places.tolist(), first.tolist(), words.to_pylist()))
    assert got[0] == got[1] and peaks[1] < peaks[0] / 3
