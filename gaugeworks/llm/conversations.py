"""Conversation structure repair with a suffix-shared automaton.

A conversation is read as the signature of its turns: per turn one symbol for what repair may do with it, from its
first fault and the first letter of its role. ``(s?(ua)+)?`` is the grammar of the roles that a repair must give.

1. Turns meet by conversation, in order, without their texts: a key of role and text finds duplicates, the rest
   is in the symbols. One signature per conversation leaves, with counts.
2. Equal signatures are solved once. They are sorted by their reverse, so that signatures with a common end
   are neighbours, and each task walks them along one path of a suffix-shared automaton (a DAWG built from the end):
   it goes back to the node of the common end and adds the nodes before it. A node holds, for every state of the
   grammar, the least cost to go and the audit suffix, as its first edit and the cell that follows; both are
   computed when the node is made, once for all signatures of the task that end that way. At one node
   and state every possible edit has another letter, so the first letter settles ties in favour of the ASCII-least audit.
3. Audits go back to their conversations. A signature that very many conversations share is copied to salts.
4. ``turns`` sends texts to their conversations, in order, and applies the audits turn by turn.

A task never holds a conversation: turns stream through it in order. What it keeps of one is a key of 16 bytes a
turn and the signature, and an automaton path as long as the longest signature. The turns of one conversation
are read by one task, since its result is one row.

Defined cases: a null role or text is one space; a null conversation id is a conversation; turns are ordered by
turn (nulls first), role, the first ``SHOWN`` characters and the SHA-256 of the text, and equal rows are duplicates but for the
first; an empty table gives an empty result; very long texts pass once. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import stored

SHOWN = 32
# Conversations with one signature that share a copy of its audit.
SHARED = 10_000

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
# The state after a user or assistant turn that is inserted or given its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
# Symbols: a turn that must go, or the first letter of its role (o for others), in capitals if it is truncated.
GONE = "d"

Cell = tuple[int, str, "Cell | None"]
"""Cost to go, first edit and the cell that follows it."""


def _with_inserts(node: list[Cell | None]) -> tuple[Cell | None, ...]:
    """The node with insertions before its first turn.

    User and assistant states lead to each other and at most one of them gains by it; the other two follow the user state.
    """
    for state in (USER, ASSISTANT, START, SYSTEM):
        after = node[NEXT[state]]
        if after is not None and (node[state] is None or (after[0] + INSERT, "I") < node[state][:2]):
            node[state] = (after[0] + INSERT, "I", after)
    return tuple(node)


FINAL = _with_inserts([(0, "", None) if state in ENDS else None for state in range(4)])


def node_before(symbol: str, node: tuple[Cell | None, ...]) -> tuple[Cell | None, ...]:
    """The automaton node one turn earlier: cells of all grammar states."""
    out: list[Cell | None] = []
    extra = TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        options = [(node[state][0] + DELETE, "D", node[state])]
        if symbol != GONE:
            kept = KEPT.get((state, symbol.lower()))
            if kept is not None:
                options.append((node[kept][0] + extra, "K", node[kept]))
            changed = node[NEXT[state]]
            options.append((changed[0] + REROLE + extra, "R", changed))
        out.append(min(options, key=lambda cell: cell[:2]))
    return _with_inserts(out)


def audit(cell: Cell) -> str:
    letters = []
    while cell[2] is not None:
        letters.append(cell[1])
        cell = cell[2]
    return "".join(letters)


def solutions(signatures: Iterator[str]) -> Iterator[tuple[int, str, int]]:
    """Cost, audit and number of new nodes of every signature; those that follow each other should share ends."""
    path, before = [FINAL], ""
    for signature in signatures:
        shared = 0
        for a, b in zip(reversed(before), reversed(signature), strict=False):
            if a != b:
                break
            shared += 1
        del path[shared + 1:]
        for symbol in reversed(signature[: len(signature) - shared]):
            path.append(node_before(symbol, path[-1]))
        before = signature
        cell = path[-1][START]
        yield cell[0], audit(cell), len(signature) - shared


def _symbols(faults: list[str], initials: list[str]) -> str:
    out = []
    for fault, initial in zip(faults, initials, strict=True):
        letter = initial if initial in ("s", "u", "a") else "o"
        out.append(GONE if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter)
    return "".join(out)


SPACES = " \t\n\x0b\x0c\r"


def _ordered(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` by conversation: each in one partition, in order, without a gap."""
    keys = ("id", "turn", "role", "shown", "key")
    return rows.select("id", "turn", "role", F.left("text", F.lit(SHOWN)).alias("shown"), F.unhex(F.sha2("text", 256)).alias("key"), *columns).repartition("id").sortWithinPartitions(*keys)


def _given(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    whole = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return rows.select(F.col(id).cast("long").alias("id"), F.col(turn).cast("long").alias("turn"), whole(role).alias("role"), whole(text).alias("text"))


SUMMARY = "id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The stretches of equal ids of a batch."""
    if not batch.num_rows:
        return
    ids = batch.column("id")
    valid, values = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
    cuts = np.flatnonzero((np.diff(values) != 0) | (np.diff(valid.astype(np.int8)) != 0)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield ids[start].as_py(), batch.slice(start, stop - start)


class _Reading:
    """What is known of the conversation that is being read."""

    def __init__(self, id):
        self.id, self.seen, self.signature, self.last = id, set(), [], None
        self.turns, self.count = [None, None, 0, None], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def read(self, part: pa.RecordBatch) -> None:
        initials, faults = [], []
        for turn, role, key, state in zip(*(part.column(c).to_pylist() for c in ("turn", "role", "key", "state")), strict=True):
            low, high, distinct, before = self.turns
            if turn is not None and turn != before:
                self.turns = [turn if low is None else low, turn, distinct + 1, turn]
            same = hashlib.blake2b(role.encode() + b"\0" + key, digest_size=16).digest()
            fault = "blank" if state == 2 else "duplicate" if same in self.seen else "truncated" if state else ""
            self.seen.add(same)
            if fault:
                self.count[fault] += 1
            initials.append(role[:1])
            faults.append(fault)
            if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
                self.count["illegal"] += 1
            self.last = role[:1]
        self.signature.append(_symbols(faults, initials))

    def row(self) -> tuple:
        low, high, distinct, _ = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        signature = "".join(self.signature)
        return (self.id, len(signature), gaps, *self.count.values(), signature)


def _summaries(batches: Iterator[pa.RecordBatch]):
    types = [pa.int64()] * 7 + [pa.string()]
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    shaped = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    reading = None
    for batch in batches:
        rows = []
        for id, part in _runs(batch):
            if reading is None or reading.id != id:
                if reading is not None:
                    rows.append(reading.row())
                reading = _Reading(id)
            reading.read(part)
        if rows:
            yield shaped(rows)
    if reading is not None:
        yield shaped([reading.row()])


def signatures(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``SUMMARY`` of every conversation: counts of faults, gaps between turns and illegal neighbours, and its signature."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    state = F.when(last == "", 2).when(~last.isin(".", "!", "?"), 1).otherwise(0).alias("state")
    return _ordered(_given(rows, id, turn, role, text), state).mapInArrow(_summaries, SUMMARY)


def _solve(batches: Iterator[pa.RecordBatch]):
    held: list[str] = []

    def passed():
        for batch in batches:
            for signature in batch.column("signature").to_pylist():
                held.append(signature)
                yield signature

    rows = []
    for solution in solutions(passed()):
        rows.append((held.pop(), *solution))
        if len(rows) == 1024:
            yield _solution_batch(rows)
            rows = []
    if rows:
        yield _solution_batch(rows)


def _solution_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"signature": pa.string(), "cost": pa.int64(), "audit": pa.string(), "new_nodes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def solved(found: DataFrame) -> DataFrame:
    """``signature``, ``cost``, ``audit``, ``new_nodes`` and the number ``n`` of conversations of every distinct signature."""
    distinct = stored(found.groupBy("signature").agg(F.count("*").alias("n")), "distinct")
    near = distinct.select("signature", F.reverse("signature").alias("end")).repartitionByRange("end").sortWithinPartitions("end").select("signature")
    return stored(near.mapInArrow(_solve, "signature string, cost long, audit string, new_nodes long").join(distinct, "signature"), "solved")


def repair(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``SUMMARY`` of every conversation with the ``cost`` and ``audit`` of its cheapest repair."""
    found = stored(signatures(rows, id, turn, role, text), "signatures")
    answers = solved(found).withColumn("copies", F.ceil(F.col("n") / SHARED).cast("long"))
    frequent = stored(answers.filter("copies > 1").select("signature", "copies"), "frequent")
    salted = found.join(frequent, "signature", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), "copies"), F.lit(0)))
    answers = answers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return stored(salted.drop("copies").join(answers.select("signature", "salt", "cost", "audit"), ["signature", "salt"]).drop("salt"), "repaired")


TURNS = "id long, place long, role string, text string, edit string"


def _applied(batches: Iterator[pa.RecordBatch]):
    """Rows of a conversation after a row with its audit: the repaired turns, in order."""
    names = [c.split()[0] for c in TURNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    held: dict = {}

    def shaped(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def step(out: list, row: dict | None) -> None:
        """Applies letters up to the one that takes ``row`` (None: up to the end)."""
        done, state = held["audit"], held["state"]
        while held["at"] < len(done):
            letter = done[held["at"]]
            if letter != "I" and row is None:
                break
            held["at"] += 1
            if letter == "I":
                state = NEXT[state]
                held["place"] += 1
                out.append((held["id"], held["place"], ROLE_OF[state], "", letter))
                continue
            if letter != "D":
                state = KEPT[state, row["role"][:1]] if letter == "K" else NEXT[state]
                held["place"] += 1
                out.append((held["id"], held["place"], row["role"] if letter == "K" else ROLE_OF[state], row["text"], letter))
            break
        held["state"] = state

    for batch in batches:
        out: list = []
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if held:
                    step(out, None)
                held = {"id": row["id"], "audit": row["audit"], "state": START, "at": 0, "place": 0}
            else:
                step(out, row)
        if out:
            yield shaped(out)
    out = []
    if held:
        step(out, None)
    if out:
        yield shaped(out)


def turns(rows: DataFrame, repaired: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``TURNS`` after the audits of ``repaired`` (from ``repair`` of the same rows).

    A conversation's turns are in one partition, in order of ``place`` and without a gap, so that a following ``mapInArrow`` can
    read them as a stream.
    """
    given = _given(rows, id, turn, role, text).select("*", F.lit(None).cast("string").alias("audit"))
    heads = repaired.select("id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    # The row with the audit has a null role, which no turn has, but a turn can have a null number.
    both = given.union(heads).withColumn("first", F.col("audit").isNull())
    keys = ("id", "first", "turn", "role", "shown", "key")
    both = both.select("id", "first", "turn", "role", F.left("text", F.lit(SHOWN)).alias("shown"), F.unhex(F.sha2("text", 256)).alias("key"), "text", "audit")
    return both.repartition("id").sortWithinPartitions(*keys).select("id", "role", "text", "audit").mapInArrow(_applied, TURNS)


def _digests(batches: Iterator[pa.RecordBatch]):
    now = None
    for batch in batches:
        ids, digests = [], []
        for id, part in _runs(batch):
            if now is None or now[0] != id:
                if now is not None:
                    ids.append(now[0])
                    digests.append(now[1].hexdigest())
                now = (id, hashlib.sha256())
            for place, role, text in zip(*(part.column(c).to_pylist() for c in ("place", "role", "text")), strict=True):
                now[1].update((b"\n" if place > 1 else b"") + f"{role}:{text}".encode())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], names=["id", "sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1].hexdigest()])], names=["id", "sha256"])


def digests(repaired_turns: DataFrame) -> DataFrame:
    """SHA-256 of the lines ``role:text`` of every conversation that ``turns`` left something of."""
    return repaired_turns.mapInArrow(_digests, "id long, sha256 string")
