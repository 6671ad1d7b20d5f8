"""Conversation structure repair by Knuth's lightest derivation.

A repaired conversation is empty or an optional system message followed by pairs of user and
assistant. Repair items `(place, state)` say that the rows before `place` are repaired and what the
last message is. They are derived by weighted deductions: a row kept or given another role has two
antecedents (the item and the row, whose weight is its fault's cost), a deleted row and an
inserted message have one. A derivation's weight is the pair (cost, audit), the audit being the
edits' initials in order. Every deduction adds to the cost and lengthens the audit, so it is a
superior function and Knuth's agenda applies: the lightest item popped is final, and the search
ends when the goal is popped. Two items of one place and state with equal costs have equally many
insertions, so neither audit begins the other and the order of audits survives any deduction.

The rows of a conversation reach a task as a sorted stream. The agenda works on blocks of `BLOCK`
rows; between blocks only the four states' weights stay, and the part of the audits that all states
share is set aside. Memory is therefore one block and the audits (a character per row), whatever
the length of a conversation. First the plans are made, from rows without their texts; then the
texts pass once, in order, with their conversation's plan before them. The order that a hash of a
whole conversation needs is the reason why one conversation is one stream.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that the agenda looks at together.
BLOCK = 256
#: What a state's last message is: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
COST = {"delete": 4, "insert": 3, "rerole": 3, "truncated": 3}
FAULTS = ("blank", "duplicate", "truncated")
WHITE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """Rows of a conversation table, damaged by the CRC of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role
    "user". Nulls in the role, the text and the CRC's key count as one space. Dropped rows
    are returned with `present` false, so that their conversations are not forgotten. Other
    columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    present = kind != 0
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), F.when(present, text).otherwise("").alias("text"), present.alias("present"), F.explode(copies).alias("_copy")).drop("_copy")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with every null filled and the digest that orders rows of one turn and role."""
    present = F.coalesce("present", F.lit(False)) if "present" in rows.columns else F.lit(True)
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    return filled.withColumn("digest", F.sha2("text", 256))


def lightest(rows: list[tuple[str, int]], seeds: dict[int, tuple[int, str]], goals: tuple[int, ...] | None) -> dict[int, tuple[int, str, int]]:
    """The lightest derivation of the items behind `rows`, from the items before them.

    `rows` are (initial of the role, fault: 0 none, 1 blank, 2 duplicate, 3 truncated); `seeds`
    gives (cost, audit) per state before the first row. Returns state -> (cost, audit, seed's
    state); with `goals` the search ends at the first of these states.
    """
    end, insert = len(rows), COST["insert"]
    agenda = [(cost, audit, 0, state, state) for state, (cost, audit) in seeds.items()]
    # a row is an antecedent of its own, as heavy as keeping it; rows that must go have none
    agenda += [(COST["truncated"] if fault == 3 else 0, "", at, -1, -1) for at, (_, fault) in enumerate(rows) if fault in (0, 3)]
    heapq.heapify(agenda)
    weights: list[int | None] = [None] * end
    items: list[dict[int, tuple[int, str, int]]] = [{} for _ in range(end + 1)]

    def kept(at: int, state: int, item: tuple[int, str, int]) -> None:
        """Deductions from an item and the row behind it: keep it, or give it the role that is due."""
        (cost, audit, seed), initial = item, rows[at][0]
        cost += weights[at]
        due = ASSISTANT if state == USER else USER
        if initial == ("a" if due == ASSISTANT else "u"):
            heapq.heappush(agenda, (cost, audit + "K", at + 1, due, seed))
        else:
            heapq.heappush(agenda, (cost + COST["rerole"], audit + "R", at + 1, due, seed))
            if initial == "s" and state == START:
                heapq.heappush(agenda, (cost, audit + "K", at + 1, SYSTEM, seed))

    while agenda:
        cost, audit, at, state, seed = heapq.heappop(agenda)
        if state < 0:
            weights[at] = cost
            for other, item in items[at].items():
                kept(at, other, item)
            continue
        if state in items[at]:
            continue
        item = items[at][state] = (cost, audit, seed)
        if at == end and goals and state in goals:
            return {state: item}
        if goals or at < end:  # what is inserted between two blocks is derived in the later one
            heapq.heappush(agenda, (cost + insert, audit + "I", at, ASSISTANT if state == USER else USER, seed))
        if at < end:
            heapq.heappush(agenda, (cost + COST["delete"], audit + "D", at + 1, state, seed))
            if weights[at] is not None:
                kept(at, state, item)
    return items[end]


class Plan:
    """Counts and the lightest repair of one conversation, from its rows in order."""

    def __init__(self):
        self.block: list[tuple[str, int]] = []
        self.done: list[str] = []
        self.cost, self.states = 0, {START: (0, "")}
        self.counts = [0] * 4
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if len(self.block) == BLOCK:
            self._settle(None)
        self.block.append((initial, fault))

    def _settle(self, goals: tuple[int, ...] | None) -> None:
        found = {state: (cost, audit) for state, (cost, audit, _) in lightest(self.block, self.states, goals).items()}
        least = min(cost for cost, _ in found.values())
        shared = os.path.commonprefix([audit for _, audit in found.values()])
        self.cost += least
        self.done.append(shared)
        self.states = {state: (cost - least, audit[len(shared) :]) for state, (cost, audit) in found.items()}
        self.block = []

    def result(self) -> tuple:
        self._settle(GOALS)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.done))


PLAN = ["gaps", *FAULTS, "illegal", "cost"]


def repair_plans(rows: DataFrame) -> DataFrame:
    """One row per conversation: `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`.

    `rows` have conv_id, turn, role and text, and may have `present` (false: the row is gone, only
    its conversation counts). They are taken by turn, nulls first, rows of one turn by role and the
    SHA-256 of their text, so repeated rows stand side by side. A row's first fault counts: blank (only white
    space), duplicate (role and text of an earlier row), truncated (its last character that is no
    white space is none of .!?). `illegal` counts neighbours whose role initials are none of su, ua
    and au; `gaps` the turns missing between the least and the greatest, 0 without any. Keeping
    costs 0, another role 3, deleting 4, an inserted empty message 3, a truncated row that stays 3
    more; blank and duplicate rows must be deleted. Of equally cheap repairs the least audit
    (initials of Keep, Rerole, Delete, Insert) in ASCII order is taken. A conversation without rows
    has zeros and an empty audit; rows without a conv_id are one conversation; an empty
    table gives no rows. Nulls in role and text count as one space.
    """
    key = rows.schema["conv_id"]
    schema = T.StructType([key, *[T.StructField(c, T.LongType()) for c in PLAN], T.StructField("audit", T.StringType())])
    tail = F.rtrim("text", F.lit(WHITE))
    slim = _prepared(rows).select("conv_id", "turn", "role", "digest", "present", (tail == "").alias("blank"), F.right(tail, F.lit(1)).isin(".", "!", "?").alias("whole"))
    slim = slim.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("present").desc(), F.col("turn").asc_nulls_first())
    fault = F.when(~F.col("present"), -1).when(F.col("blank"), 1).when(F.row_number().over(seen) > 1, 2).when(~F.col("whole"), 3).otherwise(0)
    # an identical row that is a duplicate follows the one that is not
    ordered = slim.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", F.col("fault") == 2)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_plan, name, found = None, None, []

        def batch_of(results: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*results), types)], names=schema.names)

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * len(PLAN), pa.string()]
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if open_plan is None or conv != name:
                    if open_plan is not None:
                        found.append((name, *open_plan.result()))
                    open_plan, name = Plan(), conv
                if fault >= 0:
                    open_plan.add(turn, initial, fault)
            if found:
                yield batch_of(found)
                found = []
        if open_plan is not None:
            yield batch_of([(name, *open_plan.result())])

    return ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.col("fault").cast("int").alias("fault")).mapInArrow(plan, schema)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: conv_id, `place` (from 0), turn, role, text, `edit`.

    Inserted messages have an empty text and no turn. Rows are those given to `repair_plans`. The
    messages of a conversation are in order within one partition.
    """
    key = rows.schema["conv_id"]
    schema = T.StructType([key, T.StructField("place", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])
    texts = _prepared(rows).where("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    ordered = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, out = None, "", 0, START, 0, []

        def inserted() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = ASSISTANT if state == USER else USER
                out.append((conv, place, None, "assistant" if state == ASSISTANT else "user", "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            for name, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    inserted()
                    conv, audit, at, state, place = name, text, 0, START, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                else:
                    state = ASSISTANT if state == USER else USER
                    role = "assistant" if state == ASSISTANT else "user"
                out.append((name, place, turn, role, text, edit))
                place += 1
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
                out.clear()
        inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)

    return ordered.select("conv_id", "kind", "turn", "role", "text").mapInArrow(apply, schema)


def message_digests(messages: DataFrame) -> DataFrame:
    """SHA-256 of `role:text` lines per conversation of messages as `repaired` returns them."""
    schema = T.StructType([messages.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = running = None
        for batch in batches:
            found = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if running is None or conv != name:
                    if running is not None:
                        found.append((name, running.hexdigest()))
                    name, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.string())], names=schema.names)
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([running.hexdigest()])], names=schema.names)

    return messages.select("conv_id", "role", "text").mapInArrow(digest, schema)


def repair_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """`plans` with `repaired_sha256`, the hash of the repaired messages (of nothing where none are left)."""
    hashes = message_digests(repaired(rows, plans)).withColumnRenamed("conv_id", "_conv")
    joined = plans.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(*plans.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
