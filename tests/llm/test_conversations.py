"""Conversation repair against an exhaustive search and on awkward tables."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T

pytest.importorskip("colonnade.llm")

from colonnade.llm import conversations  # noqa: E402

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.LongType()), T.StructField("kind", T.StringType())])


def cheapest(rows):
    """All edit sequences by recursion: the least (cost, audit) that gives legal initials."""

    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(at, state, inserted):
        found = [(0, "")] if at == len(rows) and state in "ea" else []
        add = lambda cost, edit, rest: found.append((cost + rest[0], edit + rest[1])) if rest else None
        due = "a" if state == "u" else "u"
        if inserted < 2:
            add(3, "I", best(at, due, inserted + 1))
        if at < len(rows):
            initial, fault = rows[at]
            add(4, "D", best(at + 1, state, 0))
            if fault in (0, 3):
                more = 3 if fault == 3 else 0
                add(3 + more, "R", best(at + 1, due, 0))
                if initial == due or (initial == "s" and state == "e"):
                    add(more, "K", best(at + 1, initial, 0))
        return min(found) if found else None

    return best(0, "e", 0)


def planned(rows):
    plan = conversations.Plan()
    for turn, (initial, fault) in enumerate(rows):
        plan.add(turn, initial, fault)
    return plan.result()[-2:]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 256])
def test_plans_are_the_cheapest(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        rows = [(rng.choice("suauaux"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 9))]
        assert planned(rows) == cheapest(tuple(rows))


def test_long_conversations_take_blocks_as_one(monkeypatch):
    rng = random.Random(7)
    for letters in ("u", "ua", "sua", "x"):
        rows = [(rng.choice(letters), rng.choice([0, 0, 3, 1])) for _ in range(3_000)]
        whole = planned(rows)
        monkeypatch.setattr(conversations, "BLOCK", 10_000)
        assert planned(rows) == whole
        monkeypatch.setattr(conversations, "BLOCK", 256)


def expected(rows):
    """The contract, by plain Python."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in held:
            tail = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            marked.append((role[:1], 1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        cost, audit = cheapest(tuple(marked))
        state, at, lines = "e", 0, []
        for edit in audit:
            due = "a" if state == "u" else "u"
            if edit != "D":
                state = marked[at][0] if edit == "K" else due
                role = held[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[due]
                lines.append(f"{role}:{'' if edit == 'I' else held[at][2]}")
            at += edit != "I"
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(f == k for _, f in marked) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(spark, rows):
    df = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    return {r[0]: tuple(r[1:]) for r in conversations.repair_digests(df, conversations.repair_plans(df)).collect()}


def test_awkward_conversations(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(1)
    texts = ["Yes.", "", None, " \t\n", "no end", "Why?  \n", "Long. " * 60_000, "é!", "x" * 300_000]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None, "", "tool", "superuser"]), rng.choice(texts), 1, "k") for c in [*range(40), None] for _ in range(rng.randint(1, 7))]
    rows += rows[:20] + [(900 + c, t, None, None, None, None) for c in range(3) for t in range(8)] + [(None, None, None, None, None, None)]
    rows += [(1_000 + c, 0, "user", "Only.", 1, "k") for c in range(60)]  # some lose their only row
    want = expected(rows)
    assert "" in {w[-2] for w in want.values()}
    got = found(spark, rows)
    wrong = {k: (got.get(k), w) for k, w in want.items() if got.get(k) != w}
    assert not wrong, str(wrong)
    assert len(got) == len(want)


def test_a_conversation_of_many_rows(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t % 700}.", 1, "k") for t in range(900)] + [(2, 0, "user", "a.", 1, "k")]
    assert found(spark, rows) == expected(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    plans = conversations.repair_plans(df)
    assert conversations.repair_digests(df, plans).count() == 0 and conversations.repaired(df, plans).count() == 0


def test_messages_keep_turns_and_edits(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 0, ""), (1, 2, "user", "Ho.", 0, ""), (1, 3, "assistant", " ", 0, "")], SCHEMA)
    got = [tuple(r) for r in conversations.repaired(df, conversations.repair_plans(df)).orderBy("place").collect()]
    assert got == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, 2, "assistant", "Ho.", "R")]
