"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from tidegap.llm import structure_repair as repair

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WANTS = {0: "user", 1: "user", 2: "assistant", 3: "user"}
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """One conversation after damage to its row, by trying all edits at every place."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                 "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        judged.append((role, text, fault))
        if fault:
            counts[fault] += 1

    @cache
    def best(i, s, inserts):
        """``(cost, letters, rows)`` of the rest."""
        found = []
        if i == len(judged) and s in (0, 3):
            found.append((0, "", ()))
        if inserts < 3:
            c, said, kept = best(i, AFTER[s], inserts + 1)
            found.append((5 + c, "I" + said, ((WANTS[s], ""),) + kept))
        if i < len(judged):
            role, text, fault = judged[i]
            c, said, kept = best(i + 1, s, 0)
            found.append((2 + c, "D" + said, kept))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                c, said, kept = best(i + 1, AFTER[s], 0)
                found.append((1 + extra + c, "R" + said, ((WANTS[s], text),) + kept))
                if s in GRAMMAR.get(role[:1], {}):
                    c, said, kept = best(i + 1, GRAMMAR[role[:1]][s], 0)
                    found.append((extra + c, "K" + said, ((role, text),) + kept))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    cost, audit, kept = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    body = "\n".join(f"{role}:{text}" for role, text in kept)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256(body.encode()).hexdigest())


def everything(rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    by_conv = {}
    for row in damaged(rows):
        by_conv.setdefault(row[0], []).append(row)
    return out | {conv: plain(own) for conv, own in by_conv.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User", "s", "ärger"]
    texts = ["Yes.", "no", "Well?", " ", "", None, "a!\n", "ends here. \t", "…", "x." * 900, "one\ntwo?"]
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, None, -turn, 3]), rng.choice(roles), rng.choice(texts)))
        for turn in range(rng.randint(0, 8)):
            out.append((conv, 100 + 2 * turn, ["user", "assistant"][turn % 2], f"Good line {rng.randint(0, 3)}."))
    # One conversation with a third of all rows, many of them equal.
    out += [(7, rng.randint(0, 150), rng.choice(roles[:6]), rng.choice(texts + [f"t{i}." for i in range(40)])) for i in range(300)]
    out += [(8, 1, "user", "Same."), (8, 1, "user", "Same.")] * 20
    return out


def table(spark, rows):
    from pyspark.sql import functions as F
    made = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    return made.select("*", *[F.lit("x").alias(c) for c in ("h", "of", "segment", "kind", "copy", "i", "kept", "cost")])


def run(spark, rows, **how):
    conversations = table(spark, rows)
    found = repair.summaries(repair.repair(repair.damage(conversations), **how))
    return repair.all_conversations(conversations, found)


@pytest.mark.parametrize("longest", [repair.SEGMENT, 5, 1])
def test_against_all_edits(spark, rows, longest):
    """Also where conversations are cut into many segments."""
    import sys
    sys.setrecursionlimit(10_000)
    got = {r.conv_id: tuple(r)[1:] for r in run(spark, rows, longest=longest).collect()}
    assert got == everything(rows)


def test_repaired_rows_follow_the_grammar(spark, rows):
    parts = repair.repair(repair.damage(table(spark, rows)), longest=5).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: r.segment):
        whole.setdefault(r.conv_id, []).extend(r.kept)
    for kept in whole.values():
        state = 0
        for role, _ in kept:
            state = GRAMMAR[role[:1]][state]
        assert state in (0, 3)


def test_empty_and_dropped(spark):
    assert run(spark, []).count() == 0
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = run(spark, [(*dropped, "user", "Hello.")]).collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_checkpoints_are_few():
    rows = [("u", ""), ("a", "")] * 5_000
    block, stored = repair.checkpoints(rows, repair.END)
    assert block == 100 and len(stored) == 101
    assert repair.walk(rows, repair.END, [0], True)[0] == ["K" * 10_000]
