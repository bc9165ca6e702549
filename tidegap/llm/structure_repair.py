"""Repair of conversations by cheapest edits, with a square-root checkpointed DP.

A repaired conversation is empty, or an optional system row and then user and assistant in
turn. Walking over the rows, four states tell what has been written: nothing, the system
row, a user row, an assistant row. The cheapest cost from a state to the end of the
conversation follows backwards from row to row. Of these cost vectors only every
``sqrt(n)``-th is stored; walking forward, the vectors of one block are computed again from
the checkpoint behind it, and of the edits that keep the cost tight the first letter in
ASCII order is taken. So a run of ``n`` rows needs memory for ``sqrt(n)`` vectors.

Rows are sorted over all tasks by conversation and turn, so a task holds whole
conversations but for the one at each of its edges. Those, and any with more rows than a
segment, are cut into segments. A segment is a table of costs from each of the four
states to each, so its cost vectors at both ends follow from a short chain over the
conversation's segments; then it is walked from each state at once, and a second chain
tells which walk counts. A conversation with a third of all rows is spread like the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidegap.cluster import pin

# Costs of edits, and of a cut-off row that stays.
RE_ROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows and characters of a segment.
SEGMENT, CHARACTERS = 65_536, 8 << 20
#: State after a user or assistant row is written, by the state before.
NEXT = (2, 2, 3, 2)
#: By the initial of a role, the state that a kept row leads to from each state.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEVER = 1 << 60
STATES = range(4)
_SPACE = " \t\n\v\f\r"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]


def fault(text: str, seen: bool) -> str:
    """``blank``, ``duplicate``, ``truncated`` or nothing."""
    text = text.rstrip(_SPACE)
    if not text:
        return "blank"
    return "duplicate" if seen else "" if text[-1] in ".!?" else "truncated"


def with_inserts(v: list[int]) -> list[int]:
    """The cost vector when rows may be inserted first."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant]


END = with_inserts([0, NEVER, NEVER, 0])


def before(row: tuple[str, str], v: list[int]) -> list[int]:
    """The cost vector before a row ``(initial, fault)``, from that behind it."""
    initial, wrong = row
    if wrong == "blank" or wrong == "duplicate":
        return with_inserts([DELETE + c for c in v])
    stays = CUT_OFF if wrong else 0
    found = [min(DELETE + v[s], RE_ROLE + stays + v[NEXT[s]]) for s in STATES]
    for s, to in enumerate(KEPT.get(initial, ())):
        if to is not None:
            found[s] = min(found[s], stays + v[to])
    return with_inserts(found)


def checkpoints(rows: list[tuple[str, str]], end: list[int]) -> tuple[int, list[list[int]]]:
    """Length of a block and the cost vector before each block, and behind the last."""
    block = max(1, isqrt(len(rows)))
    stored, v = [end], end
    for i in range(len(rows) - 1, -1, -1):
        v = before(rows[i], v)
        if i % block == 0:
            stored.append(v)
    return block, stored[::-1]


def _step(row: tuple[str, str], s: int, v: list[int], after: list[int]) -> tuple[str, int]:
    """The edits before and of one row from state ``s``, and the state behind it."""
    initial, wrong = row
    stays = CUT_OFF if wrong else 0
    said = ""
    while True:
        if DELETE + after[s] == v[s]:
            return said + "D", s
        if INSERT + v[NEXT[s]] == v[s]:
            said, s = said + "I", NEXT[s]
            continue
        to = KEPT[initial][s] if initial in KEPT else None
        if to is not None and stays + after[to] == v[s]:
            return said + "K", to
        return said + "R", NEXT[s]


def walk(rows: list[tuple[str, str]], end: list[int], starts: list[int], last: bool) -> list[tuple[str, int]]:
    """Tight edits, ASCII-least, and the state they end in, from each of ``starts``.

    ``end`` is the cost vector behind the rows. Of states that cannot reach the end the
    edits mean nothing.
    """
    block, stored = checkpoints(rows, end)
    states, said = list(starts), [[] for _ in starts]
    for number, first in enumerate(range(0, len(rows), block)):
        part = rows[first:first + block]
        vectors = [stored[number + 1]]
        for row in reversed(part):
            vectors.append(before(row, vectors[-1]))
        vectors.reverse()
        for i, row in enumerate(part):
            moves = {s: _step(row, s, vectors[i], vectors[i + 1]) for s in set(states)}
            for j, s in enumerate(states):
                edits, states[j] = moves[s]
                said[j].append(edits)
    if last:
        for j in range(len(states)):
            while end[states[j]] > 0:
                said[j].append("I")
                states[j] = NEXT[states[j]]
    return ["".join(own) for own in said], states


def written(rows: list[tuple], edits: str, state: int) -> list[tuple[str, str]]:
    """``(role, text)`` of the repaired rows; ``state`` is that before the first."""
    out, at = [], 0
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append((("user", "assistant")[state - 2], ""))
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            state = KEPT[role[:1]][state]
            out.append((role, text))
        elif edit == "R":
            state = NEXT[state]
            out.append((("user", "assistant")[state - 2], text))
    return out


def _counts(rows: list[tuple], faults: list[str]) -> dict:
    """What can be counted within a segment."""
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(pair not in _LEGAL for pair in zip(initials, initials[1:])), "cost": 0,
            "turns": len(set(turns)), "min_turn": min(turns, default=None), "max_turn": max(turns, default=None)}


_KEPT = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_FIELDS = {"segment": ("bigint", pa.int64()), "whole": ("boolean", pa.bool_()), "edits": ("string", pa.string()),
           "sha256": ("string", pa.string()), "kept": ("array<struct<role:string,text:string>>", _KEPT),
           "rows": ("array<struct<turn:bigint,role:string,text:string>>", _ROWS),
           **{c: ("bigint", pa.int64()) for c in [*_COUNTS, "min_turn", "max_turn"]}}


def _digest(kept: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in kept).encode()).hexdigest()


def _segments(longest: int):
    """The function from sorted rows to repaired whole conversations, and segments of those
    that may go on in another task or have more than ``longest`` rows."""

    def run_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = TaskContext.get().partitionId() << 32, None
        out: list[dict] = []
        run: list[tuple] = []
        size, edge, now, held = 0, True, None, 0  # ``edge``: the run is the task's first, or was cut

        def close(whole: bool) -> None:
            nonlocal number, run, size, held
            if not run:
                return
            row = {"conv_id": now, "segment": number, "whole": whole}
            if whole:
                seen: set = set()
                faults = []
                for _, role, text in run:
                    faults.append(fault(text, (role, text) in seen))
                    seen.add((role, text))
                codes = [(role[:1], f) for (_, role, _), f in zip(run, faults)]
                (edits,), _ = walk(codes, END, [0], True)
                kept = written(run, edits, 0)
                row |= _counts(run, faults) | {"edits": edits, "sha256": _digest(kept), "kept": kept}
                row["cost"] = _cost(codes)
            else:
                row["rows"] = run
            out.append(row)
            held += size + len(run)
            number, run, size = number + 1, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            made = [pa.array([r["conv_id"] for r in out], kind)]
            for name, (_, t) in _FIELDS.items():
                values = [r.get(name) for r in out]
                if name in ("kept", "rows"):
                    names = [f.name for f in t.value_type]
                    values = [None if v is None else [dict(zip(names, x)) for x in v] for v in values]
                made.append(pa.array(values, t))
            out, held = [], 0
            return pa.RecordBatch.from_arrays(made, names=["conv_id", *_FIELDS])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if (run or number & 0xFFFFFFFF) and row[0] != now:
                    close(not edge)
                    edge = False
                elif size >= CHARACTERS or len(run) >= longest:
                    edge = True
                    close(False)
                now = row[0]
                run.append(row[1:])
                size += len(row[3])
                if held >= CHARACTERS:
                    yield flush()
        close(False)
        if out:
            yield flush()

    return run_of


def _cost(codes: list[tuple[str, str]]) -> int:
    v = END
    for row in reversed(codes):
        v = before(row, v)
    return v[0]


def _open_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Segment number, rows and faults of each open segment."""
    for i in range(batch.num_rows):
        rows = [(r["turn"], r["role"], r["text"]) for r in batch["rows"][i].as_py()]
        again = set(batch["again"][i].as_py() or ())
        faults = [fault(text, j in again) for j, (_, _, text) in enumerate(rows)]
        yield i, rows, faults, [(role[:1], f) for (_, role, _), f in zip(rows, faults)]


_TABLE = ("segment bigint, table array<bigint>, first string, last string, first_turn bigint, last_turn bigint, "
          + ", ".join(f"{c} bigint" for c in [*_COUNTS, "min_turn", "max_turn"]))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per open segment the cost from each state before it to each behind it, and its counts."""
    for batch in batches:
        found = []
        for i, rows, faults, codes in _open_rows(batch):
            columns = []
            for to in STATES:
                v = [0 if s == to else NEVER for s in STATES]
                for row in reversed(codes):
                    v = [min(c, NEVER) for c in before(row, v)]
                columns.append(v)
            found.append({"segment": batch["segment"][i].as_py(), "table": [c[s] for s in STATES for c in columns],
                          "first": rows[0][1][:1], "last": rows[-1][1][:1], "first_turn": rows[0][0],
                          "last_turn": rows[-1][0], **_counts(rows, faults)})
        yield pa.RecordBatch.from_pylist(found, schema=_arrow(_TABLE))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


_END = "segment bigint, after array<bigint>, is_last bigint, alone bigint, cost bigint, joint bigint, same_turn bigint"


def _ends(group: pa.Table) -> pa.Table:
    """Cost vectors behind the segments of a conversation, and what its joints add to the counts."""
    rows = sorted(group.to_pylist(), key=lambda r: r["segment"])
    v, found = END, []
    for k in range(len(rows) - 1, -1, -1):
        row, prior = rows[k], rows[k - 1] if k else None
        table = row["table"]
        after, v = v, [min(table[4 * s + t] + v[t] for t in STATES) for s in STATES]
        found.append({"segment": row["segment"], "after": after, "is_last": int(k == len(rows) - 1), "alone": int(len(rows) == 1),
                      "cost": v[0] if k == 0 else 0,
                      "joint": int(prior is not None and (prior["last"], row["first"]) not in _LEGAL),
                      "same_turn": int(prior is not None and row["first_turn"] is not None
                                       and prior["last_turn"] == row["first_turn"])})
    return pa.Table.from_pylist(found, schema=_arrow(_END))


_WALK = "segment bigint, edits array<string>, states array<bigint>"


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for i, _, _, codes in _open_rows(batch):
            edits, states = walk(codes, batch["after"][i].as_py(), list(STATES), batch["is_last"][i].as_py() == 1)
            found.append({"segment": batch["segment"][i].as_py(), "edits": edits, "states": states})
        yield pa.RecordBatch.from_pylist(found, schema=_arrow(_WALK))


def _starts(group: pa.Table) -> pa.Table:
    """The state before each segment of a conversation."""
    state, found = 0, []
    for row in sorted(group.to_pylist(), key=lambda r: r["segment"]):
        found.append({"segment": row["segment"], "state": state})
        state = row["states"][state]
    return pa.Table.from_pylist(found, schema=_arrow("segment bigint, state bigint"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for rows, edits, state in zip(batch["rows"], batch["edits"].to_pylist(), batch["state"].to_pylist()):
            rows = [(r["turn"], r["role"], r["text"]) for r in rows.as_py()]
            kept.append([{"role": r, "text": t} for r, t in written(rows, edits, state)])
        yield pa.RecordBatch.from_arrays([batch["segment"], pa.array(kept, _KEPT)], names=["segment", "kept"])


def _repair_open(segments: DataFrame) -> DataFrame:
    """The columns of whole conversations, but ``sha256``, for segments of the others."""
    rows = segments.select("conv_id", "segment", "rows")
    each = rows.select("conv_id", "segment", F.posexplode("rows").alias("i", "r")).select(
        "conv_id", "segment", "i", F.col("r.role").alias("role"), F.md5(F.col("r.text").cast("binary")).alias("h"))
    place = F.struct("segment", "i")
    first = (each.groupBy("conv_id", "role", "h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").toDF("_conv_id", "role", "h", "first", "n"))
    again = (each.join(first, [each.conv_id.eqNullSafe(first["_conv_id"]), each.role == first.role, each.h == first.h])
             .where(place > F.col("first")).groupBy("segment").agg(F.collect_list("i").alias("again")))
    known = pin(rows.join(again, "segment", "left"), "open")
    tables = pin(known.select("conv_id", "segment").join(
        known.select("segment", "rows", "again").mapInArrow(_tables, _TABLE), "segment"), "tables")
    chain = ["conv_id", "segment"]
    ends = pin(tables.select(*chain, "table", "first", "last", "first_turn", "last_turn")
               .groupBy("conv_id").applyInArrow(_ends, _END), "ends")
    walks = pin(known.join(ends, "segment").select("segment", "rows", "again", "after", "is_last")
                .mapInArrow(_walks, _WALK), "walks")
    starts = (known.select(*chain).join(walks.select("segment", "states"), "segment")
              .groupBy("conv_id").applyInArrow(_starts, "segment bigint, state bigint"))
    chosen = pin(walks.join(starts, "segment").select(
        "segment", F.get("edits", F.col("state").cast("int")).alias("edits"), "state"), "edits")
    kept = (known.join(chosen, "segment").select("segment", "rows", "edits", "state")
            .mapInArrow(_write, "segment bigint, kept array<struct<role:string,text:string>>"))
    joints = ends.select("segment", F.col("cost").alias("whole_cost"), "joint", "same_turn", "alone")
    return (tables.join(joints, "segment").join(chosen.select("segment", "edits"), "segment").join(kept, "segment")
            .select("conv_id", "segment", "edits", "kept", "blank", "duplicate", "truncated",
                    (F.col("illegal") + F.col("joint")).alias("illegal"), F.col("whole_cost").alias("cost"),
                    (F.col("turns") - F.col("same_turn")).alias("turns"), "min_turn", "max_turn", "alone"))


def repair(conversations: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """Repaired conversations of ``conversations(conv_id, turn, role, text)``, a row for each segment.

    ``conv_id, segment, edits, kept`` (``role``, ``text`` of the repaired rows), ``sha256``
    (of the repaired rows; null where a conversation has several segments), ``blank,
    duplicate, truncated, illegal, cost, turns, min_turn, max_turn``. Sums over the
    segments are those of the conversation; ``segment`` orders them. All but conversations
    at the edge of a task, or longer than a segment, have one.

    Rows are taken by turn, nulls first, then by role and MD5 of the text, so equal rows
    follow each other. A null role or text is one space; a null ``conv_id`` is a
    conversation of its own. Conversations of more than ``longest`` rows are cut, none is sampled. Other columns
    are ignored; an empty table gives no rows.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "h"]
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"))
    # Copies of one row from different tasks may go to different tasks.
    rows = rows.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("of", F.spark_partition_id())
    dealt = rows.repartitionByRange(*order, "of").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, " + ", ".join(f"{name} {ddl}" for name, (ddl, _) in _FIELDS.items())
    found = pin(dealt.select("conv_id", "turn", "role", "text").mapInArrow(_segments(longest), schema), "segments")
    done = found.where("whole").select("conv_id", "segment", "edits", "kept", "sha256", *_COUNTS, "min_turn", "max_turn")
    rest = _repair_open(found.where("not whole"))
    return done.unionByName(rest.withColumn("sha256", F.when(F.col("alone") == 1, _sha256(F.col("kept")))).drop("alone"))


def _sha256(kept: Column) -> Column:
    return F.sha2(F.array_join(F.transform(kept, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"), 256)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the sorted segments of each conversation; one digest is held at a time."""
    now, digest, some, kind, out = None, None, False, None, []
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, kept in zip(batch["conv_id"].to_pylist(), batch["kept"]):
            if digest is None or conv_id != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, some = conv_id, hashlib.sha256(), False
            for row in kept.as_py():
                digest.update(("\n" if some else "").encode() + f"{row['role']}:{row['text']}".encode())
                some = True
    if digest is not None:
        out.append((now, digest.hexdigest()))
        ids, shas = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas)], names=["_conv_id", "long_sha256"])


def summaries(segments: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`: counts, ``gaps``, ``audit``, ``repaired_sha256``.

    The digest of a conversation in several segments is taken in order, in one pass that
    holds no more than a segment: SHA-256 has no other way.
    """
    kind = dict(segments.dtypes)["conv_id"]
    segments = pin(segments, "repaired")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "edits"))), lambda s: s["edits"]), "")
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    one = segments.groupBy("conv_id").agg(
        *sums, F.min("min_turn").alias("low"), F.max("max_turn").alias("high"), audit.alias("audit"),
        F.max("sha256").alias("sha256"))
    long = (segments.where("sha256 is null").select("conv_id", "segment", "kept").repartition("conv_id")
            .sortWithinPartitions("conv_id", "segment").select("conv_id", "kept")
            .mapInArrow(_running, f"_conv_id {kind}, long_sha256 string"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return one.join(long, one.conv_id.eqNullSafe(long["_conv_id"]), "left").select(
        "conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", "long_sha256").alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the contract's faults, by CRC-32 of ``conv_id:turn``.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats
    it and 4 makes it a user's. Nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return (conversations.select("conv_id", "turn", space("role").alias("role"), "text", kind.alias("kind"))
            .where("kind <> 0")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text")))


def all_conversations(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """``repaired`` with a row of zeros for each conversation that it lacks."""
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("there")).select(F.col("conv_id").alias("_conv_id"))
    found = ids.join(repaired, ids["_conv_id"].eqNullSafe(repaired.conv_id), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(
        F.col("_conv_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
