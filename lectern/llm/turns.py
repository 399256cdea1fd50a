"""Conversation structure repair: the cheapest edits that give a conversation's turns the roles ``(s?(ua)+)?``.

Edits are arcs of a graph whose nodes are (rows read, state); the states are those of that pattern: nothing yet, after a
system turn, after a user's, after an assistant's. Minimum costs from the start and to the end of each node tell which arcs
are tight, that is on some cheapest path; all of these arcs together are an acyclic graph of all cheapest repairs. The path
whose edit letters come first in ASCII order is read off it with a frontier, the set of nodes that the letters so far lead
to: at each step the least letter of the tight arcs out of the frontier is taken.

As Spark jobs: faults need no order but "seen earlier", which is the least turn of each (conversation, role, text), found by
an aggregation and an equi-join whose keys are unique. Rows without their texts are then range-partitioned in order, so that a
conversation of any length spans as many parts as it has to. Minimum costs pass over a part as a 4 x 4 matrix of (min, +), so
each part of a long conversation learns its costs before and behind it from the matrices of the others, and its edits for
every state that it may be entered in. Last, texts meet their edits in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mapped

SPACE = r"\x20\x09-\x0D"
FAR = float("inf")
#: States of the pattern: nothing yet, after s, after u, after a.
START, END = (0, FAR, FAR, FAR), (0, FAR, FAR, 0)
STATES = range(4)
#: Which role fits behind a state, and which state that leads to.
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Costs of the edits: to put a turn in, to take one out, to change its role; and of a turn that stays cut off.
INSERT, DELETE, REROLE, CUT = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """A test's conversations: by the crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` out, 3 repeats it, 4 makes it the user's. Nulls there count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return x.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), times.alias("time")).drop("time")


def steps(state: int, row: tuple | None) -> Iterator[tuple[str, int, int, int]]:
    """Arcs out of a node: (letter, rows read, state, cost). ``row``: (role's initial, whether it must go, whether it is cut
    off); None behind the last row."""
    yield "I", 0, NEXT[state], INSERT
    if row is not None:
        initial, must_go, cut = row
        yield "D", 1, state, DELETE
        if not must_go:
            yield "R", 1, NEXT[state], REROLE + cut * CUT
            if initial == NEXT_ROLE[state][0]:
                yield "K", 1, NEXT[state], cut * CUT
            elif initial == "s" and state == 0:
                yield "K", 1, 1, cut * CUT


def _relaxed(costs: list[float], forward: bool) -> list[float]:
    """Costs of the states of one place, once turns put in there are counted."""
    for _ in range(2):
        for state in STATES:
            a, b = (state, NEXT[state]) if forward else (NEXT[state], state)
            costs[b] = min(costs[b], costs[a] + INSERT)
    return costs


def forward_costs(rows: list[tuple], before: tuple) -> list[list[float]]:
    """Least costs from the start to each node of a part, if the nodes of its first place cost ``before``."""
    out = [_relaxed(list(before), True)]
    for row in rows:
        here = [FAR] * 4
        for state in STATES:
            for _, read, to, cost in steps(state, row):
                if read:
                    here[to] = min(here[to], out[-1][state] + cost)
        out.append(_relaxed(here, True))
    return out


def backward_costs(rows: list[tuple], behind: tuple) -> list[list[float]]:
    """Least costs from each node of a part to the end, if the nodes of its last place cost ``behind``."""
    out = [_relaxed(list(behind), False)]
    for row in reversed(rows):
        here = [min(cost + out[-1][to] for _, read, to, cost in steps(state, row) if read) for state in STATES]
        out.append(_relaxed(here, False))
    return out[::-1]


def least_edits(rows: list[tuple], before: tuple, behind: tuple, last: bool) -> tuple[float, dict[int, tuple[int, str]]]:
    """The least cost of the whole conversation; and for each state that a cheapest repair may enter the part in, the state
    it leaves it in and its letters there. What is put in behind the last row belongs to the next part, if there is one."""
    fore, back = forward_costs(rows, before), backward_costs(rows, behind)
    best = min(f + b for f, b in zip(fore[0], back[0]))
    found = {}
    for entry in STATES:
        if before[entry] + back[0][entry] != best:
            continue
        frontier, letters = {(0, entry)}, []
        while True:
            tight: dict[str, set] = {}
            for i, state in frontier:
                for letter, read, to, cost in steps(state, rows[i] if i < len(rows) else None):
                    if (i < len(rows) or last) and fore[i][state] + cost + back[i + read][to] == best:
                        tight.setdefault(letter, set()).add((i + read, to))
            if not tight:
                break
            letters.append(min(tight))
            frontier = tight[letters[-1]]
        found[entry] = (min(state for _, state in frontier), "".join(letters))
    return best, found


def _expanded(part: list[dict]) -> list[tuple]:
    """A part's rows as ``steps`` reads them, repeated ones each for itself: of those the first may stay."""
    out = []
    for r in part:
        out += [(r["role"][:1], r["blank"] or not r["first"], r["cut"])] + [(r["role"][:1], True, False)] * (r["n"] - 1)
    return out


def _streamed(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of a sorted partition by their key, as they come."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return groupby(rows, itemgetter(*by))


def _facts(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones as one, with their faults: conv, turn, role, h1, h2, blank, cut, n, first."""
    narrow = rows.groupBy("conv", "turn", "role", "h1", "h2").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = narrow.groupBy("conv", "role", "h1", "h2").agg(F.min(order).alias("at")).select(*(F.col(c).alias(f"f_{c}") for c in ("conv", "role", "h1", "h2")), F.col("at.turn").alias("f_turn"), F.lit(True).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv", "turn")] + [F.col(c) == F.col(f"f_{c}") for c in ("role", "h1", "h2")]
    both = same[0]
    for s in same[1:]:
        both = both & s
    return narrow.join(first, both, "left").select(*narrow.columns, F.coalesce("first", F.lit(False)).alias("first"))


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, the least cost from each state before it to each state behind it."""
    for (pid, conv), part in _streamed(batches, ("pid", "conv")):
        rows = _expanded(list(part))
        costs = [[None if x == FAR else int(x) for x in forward_costs(rows, tuple(0 if s == q else FAR for s in STATES))[-1]] for q in STATES]
        schema = pa.schema([("pid", pa.int32()), ("conv", pa.string()), ("costs", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist([{"pid": pid, "conv": str(conv), "costs": [x for row in costs for x in row]}], schema=schema)


def _borders(parts: list[tuple[int, list]]) -> dict[int, tuple[tuple, tuple, bool]]:
    """Of each part of a long conversation, in order, the least costs before and behind it, and whether it is the last."""
    parts = [(pid, [[FAR if x is None else x for x in costs[4 * q : 4 * q + 4]] for q in STATES]) for pid, costs in sorted(parts)]
    before, behind = [START], [END]
    for _, m in parts[:-1]:
        before.append(tuple(min(before[-1][q] + m[q][to] for q in STATES) for to in STATES))
    # A matrix counts what is put in before the first row, and what is put in behind the last one.
    for _, m in parts[:0:-1]:
        behind.append(tuple(min(m[q][to] + behind[-1][to] for to in STATES) for q in STATES))
    return {pid: (b, e, i == len(parts) - 1) for i, ((pid, _), b, e) in enumerate(zip(parts, before, reversed(behind)))}


PLAN = "pid int, entry int, exit int, letters string, cost long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"


def _planned(conv_type: str, borders):
    """Parts to their edits (one row for each state that they may be entered in) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pid, conv), part in _streamed(batches, ("pid", "conv")):
            part = list(part)
            rows = _expanded(part)
            best, found = least_edits(rows, *borders.value.get((pid, str(conv)), (START, END, True)))
            initials, turns = [r[0] for r in rows], [r["turn"] for r in part if r["turn"] is not None]
            counts = {
                "blank": sum(r["n"] for r in part if r["blank"]), "duplicate": sum(r["n"] - r["first"] for r in part if not r["blank"]), "truncated": sum(r["cut"] and r["first"] for r in part if not r["blank"]),
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1], "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            }
            out = [{"conv": conv, "pid": pid, "entry": q, "exit": to, "letters": letters, "cost": int(best)} | counts for q, (to, letters) in found.items()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", conv_type), *((f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in PLAN.split(", "))]))

    return run


def _chained(plans: list[dict]) -> dict:
    """A conversation's counts and edits from those of its parts, in order."""
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    state, letters, low, high, turns, tail = 0, [], None, None, 0, None
    for _, choices in groupby(plans, itemgetter("pid")):
        p = next(x for x in choices if x["entry"] == state)
        state = p["exit"]
        letters.append(p["letters"])
        out |= {c: out[c] + p[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": p["cost"]}
        out["illegal"] += tail is not None and tail + p["head"] not in LEGAL
        tail = p["tail"]
        if p["low"] is not None:
            turns += p["turns"] - (p["low"] == high)  # a turn that goes on behind the border
            low, high = p["low"] if low is None else low, p["high"]
    return out | {"audit": "".join(letters), "gaps": 0 if low is None else high - low + 1 - turns}


def _edited(letters: str, rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """The repaired turns: (letter, role, text)."""
    state = 0
    for letter in letters:
        row = None if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            yield letter, row["role"], row["text"]
            state = 1 if row["role"][:1] == "s" else NEXT[state]
        else:
            yield letter, NEXT_ROLE[state], row["text"] if row else ""
            state = NEXT[state]


def _finished(conv_type: pa.DataType, turns: bool):
    """Conversations (their id, plans, then rows in order) to repaired turns, or to a row of counts each."""
    each = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    counts = [*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    schema = pa.schema([("conv", conv_type), *(each if turns else counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, rows in _streamed(batches, ("conv", "none")):
            plans, first = [], None
            for first in rows:
                if first["kind"] == 2:
                    break
                if first["kind"] == 1:
                    plans.append(first)
            whole = _chained(plans)
            text = (r for part in ([first] if first["kind"] == 2 else [], rows) for r in part)
            digest, head = hashlib.sha256(), b""
            for position, (edit, role, said) in enumerate(_edited(whole["audit"], text)):
                if turns:
                    out.append({"conv": conv[0], "position": position, "edit": edit, "role": role, "text": said})
                    size += len(said)
                    if len(out) >= 4096 or size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                else:
                    digest.update(head + f"{role}:{said}".encode())
                    head = b"\n"
            if not turns:
                out.append({"conv": conv[0], "repaired_sha256": digest.hexdigest()} | whole)
                size += len(whole["audit"])
                if len(out) >= 4096 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: bool = False, ids: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Conversations repaired by the cheapest edits, the first in ASCII order of those that cost the same.

    A conversation's rows go by turn (nulls first), then role and a hash of the text. A row's first fault counts: blank (white
    space alone), duplicate (role and text stood before), truncated (does not end in ``.!?``). Keeping a row costs nothing,
    another role (user or assistant) 3, deleting it 4, an empty turn put in 3; blank and duplicate rows must go, and a
    truncated row that stays costs 3 more. Null roles and texts count as one space; a role is told by its first letter.

    With ``turns``, the repaired turns: ``id_col``, position, edit (K, R or I), role, text. Without, a row for each
    conversation, a null id too: gaps (turns that lack between the first and the last), blank, duplicate, truncated, illegal
    (neighbouring roles other than su, ua, au), cost (long), audit (letters of the edits in order), repaired_sha256 (of
    ``role:text`` in lines). ``ids`` may name conversations that have no rows left: zeros, and the hash of nothing. Rows that
    repeat are each a row; an empty table gives none. Roles and texts are compared as role and 128 bits of hash.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark)
    kind = conversations.schema[id_col].dataType
    conv_type, conv_name = to_arrow_type(kind), kind.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    base = base.select("*", *_hash(F.col("text")))
    faults = base.select("conv", "turn", "role", "h1", "h2", (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"))
    order = ["conv", "turn", "role", "h1", "h2"]
    facts = _facts(faults).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    facts = scratch.write(facts.withColumn("pid", F.spark_partition_id()), "turns-facts")
    in_order = lambda df: df.repartition("pid").sortWithinPartitions("pid", *order)
    # Conversations over several parts are fewer than there are parts, and have twice as many parts at most.
    long = facts.groupBy("conv").agg(F.min("pid").alias("a"), F.max("pid").alias("z")).where("a < z").select(F.col("conv").alias("long"))
    spanning = facts.join(F.broadcast(long), F.col("conv").eqNullSafe(F.col("long"))).drop("long")
    matrices: dict[str, list] = {}
    for r in mapped(in_order(spanning), _matrix, "pid int, conv string, costs array<long>").collect():
        matrices.setdefault(r["conv"], []).append((r["pid"], r["costs"]))
    borders = scratch.broadcast({(pid, conv): b for conv, parts in matrices.items() for pid, b in _borders(parts).items()})
    plans = mapped(in_order(facts), _planned(conv_type, borders), f"conv {conv_name}, {PLAN}")
    plans = scratch.write(plans, "turns-plans")
    named = base.select("conv") if ids is None else ids.select(F.col(id_col).alias("conv"))
    rows = named.distinct().withColumn("kind", F.lit(0))
    rows = rows.unionByName(plans.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(base.withColumn("kind", F.lit(2)), allowMissingColumns=True).withColumn("none", F.lit(0))
    streamed = rows.repartition("conv").sortWithinPartitions("conv", "kind", "pid", "entry", *order[1:])
    out = f"conv {conv_name}, " + ("position long, edit string, role string, text string" if turns else "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return mapped(streamed, _finished(conv_type, turns), out).withColumnRenamed("conv", id_col)
