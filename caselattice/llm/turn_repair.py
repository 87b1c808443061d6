r"""Conversation repair: the cheapest edits that make each conversation an optional system turn and then pairs of a user's
and an assistant's turn.

A turn's macro edit is a run of inserted turns and then what becomes of the turn itself: kept (K), given another role (R) or
deleted (D), each insertion an I. The 9 macros are a prefix-free code in ASCII order, so two audits of the same turns
compare as their first differing macros do. The search goes by layers, one a turn: for each state (nothing yet, after
system, after user, after assistant) it holds the least cost, a rank among the states in the order of their least audits,
and a pointer to the state before. A step compares (cost, rank before, macro) and ranks anew; no audit string is made until
the pointers are followed back. Costs less the smallest and ranks take few distinct values once states that can no longer
win are dropped, so steps are looked up.

Rows are sorted by range over conversation, turn, role, text and place in the input, so a conversation of any size is cut
to pieces of at most PIECE turns in several tasks. A conversation within one task is repaired there. For others a piece
gives its costs and ranks for each entry state, these are joined from the first piece to the last, pointers are followed
from the last to the first, both as sorted streams, and each piece is then repaired between its two states. Duplicates
across pieces are found by a grouping of digests.

A turn's first fault counts: blank (nothing but space, \t to \r), duplicate (role and text seen earlier in the
conversation), truncated (its last other character is none of `.!?`). Blank and duplicate turns must go (3); another role
costs 2, an inserted empty turn 2, a truncated turn that stays 1.

Defined results: null roles and texts are one space; roles count by their first character; an empty role must be
replaced or go. Turns are in order of `turn`, nulls first; ties by the first 16 characters of the role, the first 64 of the text,
then a hash of both; equal rows are all there, the later ones duplicates. A null conversation id is one conversation. Rows with
`copies` 0 only name their conversation. An empty table gives an empty table; further columns are not read. An audit is a
string and a piece an array, so one conversation's audit ends at the size of a cell (2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.llm.storage import stored

#: Turns and characters of a piece.
PIECE, PIECE_CHARS = 4096, 4_000_000
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted turn, or one whose role is replaced, leads to.
_INTO = (USER, USER, ASSISTANT, USER)
MACROS = sorted("I" * n + edit for n in range(3) for edit in "DKR")
#: Cost and inserted turns by which each state ends.
_ENDS = {NOTHING: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}
#: A turn's kind: 2 * initial (s, u, a, other) + truncated, or one that must go.
GONE = 8
_INITIALS = "sua"


def moves(kind: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, macro) of a turn of this kind."""
    found = []
    for code, macro in enumerate(MACROS):
        for state in range(4):
            at, cost = state, 2 * (len(macro) - 1)
            for _ in macro[:-1]:
                at = _INTO[at]
            if macro[-1] == "D":
                found.append((state, at, cost + 3, code))
            elif kind != GONE:
                to = _INTO[at] if macro[-1] == "R" else _NEXT.get(_INITIALS[kind // 2] if kind < 6 else "", {}).get(at)
                if to is not None:
                    found.append((state, to, cost + (2 if macro[-1] == "R" else 0) + kind % 2, code))
    return found


class Layers:
    """Steps over layers, remembered. A layer is a tuple of (cost or None, rank) a state."""

    def __init__(self) -> None:
        self.moves = [moves(k) for k in range(9)]
        self.known: dict = {}
        self.numbers: dict = {}
        self.layers: list = []

    def number(self, layer: tuple) -> int:
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer]

    def begin(self, state: int) -> int:
        return self.number(tuple((0 if s == state else None, 0) for s in range(4)))

    def step(self, number: int, kind: int) -> tuple[int, int, tuple]:
        """The next layer, what is added to all its costs, and each state's (state before, macro)."""
        key = number * 9 + kind
        if key not in self.known:
            layer, best = self.layers[number], [None] * 4
            for at, to, cost, code in self.moves[kind]:
                if layer[at][0] is not None:
                    entry = (layer[at][0] + cost, layer[at][1], code, at)
                    if best[to] is None or entry < best[to]:
                        best[to] = entry
            if best[ASSISTANT]:
                # After an assistant all turns but a system's go on as from nothing, and all as after a system's turn.
                if best[NOTHING] and best[NOTHING][0] > best[ASSISTANT][0] + 3:
                    best[NOTHING] = None
                if best[SYSTEM] and best[SYSTEM][0] > best[ASSISTANT][0]:
                    best[SYSTEM] = None
            least = min(b[0] for b in best if b)
            order = sorted(b[1:3] for b in best if b)
            after = tuple((b[0] - least, order.index(b[1:3])) if b else (None, 0) for b in best)
            self.known[key] = (self.number(after), least, tuple((b[3], b[2]) if b else None for b in best))
        return self.known[key]

    def run(self, kinds: list[int], entry: int) -> tuple[tuple, int, list]:
        """The last layer, what is added to its costs, and the pointers of every layer."""
        number, total, back = self.begin(entry), 0, []
        for kind in kinds:
            number, more, pointers = self.step(number, kind)
            total += more
            back.append(pointers)
        return self.layers[number], total, back


def chosen_end(layer: tuple) -> int:
    """The state in which the cheapest edits end, ties by least audit."""
    return min((c + _ENDS[s][0], r, s) for s, (c, r) in enumerate(layer) if c is not None)[2]


def edited(back: list, kinds: list[int], turns: list[tuple[str, str]], exit: int, last: bool) -> tuple[str, list[tuple[str, str]]]:
    """The audit of a piece, and its turns as repaired."""
    codes, at = [], exit
    for pointers in reversed(back):
        at, code = pointers[at]
        codes.append(MACROS[code])
    codes.reverse()
    out, state = [], at
    for macro, kind, turn in zip(codes, kinds, turns):
        for _ in macro[:-1]:
            state = _INTO[state]
            out.append((_ROLE[state], ""))
        if macro[-1] == "K":
            state = _NEXT[_INITIALS[kind // 2]][state]
            out.append(turn)
        elif macro[-1] == "R":
            state = _INTO[state]
            out.append((_ROLE[state], turn[1]))
    ending = _ENDS[state][1] if last else ""
    for _ in ending:
        state = _INTO[state]
        out.append((_ROLE[state], ""))
    return "".join(codes) + ending, out


def _initial(role: str) -> str:
    return role[:1]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Of a piece that is part of a longer conversation, what is needed to repair it; else null.
_OPEN = [("kinds", pa.list_(pa.int8())), ("faults", pa.list_(pa.int8())), ("digests", pa.list_(pa.binary())), ("given", _TURNS), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string())]
_OPEN_DDL = "kinds array<tinyint>, faults array<tinyint>, digests array<binary>, given array<struct<role:string,text:string>>, first_turn long, last_turn long, first_role string, last_role string"
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3


def _kind(role: str, fault: int) -> int:
    if fault in (_BLANK, _DUPLICATE):
        return GONE
    return 2 * (_INITIALS.find(role[0]) % 4 if role else 3) + (fault == _TRUNCATED)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the sorted rows (conv_id, turn, role, text, copies, fault) of a task: pieces."""
    search, number = Layers(), TaskContext.get().partitionId() << 33
    key, rows, chars = None, [], 0
    # A task's first conversation may have begun in the one before, and its last may go on in the next.
    begun, open_before, out, waiting = False, True, [], 0

    def close(open_after: bool) -> None:
        nonlocal rows, chars, number
        turns = [(r, t) for _, r, t, _, _ in rows]
        seen, faults = set(), []
        for (_, role, text, _, fault), turn in zip(rows, turns):
            if fault != _BLANK:
                if turn in seen:
                    fault = _DUPLICATE
                seen.add(turn)
            faults.append(fault)
        kinds = [_kind(r, f) for (r, _), f in zip(turns, faults)]
        at = [t for t, *_ in rows if t is not None]
        gaps = at[-1] - at[0] + 1 - len(set(at)) if at else 0
        initials = [_initial(r) for r, _ in turns]
        illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
        row = [key, number, not (open_before or open_after), gaps, faults.count(_BLANK), faults.count(_DUPLICATE), faults.count(_TRUNCATED), illegal]
        if row[2]:
            layer, cost, back = search.run(kinds, NOTHING)
            exit = chosen_end(layer)
            audit, repaired = edited(back, kinds, turns, exit, True)
            row += [cost + layer[exit][0] + _ENDS[exit][0], audit, _as_structs(repaired)] + [None] * len(_OPEN)
        else:
            digests = [None if f in (_BLANK, _DUPLICATE) else hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for (r, t), f in zip(turns, faults)]
            row += [0, None, None, kinds, faults, digests, _as_structs(turns), at[0] if at else None, at[-1] if at else None, turns[0][0] if turns else None, turns[-1][0] if turns else None]
        out.append(row)
        number += 1
        rows, chars = [], 0

    schema = None
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field(0).type), ("piece", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("turns", _TURNS), *_OPEN])
        for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != key:
                close(False)
                open_before = False
            elif begun and copies and (len(rows) >= PIECE or chars >= PIECE_CHARS):
                close(True)
                open_before = True
            key, begun = conv, True
            for _ in range(copies):
                rows.append((turn, role, text, copies, fault))
                chars += len(text)
                waiting += len(text)
            if len(out) >= 1000 or waiting >= 4 * PIECE_CHARS:
                yield _batch(out, schema)
                out, waiting = [], 0
    if begun:
        close(True)
        yield _batch(out, schema)


def _as_structs(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece and entry state, the cost and rank of each exit state; null where it cannot be reached."""
    search = Layers()
    for batch in batches:
        costs, ranks = [], []
        for kinds, repeats in zip(batch.column("kinds").to_pylist(), batch.column("repeats").to_pylist()):
            for at in repeats or ():
                kinds[at] = GONE
            ends = [search.run(kinds, entry)[:2] for entry in range(4)]
            costs.append([None if c is None else c + base for layer, base in ends for c, _ in layer])
            ranks.append([r for layer, _ in ends for _, r in layer])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "piece", "first_turn", "last_turn", "first_role", "last_role")), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], ["conv_id", "piece", "first_turn", "last_turn", "first_role", "last_role", "costs", "ranks"])


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the pieces of conversations in order: each exit state's entry state, the best end if the piece is the last, and
    what lies between a piece and the one before it."""
    begun, key = False, None
    for batch in batches:
        out = []
        for conv, piece, first_turn, last_turn, first_role, last_role, costs, ranks in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != key:
                begun, key = True, conv
                layer, turn, role, spent = [(0, 0), (None, 0), (None, 0), (None, 0)], None, None, 0
            best = [min(((layer[q][0] + costs[4 * q + r], layer[q][1], ranks[4 * q + r], q) for q in range(4) if layer[q][0] is not None and costs[4 * q + r] is not None), default=None) for r in range(4)]
            order = sorted(b[1:3] for b in best if b)
            least = min(b[0] for b in best if b)
            layer = [(b[0] - least, order.index(b[1:3])) if b else (None, 0) for b in best]
            spent += least
            end = chosen_end(tuple(layer))
            gaps = max(0, first_turn - turn - 1) if turn is not None and first_turn is not None else 0
            illegal = int(role is not None and first_role is not None and not _legal(_initial(role), _initial(first_role)))
            out.append((conv, piece, [b[3] if b else None for b in best], end, spent + layer[end][0] + _ENDS[end][0], gaps, illegal))
            turn, role = last_turn if last_turn is not None else turn, last_role if last_role is not None else role
        if out:
            yield _batch(out, pa.schema([("conv_id", batch.schema.field(0).type), ("piece", pa.int64()), ("before", pa.list_(pa.int8())), ("end", pa.int8()), ("spent", pa.int64()), ("more_gaps", pa.int64()), ("more_illegal", pa.int64())]))


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the pieces of conversations from the last to the first: the states between which each is repaired."""
    begun, key, exit = False, None, 0
    for batch in batches:
        out = []
        for conv, piece, before, end, spent, gaps, illegal in zip(*(c.to_pylist() for c in batch.columns)):
            last = not begun or conv != key
            begun, key, exit = True, conv, end if last else exit
            out.append((piece, before[exit], exit, last, spent if last else 0, gaps, illegal))
            exit = before[exit]
        if out:
            yield _batch(out, pa.schema([("piece", pa.int64()), ("entry", pa.int8()), ("exit", pa.int8()), ("last", pa.bool_()), ("cost", pa.int64()), ("more_gaps", pa.int64()), ("more_illegal", pa.int64())]))


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = Layers()
    for batch in batches:
        audits, repaired = [], []
        for kinds, repeats, given, entry, exit, last in zip(*(batch.column(c).to_pylist() for c in ("kinds", "repeats", "given", "entry", "exit", "last"))):
            for at in repeats or ():
                kinds[at] = GONE
            audit, turns = edited(search.run(kinds, entry)[2], kinds, [(t["role"], t["text"]) for t in given], exit, last)
            audits.append(audit)
            repaired.append(_as_structs(turns))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "piece", "last", *_COUNTS)), pa.array(audits, pa.string()), pa.array(repaired, _TURNS)], ["conv_id", "piece", "last", *_COUNTS, "audit", "turns"])


def fault_of(text: Column) -> Column:
    said = F.regexp_extract(text, r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    return F.when(said == "", _BLANK).when(~said.isin(".", "!", "?"), _TRUNCATED).otherwise(0)


def repair(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None = None) -> DataFrame:
    """(conv_id, piece, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): the pieces of each
    conversation in order of `piece`; `whole` are those that are a conversation by themselves. Counts and costs are to be
    summed over a conversation's pieces, audits and turns put together in their order. The column `copies` says how often a row
    stands in its conversation, equal rows next to each other; none: once."""
    kind = rows.schema[conv_id].dataType.simpleString()
    n = F.lit(1) if copies is None else F.col(copies)
    named = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.when(n > 0, F.coalesce(F.col(text), F.lit(" "))).otherwise("").alias("text"),
        n.cast("int").alias("copies"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("conv_id"), F.col("turn"), F.left("role", F.lit(16)), F.left("text", F.lit(64)), F.xxhash64("role", "text"), F.col("place")]
    sorted_rows = named.repartitionByRange(*order).sortWithinPartitions(*order)
    shape = f"conv_id {kind}, piece long, whole boolean, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, turns array<struct<role:string,text:string>>"
    pieces = stored(sorted_rows.select("conv_id", "turn", "role", "text", "copies", fault_of(F.col("text")).alias("fault")).mapInArrow(cut, f"{shape}, {_OPEN_DDL}"))
    parts = pieces.where(~F.col("whole"))
    said = parts.select("conv_id", "piece", F.posexplode("digests").alias("at", "digest")).where("digest IS NOT NULL")
    first = said.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = said.alias("s").join(first.alias("f"), F.col("s.digest").eqNullSafe(F.col("f.digest")) & F.col("s.conv_id").eqNullSafe(F.col("f.conv_id"))).where("piece > first")
    repeats = stored(again.groupBy("piece").agg(F.collect_list("at").alias("repeats")))
    marked = parts.join(repeats, "piece", "left")
    ends = "conv_id", "piece", "first_turn", "last_turn", "first_role", "last_role"
    shown = f"conv_id {kind}, piece long, first_turn long, last_turn long, first_role string, last_role string, costs array<long>, ranks array<int>"
    costs = marked.select("kinds", "repeats", *ends).mapInArrow(summarised, shown)
    onward = costs.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(forward, f"conv_id {kind}, piece long, before array<tinyint>, end tinyint, spent long, more_gaps long, more_illegal long")
    # The way back stays in the tasks of the way there.
    states = onward.sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(backward, "piece long, entry tinyint, exit tinyint, last boolean, cost long, more_gaps long, more_illegal long")
    counted = {
        "gaps": F.col("gaps") + F.col("more_gaps"),
        "illegal": F.col("illegal") + F.col("more_illegal"),
        "duplicate": F.col("duplicate") + F.coalesce(F.size("repeats"), F.lit(0)),
        "truncated": F.col("truncated") - F.coalesce(F.size(F.filter("repeats", lambda at: F.get("faults", at) == _TRUNCATED)), F.lit(0)),
    }
    whole = pieces.where("whole").select("conv_id", "piece", "whole", *_COUNTS, "audit", "turns")
    between = marked.drop("cost").join(states, "piece").withColumns(counted).select("conv_id", "piece", *_COUNTS, "kinds", "repeats", "given", "entry", "exit", "last")
    return whole.unionByName(between.mapInArrow(finished, shape.replace("whole boolean", "last boolean")).withColumn("whole", F.lit(False)).drop("last"))


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation. Pieces of a longer
    one are read as a sorted stream: a digest takes its bytes in order."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where("whole").select("conv_id", *_COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    streamed = pieces.where(~F.col("whole")).select("conv_id", "piece", *_COUNTS, "audit", F.size("turns").alias("n"), lines.alias("lines"))
    return whole.unionByName(streamed.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(joined, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun, key, schema = False, None, None
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field(0).type), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        done = []
        for conv, _, *counts, audit, n, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != key:
                done.append([key, *sums, "".join(audits), digest.hexdigest()])
                begun = False
            if not begun:
                begun, key, sums, audits, digest, some = True, conv, [0] * len(_COUNTS), [], hashlib.sha256(), False
            sums = [a + b for a, b in zip(sums, counts)]
            audits.append(audit)
            if n:
                digest.update((("\n" if some else "") + lines).encode())
                some = True
        if done:
            yield _batch(done, schema)
    if begun:
        yield _batch([[key, *sums, "".join(audits), digest.hexdigest()]], schema)
