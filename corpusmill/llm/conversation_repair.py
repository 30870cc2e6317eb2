"""Cheapest repair of damaged conversations: roles, blanks, repeats, cut-off and missing turns.

A turn is kept (0), reroled to user or assistant (1) or deleted (2); empty turns can be inserted (5); blank and repeated turns must go, and a cut-off turn
that stays costs 5 more.  What remains must be empty, or an optional system turn and then user-assistant pairs.  The method is a dynamic program over
the retained turns: deletions before a turn are priced by its number (a prefix sum), so for each state (role of the last retained turn) one running minimum over the possible
next retained turns is enough; the pair of roles tells how many turns are inserted between them.  It runs from the back, so equal prices are
settled by the first edit that differs: deletions before insertions before keeping before reroling (the audit with the least letters).

Rows are range-partitioned by conversation, turn and digest and cut into chunks of bounded rows and bytes, so a conversation of any share of the rows is dealt over many
tasks.  Repeats are found by digests, the first of each by partial minima.  A conversation inside one chunk is solved there.  One that crosses chunks is solved in pieces: each piece gives a 4 x 4
matrix of prices between states, the matrices are composed from the back (a few numbers for each piece), and each piece is solved again with
what follows it.  Only the SHA-256 of such a conversation is made in one task, as a stream of its pieces: a digest can't be divided, and nothing but its state is held.

Null roles and texts are one space.  Turns are in order of ``turn``, nulls first, then of the digest of role and text; repeated rows are next to each other and all but the first are duplicates.  A null
conversation id is a conversation of its own.  Empty texts are blank.  Very long texts make chunks of one row.  Only the columns
``conv_id``, ``turn``, ``role`` and ``text`` are read, so others can have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: A chunk ends with this many rows or bytes of text.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20

#: Prices of the edits.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States: nothing retained yet, or the role of the last retained turn; the others are initials that no state has.
START, SYSTEM, USER, ASSISTANT, OTHER = range(5)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns to insert between a state and the next retained turn's role; pairs that aren't here can't be.
_BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, ASSISTANT): 0, (USER, USER): 1, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
_INTO = {t: [(p, n) for (p, own), n in _BETWEEN.items() if own == t] for t in (SYSTEM, USER, ASSISTANT)}
#: Turns to insert at the end.
_AT_END = (0, 2, 1, 0)
_FINAL = tuple(INSERT * n for n in _AT_END)
_NEVER = 1 << 60
_LEGAL = {"su", "ua", "au"}
_BLANK = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def fault(text: str, repeated: bool) -> int:
    """The first fault of a turn."""
    core = text.rstrip(_BLANK)
    if not core:
        return BLANK
    if repeated:
        return DUPLICATE
    return FINE if core[-1] in ".!?" else TRUNCATED


def solve(turns: Sequence[tuple[int, int]], after: Sequence[int]) -> tuple[tuple, list]:
    """``turns``: (state of the own role, fault) of each; ``after``: the price of all that follows, for each state.

    For each state the best (price, next retained turn, its role) from the first turn on, and the same after each turn.  Prices
    include a deletion for every turn before the next retained one, counted from turn 0."""
    n = len(turns)
    now = tuple((min(after[p] + DELETE * n, _NEVER), n, p) for p in range(4))
    then: list = [None] * n
    for i in range(n - 1, -1, -1):
        own, wrong = turns[i]
        then[i] = now
        if wrong in (BLANK, DUPLICATE):
            continue
        extra = CUT_OFF if wrong == TRUNCATED else 0
        best: list = [None] * 4
        for role in (SYSTEM, USER, ASSISTANT):
            if role != own and role == SYSTEM:
                continue
            price = (0 if role == own else REROLE) + extra + now[role][0] - DELETE
            for p, inserts in _INTO[role]:
                rank = (price + INSERT * inserts, -inserts, role != own)
                if best[p] is None or rank < best[p][0]:
                    best[p] = (rank, role)
        now = tuple((b[0][0], i, b[1]) if b is not None and b[0][0] < old[0] else old for b, old in zip(best, now, strict=True))
    return now, then


def audit_of(turns: Sequence[tuple[int, int]], solved: tuple[tuple, list], state: int, final: bool) -> tuple[str, int]:
    """The edits' initials from a state on, and the state at the end; ``final``: with the insertions at the end."""
    (choice, then), n, at, out = solved, len(turns), 0, []
    step = choice[state]
    while step[1] < n:
        _, i, role = step
        out.append("D" * (i - at) + "I" * _BETWEEN[state, role] + ("K" if turns[i][0] == role else "R"))
        state, at, step = role, i + 1, then[i][role]
    out.append("D" * (n - at) + ("I" * _AT_END[state] if final else ""))
    return "".join(out), state


def applied(audit: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> Iterator[tuple[str, str]]:
    """The turns that edits leave, from a state on."""
    i = 0
    for edit in audit:
        role = "assistant" if state == USER else "user"
        if edit == "I":
            yield role, ""
        else:
            if edit == "K":
                role = roles[i]
            if edit != "D":
                yield role, texts[i]
            i += 1
        if edit != "D":
            state = _STATE[role[:1]]


_LISTS = ("conv_id", "turn", "role", "text", "digest")


def _chunks(most_rows: int, most_bytes: int):
    """A row for each run of rows of a sorted partition; chunks are numbered in the order of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c).combine_chunks()) for c in _LISTS]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists], ["chunk", *_LISTS])

        for batch in batches:
            at = 0
            lengths = batch.column("bytes").to_pylist()
            for i, length in enumerate(lengths):
                if rows and (rows >= most_rows or size + length > most_bytes):
                    held.append(batch.slice(at, i - at))
                    yield packed()
                    number, held, rows, size, at = number + 1, [], 0, 0, i
                rows, size = rows + 1, size + length
            held.append(batch.slice(at))
        if rows:
            yield packed()

    return run


_TOTALS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_PIECE = "chunk bigint, piece int, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, matrix array<bigint>, turns array<int>, roles array<string>, texts array<string>, gaps bigint, cost bigint, audit string, repaired_sha256 string"


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=schema)


def _arrow(spark_schema: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ", 1) for f in spark_schema.split(",")]
    return pa.schema([("conv_id", conv), *((name, kinds[kind]) for name, kind in fields)])


def _sha(lines: Iterator[tuple[str, str]], state=None, begun: bool = False):
    """Update a digest with ``role:text`` lines; returns it and whether any line has been taken."""
    state = state or hashlib.sha256()
    for role, text in lines:
        state.update((("\n" if begun else "") + f"{role}:{text}").encode())
        begun = True
    return state, begun


def _pieces(keep: bool):
    """Solves the conversations inside a chunk; the first and the last, which may go on elsewhere, become pieces.  ``keep``: all turns are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("chunk", "turn", "role", "text", "first")}
                ids = batch.column("conv_id")[row].values
                names = ids.to_pylist()
                first, found = set(one["first"] or ()), []
                cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for piece, (a, b) in enumerate(pairwise(cuts)):
                    roles, texts, turn = one["role"][a:b], one["text"][a:b], [t for t in one["turn"][a:b] if t is not None]
                    turns = [(_STATE.get(r[:1], OTHER), fault(t, i not in first)) for i, r, t in zip(range(a, b), roles, texts, strict=True)]
                    faults = [f for _, f in turns]
                    out = {"conv_id": names[a], "chunk": one["chunk"], "piece": piece, "whole": 0 < a and b < len(names), "low": min(turn, default=None), "high": max(turn, default=None), "distinct": len(set(turn))}
                    out |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": sum(x[:1] + y[:1] not in _LEGAL for x, y in pairwise(roles))}
                    if out["whole"]:
                        solved = solve(turns, _FINAL)
                        audit, _ = audit_of(turns, solved, START, True)
                        out |= {"gaps": out["high"] - out["low"] + 1 - out["distinct"] if turn else 0, "cost": solved[0][START][0], "audit": audit}
                        out["repaired_sha256"] = _sha(applied(audit, START, roles, texts))[0].hexdigest()
                    else:
                        ends = [solve(turns, [0 if q == p else _NEVER for p in range(4)])[0] for q in range(4)]
                        out |= {"matrix": [ends[q][p][0] for p in range(4) for q in range(4)], "turns": [8 * s + f for s, f in turns]}
                        out |= {"first_turn": one["turn"][a], "last_turn": one["turn"][b - 1], "first_initial": roles[0][:1], "last_initial": roles[-1][:1]}
                    if keep or not out["whole"]:
                        out |= {"roles": roles, "texts": texts}
                    found.append(out)
                yield _rows(found, _arrow(_PIECE, ids.type))

    return run


def _composed(pieces: pa.Table) -> pa.Table:
    """All pieces of a conversation, without texts: totals, and for each piece the price of what follows it, by state."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["chunk"], r["piece"]))
    after = [_FINAL]
    for r in reversed(rows):
        m = r["matrix"]
        after.append(tuple(min(m[4 * p + q] + after[-1][q] for q in range(4)) for p in range(4)))
    after.reverse()
    total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(x["last_initial"] + y["first_initial"] not in _LEGAL for x, y in pairwise(rows))
    distinct = sum(r["distinct"] for r in rows) - sum(x["last_turn"] is not None and x["last_turn"] == y["first_turn"] for x, y in pairwise(rows))
    low, high = ([r[k] for r in rows if r[k] is not None] for k in ("low", "high"))
    total |= {"gaps": max(high) - min(low) + 1 - distinct if low else 0, "cost": after[0][START]}
    out = [{"chunk": r["chunk"], "piece": r["piece"], "after": list(after[i + 1]), "final": i + 1 == len(rows), **total} for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("piece", pa.int32()), ("after", pa.list_(pa.int64())), ("final", pa.bool_()), *((f.split()[0], pa.int64()) for f in _TOTALS.split(", "))]))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a piece for each state that it can begin in, and the states that it ends in."""
    for batch in batches:
        audits, ends = [], []
        for codes, after, final in zip(*(batch.column(c).to_pylist() for c in ("turns", "after", "final")), strict=True):
            turns = [divmod(c, 8) for c in codes]
            solved = solve(turns, after)
            own = [audit_of(turns, solved, p, final) for p in range(4)]
            audits.append([a for a, _ in own])
            ends.append([q for _, q in own])
        yield batch.append_column("audits", pa.array(audits, pa.list_(pa.string()))).append_column("ends", pa.array(ends, pa.list_(pa.int32())))


def _begun(pieces: pa.Table) -> pa.Table:
    """The state in which each piece of a conversation begins."""
    state, out = START, []
    for r in sorted(pieces.to_pylist(), key=lambda r: (r["chunk"], r["piece"])):
        out.append({"chunk": r["chunk"], "piece": r["piece"], "state": state})
        state = r["ends"][state]
    return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("piece", pa.int32()), ("state", pa.int32())]))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of conversations: a row for each conversation, of which only digest and audit are held."""
    last = digest = None
    begun, audit = False, []

    def finished() -> pa.RecordBatch:
        return batch_of({c: last[c] for c in totals} | {"conv_id": last["conv_id"], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})

    totals = [f.split()[0] for f in _TOTALS.split(", ")]
    for batch in batches:
        schema = _arrow(f"{_TOTALS}, audit string, repaired_sha256 string", batch.schema.field("conv_id").type)
        batch_of = lambda row, schema=schema: _rows([row], schema)
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if last is None or row["conv_id"] != last["conv_id"]:
                if last is not None:
                    yield finished()
                digest, begun, audit = None, False, []
            edits = row["audits"][row["state"]]
            audit.append(edits)
            digest, begun = _sha(applied(edits, row["state"], row["roles"], row["texts"]), digest, begun)
            last = {c: row[c] for c in ("conv_id", *totals)}
    if last is not None:
        yield finished()


def _solved(turns: DataFrame, keep: bool, chunk_rows: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The conversations that lie inside a chunk, solved; and the pieces of the others, each with its edits, the state it begins in and its conversation's totals."""
    spark, conv = turns.sparkSession, turns.schema["conv_id"].dataType.simpleString()
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role"), some("text"))
    rows = rows.withColumns({"digest": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))), "bytes": F.octet_length("role") + F.octet_length("text")})
    keys = ("conv_id", "turn", "digest")
    dealt = rows.repartitionByRange(store.partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = f"chunk bigint, conv_id array<{conv}>, turn array<bigint>, role array<string>, text array<string>, digest array<binary>"
    chunks, path = store.materialise(dealt.mapInArrow(_chunks(chunk_rows, chunk_bytes), schema), "conversation-chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("conv_id", "digest")).alias("at", "one"))
    firsts = each.groupBy("one.conv_id", "one.digest").agg(F.min(F.struct("chunk", "at")).alias("first")).groupBy("first.chunk").agg(F.collect_list("first.at").alias("first"))  # a chunk's rows at most
    found = chunks.drop("digest").join(firsts, "chunk", "left")
    pieces, pieces_path = store.materialise(found.mapInArrow(_pieces(keep), f"conv_id {conv}, {_PIECE}"), "conversation-pieces")
    store.release(spark, path)

    parts = pieces.filter("not whole")
    small = parts.drop("turns", "roles", "texts", "whole", "gaps", "cost", "audit", "repaired_sha256")
    totals = small.groupBy("conv_id").applyInArrow(_composed, f"chunk bigint, piece int, after array<bigint>, final boolean, {_TOTALS}")
    place = ["chunk", "piece"]
    joined = parts.select("conv_id", *place, "turns", "roles", "texts").join(totals, place)
    audited, _ = store.materialise(joined.mapInArrow(_audits, T.StructType([*joined.schema.fields, *T.StructType.fromDDL("audits array<string>, ends array<int>").fields])), "conversation-audits")
    states = audited.select("conv_id", *place, "ends").groupBy("conv_id").applyInArrow(_begun, "chunk bigint, piece int, state int")
    return pieces.filter("whole"), audited.join(states, place)


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    whole, parts = _solved(turns, False, chunk_rows, chunk_bytes)
    conv = turns.schema["conv_id"].dataType.simpleString()
    streamed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "piece").mapInArrow(_streamed, f"conv_id {conv}, {_TOTALS}, audit string, repaired_sha256 string")
    return whole.select(*streamed.columns).unionByName(streamed)


def repaired_turns(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv_id, chunk, piece, place, role, text): the turns after repair; chunk, piece and place together order a conversation."""
    whole, parts = _solved(turns, True, chunk_rows, chunk_bytes)
    conv = turns.schema["conv_id"].dataType.simpleString()
    both = whole.select("conv_id", "chunk", "piece", "roles", "texts", F.lit(START).alias("state"), "audit").unionByName(parts.select("conv_id", "chunk", "piece", "roles", "texts", "state", F.element_at("audits", F.col("state") + 1).alias("audit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                left = list(applied(r["audit"], r["state"], r["roles"], r["texts"]))
                yield _rows([{"conv_id": r["conv_id"], "chunk": r["chunk"], "piece": r["piece"], "place": k, "role": role, "text": text} for k, (role, text) in enumerate(left)], _arrow("chunk bigint, piece int, place int, role string, text string", batch.schema.field("conv_id").type))

    return both.mapInArrow(run, f"conv_id {conv}, chunk bigint, piece int, place int, role string, text string")


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes away
    its ends of sentences, 3 repeats it, 4 makes it the user's.  Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")
