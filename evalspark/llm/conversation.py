"""Repair of conversations by the cheapest edits that give a legal order of roles.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Backward vectors hold, for each state of that
automaton, what the rest costs at least.  They are stored at every square root of the rows only; the walk forward computes each
stretch between two of them anew and takes the ASCII-least edit that costs no more than its vector allows.

Rows are sorted by conversation over range partitions, so one conversation may fill many.  A segment (the rows of a
conversation in one partition) then acts like a row: a matrix of least costs from state to state.  Chains of such segments
meet at partition borders only, so at most two small rows per partition reach the driver, which gives each segment
the vector after it and the state before it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

# White space, the ends of sentences, and what edits cost.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

OK, BLANK, DUPLICATE, CUT_SHORT, ABSENT = range(5)  # first fault of a row; an absent row only names its conversation
STATES = 4  # nothing yet, after s, after u, after a
LEGAL = {"su", "ua", "au"}
_FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = {s: (role, _FOLLOWS[s, role[0]]) for s, role in enumerate(("user", "user", "assistant", "user"))}
_PREFIX = 64  # characters of a text that the order of equal turns and roles looks at before its digest
_PIECE_ROWS, _PIECE_CHARS = 10_000, 4_000_000
_NEVER = 1 << 60

_LEFT = [0, 0, 0, 0]
Vector = list[int]


def _closed(v: Vector) -> Vector:
    """The vector where rows may be inserted first; two rows lead from any state to any that rows can lead to."""
    v = list(v)
    for _ in range(2):
        for s in range(STATES):
            v[s] = min(v[s], INSERT + v[_WANTED[s][1]])
    return v


END = _closed([0, _NEVER, _NEVER, 0])


def _edits(initial: str, fault: int) -> list[list[tuple[str, int, int, str | None]]]:
    """What may be done to a row in each state, without insertions: (initial of the edit, cost, state after it, new role)."""
    out = []
    for s in range(STATES):
        edits: list[tuple[str, int, int, str | None]] = [("D", DELETE, s, None)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_SHORT else 0
            if (s, initial) in _FOLLOWS:
                edits.append(("K", KEEP + more, _FOLLOWS[s, initial], None))
            role, after = _WANTED[s]
            edits.append(("R", REROLE + more, after, role))
        out.append(edits)
    return out


_EDITS = {(i, f): _edits(i, f) for i in ("s", "u", "a", "") for f in (OK, BLANK, DUPLICATE, CUT_SHORT)}


def _before(v: Vector, kind: tuple[str, int], copies: int) -> Vector:
    """The vector before a row and its further copies (which are blank or duplicates, so they go), from the one after it."""
    rest = DELETE * (copies - 1)
    return _closed([min(cost + v[t] for _, cost, t, _ in edits) + rest for edits in _EDITS[kind]])


@dataclass
class _Segment:
    """Rows of one conversation in one partition, in order; texts only where they are needed."""

    conv: object
    kinds: list[tuple[str, int]] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def costs(self) -> list[Vector]:
        """Least cost from each state before to each state after: the matrix of the segment, by rows."""
        columns = []
        for t in range(STATES):
            v = _closed([0 if s == t else _NEVER for s in range(STATES)])
            for kind, n in zip(reversed(self.kinds), reversed(self.copies)):
                v = _before(v, kind, n)
            columns.append(v)
        return [[columns[t][s] for t in range(STATES)] for s in range(STATES)]

    def walk(self, state: int, end: Vector, last: bool) -> Iterator[tuple[int, str, int, str | None, int]]:
        """The least edits from ``state``: (row or -1, initial, cost, new role, state after); copies are not listed."""
        n = len(self.kinds)
        stride = math.isqrt(n) + 1
        marks = {n: end}
        v = end
        for i in range(n - 1, -1, -1):
            v = _before(v, self.kinds[i], self.copies[i])
            if i % stride == 0:
                marks[i] = v
        for first in range(0, n, stride):
            stop = min(n, first + stride)
            block = [marks[stop]]
            for i in range(stop - 1, first - 1, -1):
                block.append(_before(block[-1], self.kinds[i], self.copies[i]))
            block.reverse()
            for i in range(first, stop):
                now, after, rest = block[i - first], block[i - first + 1], DELETE * (self.copies[i] - 1)
                while True:
                    role, t = _WANTED[state]
                    choices = [(e, c, s, r, c + rest + after[s]) for e, c, s, r in _EDITS[self.kinds[i]][state]]
                    choices.append(("I", INSERT, t, role, INSERT + now[t]))
                    edit, cost, then, new, _ = min(c for c in choices if c[4] == now[state])
                    state = then
                    yield -1 if edit == "I" else i, edit, cost, new, state
                    if edit != "I":
                        break
        while last and state not in (0, 3):
            role, state = _WANTED[state]
            yield -1, "I", INSERT, role, state

    def exit(self, state: int, end: Vector) -> int:
        for *_, state in self.walk(state, end, False):
            pass
        return state


def _segments(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[_Segment]:
    """Rows (conv, turn, role, fault, copies[, text]) of one partition as segments; absent rows only name theirs."""
    now = None
    for batch in batches:
        rows = batch.to_pydict()
        for k, conv in enumerate(rows["conv"]):
            if now is None or not _same(now.conv, conv):
                if now is not None:
                    yield now
                now = _Segment(conv)
            if rows["fault"][k] == ABSENT:
                continue
            role = rows["role"][k]
            now.kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "", rows["fault"][k]))
            now.copies.append(rows["copies"][k])
            now.turns.append(rows["turn"][k])
            now.roles.append(role)
            if texts:
                now.texts.append(rows["text"][k])
    if now is not None:
        yield now


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def _ends(segments: Iterator[_Segment]) -> Iterator[tuple[int, _Segment]]:
    """(0, the first segment) and (1, the last); a segment alone comes as (0, it)."""
    first = next(segments, None)
    if first is not None:
        yield 0, first
        last = None
        for last in segments:
            pass
        if last is not None:
            yield 1, last


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, present) with their first fault and the number of equal rows, of which one stays.

    Equal rows are counted before anything else, and the first turn of each text and role comes back to rows that are all
    different, so no key of a join or a group is hot.
    """
    once = rows.groupBy("conv", "turn", "role", "text", "present").agg(F.count("*").alias("copies"))
    once = once.withColumn("digest", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    seen = once.filter("present").groupBy("conv", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_turn"))
    seen = seen.select(
        F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"),
        F.when(~F.col("_null"), F.col("_turn")).alias("_first"), F.lit(True).alias("_opens"))
    match = (F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
             & F.col("turn").eqNullSafe(F.col("_first")))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(~F.col("present"), ABSENT).when(bare == "", BLANK).when(F.col("_opens").isNull(), DUPLICATE)
             .when(~F.substring(bare, -1, 1).isin(*ENDS), CUT_SHORT).otherwise(OK))
    return once.join(seen, match, "left").select("conv", "turn", "role", "text", "copies", "digest", fault.alias("fault"))


def _sorted(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows by conversation, turn, role, the first characters of the text, and its digest; cut, so that partitions stay what they are."""
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest")]
    rows = rows.withColumn("head", F.substring("text", 1, _PREFIX))
    rows = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).drop("head", "digest")
    return cut(rows.withColumn("block", F.spark_partition_id()))


def _chains(borders: list) -> list[list]:
    """Border segments of one conversation in block order, for each conversation that fills more than one block."""
    chains: list[list] = []
    for row in sorted(borders, key=lambda r: (r.block, r.at)):
        if chains and row.at == 0 and _same(chains[-1][-1].conv, row.conv) and chains[-1][-1].block < row.block:
            chains[-1].append(row)
        else:
            chains.append([row])
    return [c for c in chains if len(c) > 1]


def repair(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None, blocks: int | None = None,
) -> DataFrame:
    """Pieces of repaired conversations, written to the shared folder: (conv, block, piece, whole, counts, audit, repaired).

    Rows of a conversation are taken by turn (NULL first), then role, the first 64 characters of the text, and its digest; repeated rows
    follow each other and all but the first are duplicates.  ``audit`` has the initials of the edits (Keep, Rerole, Delete, Insert),
    ``repaired`` the rows (role, text) that they leave, and the counts what was found before: blank, duplicate, truncated,
    illegal neighbours, turns.  The pieces of a conversation follow each other by block and piece; one that is ``whole``
    is alone.  NULL roles and texts count as one blank.  A NULL id is a conversation like any other.  Rows
    where ``present`` does not hold name their conversation only, and one without other rows has one empty piece.  A role that begins
    with none of s, u, a (an empty one too) cannot be kept.  ``blocks`` range partitions (default: as many as a shuffle has)
    bound what a task holds; only ids, turns, costs and states at their borders reach the driver, two rows for each.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"))
    # what an absent row holds does not matter; emptied, the rows of one turn become one
    rows = rows.withColumns({c: F.when(F.col("present"), F.col(c)).otherwise("") for c in ("role", "text")})
    rows = _sorted(faults(rows), blocks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = rows.select("block", "conv", "turn", "role", "fault", "copies")
    conv = rows.schema["conv"].dataType.simpleString()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[int] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept[:] = kept or batch.column(0)[:1].to_pylist()
                yield batch

        for at, s in _ends(_segments(noted(), False)):
            yield _batch(border_schema, [(kept[0], at, s.conv, len(s.kinds), s.turns[-1] if s.turns else None,
                                          s.roles[-1][:1] if s.roles else None, [c for v in s.costs() for c in v])])

    borders_as = f"block int, at int, conv {conv}, n long, turn long, role string, costs array<long>"
    border_schema = _arrow(slim, borders_as)
    chains = _chains(slim.mapInArrow(summaries, borders_as).collect())

    # the vector after each segment of a chain, and what came before it; the rest is found where the rows are
    ends: dict[tuple[int, int], Vector] = {}
    before: dict[tuple[int, int], tuple[bool, int | None, str | None]] = {}
    for chain in chains:
        v = END
        for row in reversed(chain):
            ends[row.block, row.at] = v
            v = [min(row.costs[s * STATES + t] + v[t] for t in range(STATES)) for s in range(STATES)]
        known: tuple[bool, int | None, str | None] = (False, None, None)
        for row in chain:
            before[row.block, row.at] = known
            known = (True, row.turn, row.role) if row.n else known
    last = {(c[-1].block, c[-1].at) for c in chains}

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[int] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block[:] = block or batch.column(0)[:1].to_pylist()
                yield batch

        for at, s in _ends(_segments(noted(), False)):
            key = (block[0], at)
            if key in ends and key not in last:
                yield _batch(exit_schema, [(*key, [s.exit(state, ends[key]) for state in range(STATES)])])

    exits_as = "block int, at int, exits array<int>"
    exit_schema = _arrow(slim, exits_as)
    after = {(r.block, r.at): r.exits for r in slim.mapInArrow(exits, exits_as).collect()} if chains else {}
    entry: dict[tuple[int, int], int] = {}
    for chain in chains:
        state = 0
        for row in chain:
            entry[row.block, row.at] = state
            state = after.get((row.block, row.at), _LEFT)[state]

    counts = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long"
    pieces_as = f"conv {conv}, block int, piece int, whole boolean, {counts}, audit string, repaired array<struct<role:string,text:string>>"
    piece_schema = _arrow(slim, pieces_as)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[int] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block[:] = block or batch.column(0)[:1].to_pylist()
                yield batch

        at, held = 0, []
        segments = _segments(noted(), True)
        s = next(segments, None)
        while s is not None:
            following = next(segments, None)
            key = (block[0], 0 if at == 0 else 1 if following is None else -1)
            chained = key in ends
            made = _pieces(s, entry.get(key, 0), ends.get(key, END), not chained or key in last, before.get(key, (False, None, None)))
            one = next(made)
            two = next(made, None)
            held.append((s.conv, block[0], 0, not chained and two is None, *one))
            number = 1
            while two is not None:
                held.append((s.conv, block[0], number, False, *two))
                number, two = number + 1, next(made, None)
                yield _batch(piece_schema, held)
                held = []
            if len(held) >= 256:
                yield _batch(piece_schema, held)
                held = []
            at, s = at + 1, following
        if held:
            yield _batch(piece_schema, held)

    return stored(rows.select("block", "conv", "turn", "role", "fault", "copies", "text").mapInArrow(pieces, pieces_as), "conversations")


def _pieces(s: _Segment, state: int, end: Vector, last: bool, before: tuple[bool, int | None, str | None]) -> Iterator[tuple]:
    """Counts, audit and repaired rows of a segment, in pieces of bounded size; one empty piece where there is nothing."""
    any_before, turn, initial = before
    found = [0] * 5
    turns: list[int] = []
    new_turns = illegal = cost = size = rows = 0
    audit: list[str] = []
    lines: list[dict[str, str]] = []

    def piece() -> tuple:
        return (min(turns, default=None), max(turns, default=None), new_turns, found[BLANK], found[DUPLICATE], found[CUT_SHORT], illegal,
                cost, "".join(audit), list(lines))

    full = False
    for i, edit, spent, role, _ in s.walk(state, end, last):
        if full:
            yield piece()
            found, turns, audit, lines = [0] * 5, [], [], []
            new_turns = illegal = cost = size = rows = 0
        audit.append(edit)
        cost += spent
        if i < 0:
            lines.append({"role": role, "text": ""})
        else:
            n, own = s.copies[i], s.roles[i]
            blank = s.kinds[i][1] == BLANK
            found[s.kinds[i][1]] += 1
            found[BLANK if blank else DUPLICATE] += n - 1
            audit.append("D" * (n - 1))
            cost += DELETE * (n - 1)
            illegal += n - 1 + (any_before and (initial or "") + own[:1] not in LEGAL)
            if s.turns[i] is not None:
                new_turns += not any_before or s.turns[i] != turn
                turns.append(s.turns[i])
            any_before, turn, initial = True, s.turns[i], own[:1]
            if edit != "D":
                lines.append({"role": role or own, "text": s.texts[i]})
                size += len(s.texts[i])
        rows += 1
        full = rows >= _PIECE_ROWS or size >= _PIECE_CHARS
    yield piece()


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """(conv, block, piece, line, role, text): the rows of repaired conversations; the three numbers order those of one."""
    return pieces.select("conv", "block", "piece", F.posexplode("repaired").alias("line", "row")).select(
        "conv", "block", "piece", "line", "row.role", "row.text")


def reports(pieces: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation.

    gaps counts the turns missing between the first and the last (NULL turns apart); the digest is that of the repaired ``role:text``
    lines.  Pieces of one conversation are streamed in order, so memory holds its audit alone.
    """
    conv = pieces.schema["conv"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = f"conv {conv}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"
    schema = _arrow(pieces, out)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[tuple] = []

        def close(c: dict) -> tuple:
            gaps = c["high"] - c["low"] + 1 - c["turns"] if c["low"] is not None else 0
            return (c["conv"], gaps, *c["sums"], "".join(c["audit"]), c["hash"].hexdigest())

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["whole"] or not _same(now["conv"], row["conv"]):
                    if now is not None:
                        done.append(close(now))
                    now = {"conv": row["conv"], "low": None, "high": None, "turns": 0, "sums": [0] * 5, "audit": [], "hash": hashlib.sha256(), "open": False}
                if row["first_turn"] is not None:
                    now["low"] = row["first_turn"] if now["low"] is None else min(now["low"], row["first_turn"])
                    now["high"] = row["last_turn"] if now["high"] is None else max(now["high"], row["last_turn"])
                now["turns"] += row["turns"]
                now["sums"] = [a + row[n] for a, n in zip(now["sums"], names[1:])]
                now["audit"].append(row["audit"])
                for line in row["repaired"]:
                    now["hash"].update(f"{chr(10) if now['open'] else ''}{line['role']}:{line['text']}".encode())
                    now["open"] = True
            if done:
                yield _batch(schema, done)
                done = []
        if now is not None:
            yield _batch(schema, [close(now)])

    parts = pieces.filter("NOT whole").repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "block", "piece")
    return pieces.filter("whole").mapInArrow(finished, out).unionByName(parts.mapInArrow(finished, out))
