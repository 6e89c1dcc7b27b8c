"""Repair of conversations by the cheapest edits: forward and backward costs, the arcs that are tight, the least letter at each step.

Rows are sorted over the whole table and cut into blocks, so a conversation of any length is dealt to
many tasks. A block's part of a conversation is a segment; what it does to costs is a matrix of four by
four, and these are all that one task sees of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenary.llm.storage import discard, durable

#: Costs of the edits, and what a truncated row costs that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Characters of a text that order rows of one turn and role before its MD5 does.
HEAD = 100

_FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant. What an inserted or reroled row does in each, and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Cost to end from each state, by inserting only.
_END = (0, 2 * INSERT, INSERT, 0)
_INITIALS = "sua"


def code_of(initial: Column, forced: Column, cut: Column) -> Column:
    """0 for a row that must go, else 1 to 8: role initial s, u, a or other, truncated or not."""
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(forced, 0).otherwise(1 + 2 * kind + cut.cast("int"))


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the edits of a row, by letter."""
    arcs = [("D", s, s, DELETE) for s in range(4)]
    if code:
        kind, cut = divmod(code - 1, 2)
        keep = _KEEP[_INITIALS[kind]] if kind < 3 else (None,) * 4
        arcs += [("K", s, t, TRUNCATED * cut) for s, t in enumerate(keep) if t is not None]
        arcs += [("R", s, _NEXT[s], REROLE + TRUNCATED * cut) for s in range(4)]
    return arcs


ARCS = [_arcs(code) for code in range(9)]


def _inserted(cost: list[int]) -> list[int]:
    """Forward costs once rows may be inserted."""
    cost = list(cost)
    for _ in range(3):
        for s, t in enumerate(_NEXT):
            cost[t] = min(cost[t], cost[s] + INSERT)
    return cost


def _insertable(cost: list[int]) -> list[int]:
    """Backward costs once rows may be inserted."""
    cost = list(cost)
    for _ in range(3):
        for s, t in enumerate(_NEXT):
            cost[s] = min(cost[s], cost[t] + INSERT)
    return cost


def _forward(cost: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs after a row from those before it."""
    before, after = _inserted(list(cost)), [_FAR] * 4
    for _, s, t, w in ARCS[code]:
        after[t] = min(after[t], before[s] + w)
    return tuple(min(c, _FAR) for c in after)


def _backward(cost: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs to the end before a row from those after it."""
    before = [_FAR] * 4
    for _, s, t, w in ARCS[code]:
        before[s] = min(before[s], w + cost[t])
    return tuple(min(c, _FAR) for c in _insertable(before))


class Steps:
    """Cost steps, remembered by what lies above the least cost; inserts bound that, so there are few."""

    def __init__(self, step: Callable[[tuple[int, ...], int], tuple[int, ...]]) -> None:
        self.step, self.seen = step, {}

    def __call__(self, cost: tuple[int, ...], code: int) -> tuple[int, ...]:
        least = min(cost)
        key = (tuple(c - least if c < _FAR else _FAR for c in cost), code)
        if key not in self.seen:
            self.seen[key] = self.step(*key)
        return tuple(c + least if c < _FAR else _FAR for c in self.seen[key])


FORWARD, BACKWARD = Steps(_forward), Steps(_backward)


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    out = []
    for s in range(4):
        cost = tuple(0 if t == s else _FAR for t in range(4))
        for c in codes:
            cost = FORWARD(cost, c)
        out += cost
    return out


def tight_paths(codes: bytes, start: list[int], end: list[int], total: int) -> list[tuple[int, int, str]]:
    """(state before, state after, letters) from each state before the rows that a cheapest repair passes.

    ``start`` and ``end`` are the forward costs before the rows and the backward costs after them. An
    arc is tight if the costs to it, of it and from it make ``total``; the frontier is the set of
    states that the letters so far lead to, and follows the least letter of its tight arcs.
    """
    ahead, behind = [tuple(start)], [tuple(end)]
    for c in codes:
        ahead.append(FORWARD(ahead[-1], c))
    for c in reversed(codes):
        behind.append(BACKWARD(behind[-1], c))
    behind.reverse()
    out = []
    for entry in range(4):
        if ahead[0][entry] + behind[0][entry] != total:
            continue
        frontier, letters = {entry}, []
        for i, c in enumerate(codes):
            here, there, after = _inserted(list(ahead[i])), behind[i], behind[i + 1]
            while True:
                moves: dict[str, set[int]] = {}
                for letter, s, t, w in ARCS[c]:
                    if s in frontier and here[s] + w + after[t] == total:
                        moves.setdefault(letter, set()).add(t)
                for s in frontier:
                    if here[s] + INSERT + there[_NEXT[s]] == total:
                        moves.setdefault("I", set()).add(_NEXT[s])
                letter = min(moves)
                letters.append(letter)
                frontier = moves[letter]
                if letter != "I":
                    break
        out += [(entry, s, "".join(letters)) for s in frontier]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _mapped(df: DataFrame, keys: int, fields: list[T.StructField], make: Callable[[tuple, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``make`` over the groups of sorted partitions; it gets a group's key and rows and yields rows of ``fields``."""
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for key, rows in _grouped(batches, keys):
            for row in make(key, rows):
                out.append(row)
                size += sum(len(v) for v in row if isinstance(v, str | bytes)) + 64
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)

    return df.mapInArrow(run, schema)


def placed_turns(rows: DataFrame) -> DataFrame:
    """Rows with block and pos, in the order of the whole table: by conversation, turn (nulls first), role, text.

    A range shuffle deals rows out, equal ones too (by where they came from), so no key is too large
    for it. Texts order rows of one turn and role by 100 characters, then by their MD5.
    """
    text = F.coalesce("text", F.lit(" "))
    ready = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.substring(text, 1, HEAD).alias("_head"), F.md5(text).alias("mark"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "mark", "_row"]
    sorted_rows = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.select("conv_id", "turn", "role", "text", "mark", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("pos"))


def faults(placed: DataFrame) -> DataFrame:
    """Placed rows without texts, with initial, blank, duplicate, truncated (the first of these that holds) and code.

    Equal rows of a conversation are found by counts that are summed before the shuffle; those that occur
    once meet nothing in the join, whose large keys adaptive execution splits.
    """
    light = placed.select(
        "conv_id", "turn", "role", "mark", "block", "pos", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    first = light.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("mark").alias("_m")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = light["conv_id"].eqNullSafe(first["_c"]) & (light["role"] == first["_r"]) & (light["mark"] == first["_m"])
    found = light.join(first, same, "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    found = found.withColumn("truncated", F.col("cut") & ~F.col("blank") & ~F.col("duplicate"))
    return found.select("conv_id", "turn", "block", "pos", "initial", "blank", "duplicate", "truncated", code_of(F.col("initial"), F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("code"))


_LONG = T.LongType()
_STATS = [T.StructField(n, _LONG) for n in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")]
_LEGAL = ("su", "ua", "au")


def segments(found: DataFrame) -> DataFrame:
    """One row for each part of a conversation in a block: its codes, a byte a row, its matrix and counts."""
    fields = [T.StructField("block", T.IntegerType()), found.schema["conv_id"], T.StructField("codes", T.BinaryType()), T.StructField("matrix", T.ArrayType(_LONG)), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]

    def make(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        codes, counts, illegal, turns, low, high, first, last = bytearray(), [0, 0, 0], 0, 0, None, None, None, None
        for _, _, _, turn, initial, blank, duplicate, truncated, code in rows:
            codes.append(code)
            counts = [counts[0] + blank, counts[1] + duplicate, counts[2] + truncated]
            illegal += last is not None and last + initial not in _LEGAL
            first, last = initial if first is None else first, initial
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        yield (*key, bytes(codes), matrix(codes), first, last, *counts, illegal, low, high, turns)

    ready = found.select("block", "conv_id", "pos", F.col("turn").cast("long").alias("turn"), "initial", "blank", "duplicate", "truncated", "code")
    return _mapped(ready.repartition("block").sortWithinPartitions("block", F.col("conv_id").asc_nulls_first(), "pos"), 2, fields + _STATS, make)


def costs(parts: DataFrame) -> DataFrame:
    """Segments with the forward costs before them, the backward costs behind them, the least total, and counts that know their neighbours.

    A task holds the matrices of one conversation, one for each block that it reaches into.
    """
    vector = T.ArrayType(_LONG)
    fields = [parts.schema["conv_id"], T.StructField("block", T.IntegerType()), T.StructField("start", vector), T.StructField("end", vector), T.StructField("cost", _LONG)]

    def make(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(rows)
        start, end = [[0, _FAR, _FAR, _FAR]], [list(_END)]
        for r in rows[:-1]:
            start.append([min(min(start[-1][s] + r[2][4 * s + t] for s in range(4)), _FAR) for t in range(4)])
        for r in rows[::-1]:
            end.append([min(min(r[2][4 * s + t] + end[-1][t] for t in range(4)), _FAR) for s in range(4)])
        total, end = end[-1][0], end[-2::-1]
        last = high = None
        for r, a, b in zip(rows, start, end, strict=True):
            stats = list(r[5:])
            stats[3] += last is not None and last + r[3] not in _LEGAL
            stats[6] -= stats[4] is not None and stats[4] == high
            last, high = r[4], high if stats[5] is None else stats[5]
            yield (*key, r[1], a, b, total, *stats)

    ready = parts.select("conv_id", "block", "matrix", "first", "last", *(f.name for f in _STATS))
    return _mapped(ready.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block"), 1, fields + _STATS, make)


def chosen_edits(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Segments with state, the one before them, and letters, the edits of the cheapest repair with the least letters.

    Each segment is walked from every state that a cheapest repair may come in by; a conversation's
    segments then pick the walk that begins where the one before ends. Rows to insert behind the last
    row go with its segment.
    """
    fields = [parts.schema["conv_id"], T.StructField("block", T.IntegerType()), T.StructField("state", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("letters", T.StringType())]

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, block, codes, start, end, total in rows:
            for state, after, letters in tight_paths(codes, start, end, total):
                yield (*key, block, state, after, letters)

    def chain(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state, held = 0, None
        for _, block, entry, after, letters in rows:
            if (held is None or block != held[1]) and entry == state:
                if held is not None:
                    yield held
                held, state = (*key, block, entry, after, letters), after
        yield (*held[:4], held[4] + "I" * (_END[state] // INSERT))

    c = known.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "start", "end", "cost")
    both = parts.join(c, parts["conv_id"].eqNullSafe(c["_c"]) & (parts["block"] == c["_b"])).select("conv_id", "block", "codes", "start", "end", "cost")
    walks = _mapped(both, 1, fields, walk)
    return _mapped(walks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block", "state"), 1, fields, chain).drop("after")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(block, pos, letter, turn, role, text) of a conversation's repaired rows; letters come before the rows of their segment."""
    state, letters, k, last = 0, "", 0, (None, None)

    def inserts() -> Iterator[tuple]:
        nonlocal k, state
        while k < len(letters) and letters[k] == "I":
            yield (*last, "I", None, _ROLE[state], "")
            k, state = k + 1, _NEXT[state]

    for _, block, pos, new_state, new_letters, turn, role, text in rows:
        if new_letters is not None:
            yield from inserts()
            state, letters, k = new_state, new_letters, 0
            continue
        last = (block, pos)
        yield from inserts()
        letter, k = letters[k], k + 1
        if letter == "K":
            state = _KEEP[role[0]][state]
            yield (*last, "K", turn, role, text)
        elif letter == "R":
            yield (*last, "R", turn, _ROLE[state], text)
            state = _NEXT[state]
        yield from inserts() if k < len(letters) and not letters[k:].strip("I") else ()
    yield from inserts()


def _with_letters(placed: DataFrame, edits: DataFrame, *by: str) -> DataFrame:
    """Placed rows and, before those of each segment, its letters, sorted in partitions of ``by``."""
    nothing = lambda t: F.lit(None).cast(t)
    rows = placed.select("conv_id", "block", "pos", nothing("int").alias("state"), nothing("string").alias("letters"), "turn", "role", "text")
    told = edits.select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), "state", "letters", nothing(placed.schema["turn"].dataType.simpleString()).alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"))
    return rows.unionByName(told).repartition(*by).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block", "pos")


def repaired_rows(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, block, pos, k, edit, turn, role, text), in the order of block, pos and k.

    An inserted row stands where the row before or behind it in its block does, with a null turn. Rows are edited block by block,
    so a conversation of any length is the work of many tasks.
    """
    fields = [placed.schema["conv_id"], *(T.StructField(n, t) for n, t in (("block", T.IntegerType()), ("pos", _LONG), ("k", _LONG), ("edit", T.StringType()))), placed.schema["turn"], T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]

    def make(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, (block, pos, letter, turn, role, text) in enumerate(_edited(rows)):
            yield (*key, block, pos, k, letter, turn, role, text)

    return _mapped(_with_letters(placed, edits, "block", "conv_id"), 1, fields, make)


def repaired_digests(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired `role:text`, newline-joined. A digest reads a conversation in order, as a stream: nothing of it is held."""
    fields = [placed.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]

    def make(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for k, (_, _, _, _, role, text) in enumerate(_edited(rows)):
            digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        yield (*key, digest.hexdigest())

    return _mapped(_with_letters(placed, edits, "conv_id"), 1, fields, make)


class Repair:
    """Tables of a repair: placed rows, edits of their segments, and a row of counts, cost and audit for each conversation."""

    def __init__(self, rows: DataFrame) -> None:
        self.placed = durable(placed_turns(rows))
        parts = durable(segments(faults(self.placed)))
        known = durable(costs(parts))
        self.edits = durable(chosen_edits(parts, known))
        counts = known.groupBy("conv_id").agg(
            (F.coalesce(F.max("high") - F.min("low") + 1, F.lit(0)) - F.sum("turns")).alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")), F.max("cost").alias("cost")
        )
        letters = F.array_join(F.array_sort(F.collect_list(F.struct("block", "letters")))["letters"], "")
        audit = self.edits.groupBy(F.col("conv_id").alias("_c")).agg(letters.alias("audit"))
        self.summary = durable(counts.join(audit, counts["conv_id"].eqNullSafe(audit["_c"])).drop("_c"))
        discard(parts, known)


def repair_conversations(rows: DataFrame) -> Repair:
    """The cheapest repair of each conversation of rows (conv_id, turn, role, text), other columns left out.

    Rows of a conversation go by turn (nulls first), then role, then text (100 characters, then MD5);
    a null conv_id is a conversation of its own; null roles and texts are one space. A row's first
    fault counts: blank, duplicate of an earlier role and text, truncated (no final . ! or ?).
    Edits: Keep 0, Rerole 2, Delete 3 (blank and duplicate rows must go), Insert of an empty user or
    assistant row 2; a truncated row that stays costs 1. The role initials that are left read
    (s?(ua)+)?; an empty role has no initial and cannot be kept. Of the cheapest repairs the one with
    the least initials of its edits is taken. Empty texts are blank, repeated rows duplicates, an
    empty table has no conversations. Very long texts are read once to be sorted and once for output.
    """
    return Repair(rows)


def damage_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the CRC-32 of `conv_id:turn` modulo 20, nulls read as one space.

    0 drops a row, 1 empties its text, 2 takes . ! and ? out of it, 3 repeats it, 4 makes its role user.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    role = F.when(k == 4, "user").otherwise(as_text("role"))
    return rows.where(k != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
