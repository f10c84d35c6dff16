"""Repair of conversation structure as a lightest derivation: cheapest edits that make roles take turns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Roles by the initial that stands for them where a row is given another role or put in.
ROLES = {"u": "user", "a": "assistant"}
#: What may follow what: "" is the beginning. Derivations end at the beginning or after "a".
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
LEGAL_PAIRS = ("su", "ua", "au")
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


class Audit:
    """A string of edits that shares its beginning with others; each string exists once in its tree.

    ``jump`` leads far back, so two strings are compared in logarithmic time however long they are.
    """

    __slots__ = ("up", "letter", "depth", "jump", "longer")

    def __init__(self, up: Audit | None, letter: str) -> None:
        self.up, self.letter, self.longer = up or self, letter, {}
        self.depth = up.depth + 1 if up else 0
        if up is None:
            self.jump = self
        else:
            far = up.jump
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def then(self, letter: str) -> Audit:
        found = self.longer.get(letter)
        if found is None:
            found = self.longer[letter] = Audit(self, letter)
        return found

    def _first(self, depth: int) -> Audit:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.up
        return at

    def __lt__(self, other: Audit) -> bool:
        shared = min(self.depth, other.depth)
        a, b = self._first(shared), other._first(shared)
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.letter < b.letter

    def text(self) -> str:
        out, at = [], self
        while at.depth:
            out.append(at.letter)
            at = at.up
        return "".join(reversed(out))


def lightest(rows: Sequence[tuple[str, int]]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, [(row or -1, initial it gets or "" for its own)]) of the lightest derivation.

    ``rows`` are (initial, fault). An item (rows read, last initial) says that those rows can be repaired to roles
    that end so. Its deductions read the next row by keeping, reroling or deleting it, or put a turn in; each adds
    to the cost and appends a letter, so a conclusion is never lighter than its premise and keeps the order of
    premises (audits of one item and cost are never one another's beginning). The agenda pops items by
    (cost, audit); the first time an item is popped is final, and so is the goal.
    """
    final: set[tuple[int, str]] = set()
    back: dict[tuple[int, str], tuple] = {}
    root = Audit(None, "")
    agenda: list[tuple] = [(0, root, 0, "", ())]
    n = len(rows)
    while True:
        cost, audit, i, last, premise = heapq.heappop(agenda)
        item = (i, last)
        if item in final:
            continue
        final.add(item)
        back[item] = premise
        if i == n and last in ENDS:
            break
        for role in FOLLOWS[last]:
            if role in ROLES:
                heapq.heappush(agenda, (cost + INSERT, audit.then("I"), i, role, (item, -1, role)))
        if i == n:
            continue
        initial, fault = rows[i]
        heapq.heappush(agenda, (cost + DELETE, audit.then("D"), i + 1, last, (item, -2, "")))
        if fault in (BLANK, DUPLICATE):
            continue
        more = UNFINISHED if fault == TRUNCATED else 0
        for role in FOLLOWS[last]:
            if role == initial:
                heapq.heappush(agenda, (cost + more, audit.then("K"), i + 1, role, (item, i, "")))
            if role in ROLES:
                heapq.heappush(agenda, (cost + more + REROLE, audit.then("R"), i + 1, role, (item, i, role)))
    steps, at = [], back[item]
    while at:
        if at[1] != -2:
            steps.append((at[1], at[2]))
        at = back[at[0]]
    return cost, audit.text(), steps[::-1]


def faults(rows: Sequence[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text), in order."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        shown = row[1].rstrip(SPACE)
        fault = BLANK if not shown else DUPLICATE if row in seen else SOUND if shown[-1] in ".!?" else TRUNCATED
        seen.add(row)
        out.append(fault)
    return out


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _repair(rows: list[tuple]) -> tuple:
    """Of one conversation's rows (turn, role, text, present) in order: the columns of ``_FOUND`` and the repaired turns."""
    rows = [r for r in rows if r[3]]
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [(r[1], r[2]) for r in rows]
    found = faults(pairs)
    initials = [role[:1] for role, _ in pairs]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, steps = lightest(list(zip(initials, found, strict=True)))
    repaired = [{"turn": rows[i][0] if i >= 0 else None, "role": ROLES[r] if r else pairs[i][0], "text": pairs[i][1] if i >= 0 else ""} for i, r in steps]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(found.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, repaired


def _stream(out_type: pa.Schema):
    """Conversations of a partition sorted by them, one at a time; they may go on over batches."""

    def rows_of(convs: list, done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(convs, out_type.field(0).type)]
        columns += [pa.array([r[k] for r in done], out_type.field(k + 1).type) for k in range(len(out_type) - 1)]
        return pa.RecordBatch.from_arrays(columns, schema=out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, started = None, [], False
        convs, done, size = [], [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, *row in zip(*columns, strict=True):
                if started and conv != current:
                    convs.append(current)
                    done.append(_repair(held))
                    size += sum(len(r[2]) for r in held)
                    held = []
                    if size > 1 << 22 or len(done) >= 4096:
                        yield rows_of(convs, done)
                        convs, done, size = [], [], 0
                current, started = conv, True
                held.append(row)
        if started:
            yield rows_of([*convs, current], [*done, _repair(held)])

    return run


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of the cheapest repair, and the ``repaired`` turns.

    Rows are taken by turn (nulls first; ties by role, then text). A row's first fault counts: blank (only white
    space), duplicate (role and text seen earlier), truncated (does not end in ``.``, ``!`` or ``?``). Keeping a row costs 0,
    giving it another role 1, deleting it 2 (blank and duplicate rows must go), putting in an empty turn 5; truncated rows
    that stay cost 5 more. Repaired roles are an optional system turn and user and assistant in turn, or nothing at all; of
    the cheapest repairs the one whose edits (K, R, D, I) read ASCII-least. ``gaps`` counts turns missing between the first and the
    last, ``illegal`` neighbours whose roles cannot follow each other.

    A null role or text counts as one space, so such texts are blank and such roles unknown; roles are told by their
    first character. Rows with equal turns and equal rows are all kept in order. A null conversation is one of its own.
    ``present``, where given, is false on rows that only name their conversation: one without other rows gets zeros.
    An empty table gives no rows. Other columns stay behind, whatever their names.

    Rows meet by conversation, sorted, and are read as a stream: a task holds one conversation at a time, which is
    one training example, plus some hundred bytes for each item of its agenda (at most four a row).
    """
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        one(role).alias("role"),
        one(text).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    result = f"conv {kind}, {_FOUND}, repaired array<struct<turn: bigint, role: string, text: string>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(result))
    return ordered.mapInArrow(_stream(schema), result).withColumnRenamed("conv", conv)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``df``'s conversations with faults put in, by the CRC-32 of ``conv:turn`` modulo 20; nulls count as one space there.

    0: the row goes (it stays with ``present`` false), 1: no text, 2: no ``.``, ``!``, ``?``, 3: twice, 4: said by the user.
    """
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    what = F.crc32(F.concat(one(conv), F.lit(":"), one(turn))) % 20
    rows = df.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), one(role).alias(role), one(text).alias(text), what.alias("__what"))
    said = F.when(F.col("__what") == 1, F.lit("")).when(F.col("__what") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    return rows.select(
        conv, turn,
        F.when(F.col("__what") == 4, F.lit("user")).otherwise(F.col(role)).alias(role),
        said.alias(text),
        (F.col("__what") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(True), F.when(F.col("__what") == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")
