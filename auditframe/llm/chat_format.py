"""Chat formatting: a template over roles makes text segments with loss flags, and reads them back.

DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are written: ``mark``, label, ``": "``, text, ``close``.

    ``labels`` has the label of each role, ``loss`` the roles whose texts are learned. Another role is written as
    ``mark``, ``"["``, role, ``odd_end``. ``follows`` is the machine: the states each role may come after, "" being the
    beginning; ``ends`` are the states a conversation may stop in.
    """

    mark: str = "### "
    odd_end: str = "]: "
    close: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for control in self.controls:
            if len(control) < 2 or ESCAPE in control:
                raise ValueError(f"a control string needs two characters and no {ESCAPE}: {control!r}")
            if any(control[:n] == control[-n:] for n in range(1, len(control))):
                raise ValueError(f"a control string must not begin as it ends: {control!r}")
        for label in self.labels.values():
            if label.startswith("[") or any(c in label for c in (": ", *self.controls)):
                raise ValueError(f"a label must not hold control strings: {label!r}")
        if len(set(self.labels.values())) < len(self.labels):
            raise ValueError("two roles have the same label")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.mark, self.odd_end, self.close.rstrip("\n")


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """``text`` without control strings: escapes are doubled, and one follows the first character of each control string."""
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), starts, "$0" + ESCAPE * 2)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, template: Template) -> Column:
    """Header, text and end of one turn, each with its loss flag."""
    role = turn["role"]
    header = F.concat(F.lit(f"{template.mark}["), escape(role, template), F.lit(template.odd_end))
    for name, label in template.labels.items():
        header = F.when(role == name, F.lit(f"{template.mark}{label}: ")).otherwise(header)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(
        part(header, F.lit(False)),
        part(escape(turn["text"], template), role.isin(*template.loss)),
        part(F.lit(template.close), F.lit(False)),
    )


def _run_machine(turns: Column, template: Template) -> Column:
    """(state, seen, bad): the state after the last turn, and the place of the first turn that may not come there."""
    allowed = [f"{before}>{role}" for role, states in template.follows.items() for before in states]
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))

    def step(at: Column, turn: Column) -> Column:
        seen = at["seen"] + 1
        fits = F.concat(at["state"], F.lit(">"), turn["role"]).isin(*allowed)
        return F.struct(turn["role"].alias("state"), seen.alias("seen"), F.when(at["bad"].isNull() & ~fits, seen).otherwise(at["bad"]).alias("bad"))

    return F.aggregate(turns, start, step)


def format_conversations(
    df: DataFrame, template: Template = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss) in order, ``formatted`` (all of them joined), ``valid`` and ``bad_turn``.

    Turns are taken by turn (nulls first; ties by role, then text, so repeated rows stay side by side). The machine over
    roles says whether each may come after the one before; ``bad_turn`` is the place (from 1) of the first that may not, and
    ``valid`` is true if there is none and the conversation may stop where it does. Invalid ones are formatted all the same.

    A null text or role counts as empty; a role without label, the empty one included, is written in brackets and is never
    valid or learned. A null conversation is one of its own. Control strings in texts and roles are escaped, so
    ``read_turns`` gets back every turn exactly. An empty table gives no rows; other columns stay behind, whatever
    their names. A conversation is one training example and as such one row.
    """
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.struct(F.col(f"`{turn}`").alias("turn"), one(role).alias("role"), one(text).alias("text")).alias("row"))
    turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    machine = _run_machine(F.col("turns"), template)
    made = turns.select(
        "conv",
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
        machine.alias("machine"),
    )
    return made.select(
        F.col("conv").alias(conv),
        (F.col("machine.bad").isNull() & F.col("machine.state").isin(*template.ends)).alias("valid"),
        F.col("machine.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Role and text of every turn of a formatted conversation."""
    parts = F.split(formatted, re.escape(template.close))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # nothing follows the last end

    def turn(part: Column) -> Column:
        rest = F.substring(part, len(template.mark) + 1, 2147483647)
        odd = F.startswith(rest, F.lit("["))
        end = F.when(odd, F.lit(template.odd_end)).otherwise(F.lit(": "))
        at = F.when(odd, F.locate(template.odd_end, rest)).otherwise(F.locate(": ", rest))
        label = F.substr(rest, F.lit(1), at - 1)
        role = reduce(lambda c, x: F.when(label == x[1], F.lit(x[0])).otherwise(c), template.labels.items(), F.lit(None).cast("string"))
        return F.struct(
            F.when(odd, unescape(F.substr(label, F.lit(2)))).otherwise(role).alias("role"),
            unescape(F.substr(rest, at + F.length(end))).alias("text"),
        )

    return F.transform(parts, turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
