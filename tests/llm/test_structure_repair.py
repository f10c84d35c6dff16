"""Conversation repair against all edit sequences, one by one."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditframe.llm import structure_repair as R

LEGAL = re.compile("(s?(ua)+)?")


def plain(rows):
    """(cost, audit, roles) of the cheapest edits of (initial, fault) rows: every sequence of edits is tried."""
    best = (2 * len(rows), "D" * len(rows), "")  # everything can go

    def go(i, cost, audit, roles):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if LEGAL.fullmatch(roles) and (cost, audit) < best[:2]:
                best = (cost, audit, roles)
        else:
            initial, fault = rows[i]
            if fault not in (R.BLANK, R.DUPLICATE):
                more = 5 * (fault == R.TRUNCATED)
                go(i + 1, cost + more, audit + "K", roles + (initial or "?"))
                for r in "ua":
                    go(i + 1, cost + 1 + more, audit + "R", roles + r)
            go(i + 1, cost + 2, audit + "D", roles)
        if len(roles) < 2 * len(rows) + 2:
            for r in "ua":
                go(i, cost + 5, audit + "I", roles + r)

    go(0, 0, "", "")
    return best


def test_lightest_against_all_edits():
    rng = random.Random(11)
    for n in range(6):
        for _ in range(40):
            rows = [(rng.choice("uuaas?"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
            cost, audit, steps = R.lightest(rows)
            want = plain(rows)
            assert (cost, audit) == want[:2], rows
            assert "".join(r or rows[i][0] for i, r in steps) == want[2]


def test_audits_compare_like_strings():
    rng = random.Random(2)
    root, made = R.Audit(None, ""), []
    for _ in range(300):
        text = "".join(rng.choices("DK", k=rng.randrange(40)))
        node = root
        for letter in text:
            node = node.then(letter)
        made.append((text, node))
    for a, x in made:
        assert x.text() == a
        for b, y in made:
            assert (x < y) == (a < b) and (x is y) == (a == b)


def test_long_conversation_takes_seconds():
    rng = random.Random(4)
    rows = [(rng.choice("ua"), rng.choice([0, 0, 0, 3])) for _ in range(20_000)]
    began = time.time()
    cost, audit, steps = R.lightest(rows)
    assert time.time() - began < 60
    assert len(audit) >= 20_000 and LEGAL.fullmatch("".join(r or rows[i][0] for i, r in steps))


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"),  # sound
    (2, 0, "assistant", "No."), (2, 5, "user", "half a"), (2, 5, "user", "half a"),  # tie, repeated row, gap
    (3, None, "user", "First."), (3, 0, None, "x."), (3, 1, "assistant", None), (3, 2, "", ""),
    (4, 0, "user", " "), (4, 1, "assistant", " \t\n"),  # no-break space is no white space here
    (None, 0, "user", "Lost."), (None, 1, "assistant", "Found."),
    (5, None, "system", "Rules."), (5, None, "system", "Rules."),
    (6, 0, "user", "Long. " * 50_000), (6, 1, "assistant", "Done. "),
]


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    pairs = [(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    kinds = []
    for k, (role, text) in enumerate(pairs):
        shown = text.strip(" \t\n\x0b\x0c\r")
        kinds.append(1 if not shown else 2 if (role, text) in pairs[:k] else 0 if shown[-1] in ".!?" else 3)
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [p[0][:1] for p in pairs]
    cost, audit, _ = plain(list(zip(initials, kinds, strict=True)))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost, audit)


@pytest.mark.parametrize("partitions", [1, 5])
def test_odd_rows(spark, partitions):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(partitions)
    got = R.repair_conversations(df.selectExpr("*", "1 AS conv", "2 AS audit", "true AS present")).collect()
    for r in got:
        want = by_hand([x for x in ROWS if x[0] == r.conv_id])
        assert tuple(r)[1:8] == want, r.conv_id
    assert {r.conv_id for r in got} == {1, 2, 3, 4, 5, 6, None} and len(got) == 7
    sound = {r.conv_id: [(t.turn, t.role, t.text) for t in r.repaired] for r in got}
    assert sound[1] == [(0, "user", "Hi."), (1, "assistant", "Yes!")]
    assert sound[None] == [(0, "user", "Lost."), (1, "assistant", "Found.")]
    assert sound[5] == [] and len(sound[6][0][2]) == 300_000


def test_no_rows_and_names_only(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert R.repair_conversations(df.limit(0)).collect() == []
    got = R.repair_conversations(df, present=F.col("conv_id") == 1).collect()
    assert sorted((r.conv_id or 0, r.cost, r.audit) for r in got) == [(0, 0, ""), (1, 0, "KK"), *((i, 0, "") for i in range(2, 7))]


def test_damage(spark):
    import zlib

    rows = [(i, j, ("user", "assistant")[j % 2], f"Is it {i}? Yes. {j}!") for i in range(30) for j in range(4)] + [(7, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "9 AS what")
    want = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        want += [(c, t, "user" if what == 4 else role, text, what != 0)] * (2 if what == 3 else 1)
    assert sorted(map(repr, map(tuple, R.damage(df).collect()))) == sorted(map(repr, want))
