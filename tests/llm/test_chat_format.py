"""Chat formatting: exact round trips of hostile texts, loss flags and the machine over roles."""

import random

import pytest

from auditframe.llm import chat_format as C

PIECES = ["\\", "#", "##", "### ", "### User: ", "### [", "]: ", "]", ": ", "</turn>", "</turn>\n", "<", "/turn>", "\n", "a", "", "$0", "\\\\", "日本", "🙂", "\x00"]
TEMPLATES = [C.DEFAULT, C.Template(mark="<|im_start|>", close="<|im_end|>\n", odd_end="|:>", loss=("user", "assistant"))]


def made(spark, rows, template=C.DEFAULT):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments", "2 AS turns", "3 AS conv")
    out = C.format_conversations(df.repartition(3), template)
    return out.select("*", C.read_turns(out["formatted"], template).alias("read"), C.learned_text(out["segments"]).alias("learned")).collect()


@pytest.mark.parametrize("template", TEMPLATES)
def test_round_trip(spark, template):
    rng = random.Random(1)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(300) for t in range(rng.randrange(1, 5))]
    got = made(spark, rows, template)
    assert len(got) == 300
    for r in got:
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r["read"]] == [(x[2], x[3]) for x in mine]
        assert r.learned == "".join(x[3] for x in mine if x[2] in template.loss)
        assert r.formatted == "".join(s.text for s in r.segments)
        # Marks and ends occur once a turn: none is left in a text.
        assert r.formatted.count(template.close) == len(mine) and r.formatted.count(template.mark) == len(mine)


def test_form(spark):
    (r,) = made(spark, [(1, 1, "assistant", "a </turn> b"), (1, 0, "user", "### x"), (1, 2, "tool", "t")])
    assert r.formatted == "### User: #\\## x</turn>\n### Assistant: a <\\/turn> b</turn>\n### [tool]: t</turn>\n"
    assert [s.loss for s in r.segments] == [False] * 3 + [False, True, False] + [False] * 3
    assert not r.valid and r.bad_turn == 3


def test_machine(spark):
    legal = ["ua", "sua", "uaua", "suaua"]
    wrong = {"a": 1, "uua": 2, "sa": 2, "us": 2, "uas": 3, "uaa": 3, "xua": 1, "uax": 3}
    unfinished = ["u", "su", "s", "uau"]
    names = {"u": "user", "a": "assistant", "s": "system", "x": "narrator"}
    cases = [*legal, *wrong, *unfinished]
    got = {cases[r.conv_id]: r for r in made(spark, [(c, t, names[x], "t") for c, case in enumerate(cases) for t, x in enumerate(case)])}
    assert [c for c in cases if got[c].valid] == legal
    assert {c: got[c].bad_turn for c in cases if got[c].bad_turn} == wrong


def test_odd_rows(spark):
    long = "### long </turn>\n" * 20_000
    rows = [(1, None, "user", "first"), (1, 0, "assistant", None), (1, 0, "assistant", None), (1, 0, None, ""), (None, 0, "user", "no conversation"), (2, 0, "user", long), (3, 0, "", "b"), (3, 0, "", "a")]
    got = {r.conv_id: [(t.role, t.text) for t in r["read"]] for r in made(spark, rows)}
    assert got[1] == [("user", "first"), ("", ""), ("assistant", ""), ("assistant", "")]
    assert got[None] == [("user", "no conversation")] and got[2] == [("user", long)] and got[3] == [("", "a"), ("", "b")]
    assert made(spark, [(1, 0, "user", "x")][:0] or [(9, 0, "user", "x")])[0].learned == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).collect() == []


@pytest.mark.parametrize("wrong", [dict(mark="#"), dict(mark="a b a"), dict(close="\\end"), dict(labels={"user": "[x"}), dict(labels={"user": "x", "tool": "x"})])
def test_template_is_checked(wrong):
    with pytest.raises(ValueError):
        C.Template(**wrong)
