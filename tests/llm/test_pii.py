"""Personal data: base spans against a plain reading of their definition, additions, odd rows."""

import hashlib
import re

import pytest

from auditframe.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_of(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = (
        (EMAIL, lambda s: True),
        (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        (CARD, lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        (PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(tests) for m in p.finditer(text) if ok(m.group())]


TEXTS = [
    None,
    "",
    "mail a@b.c_x@d.e f@g h@i.j. k@l..m x@y-z.co",
    "𝔘𝔘 é me@host.example.com, 1.2.3.4.5.6.7.8 and 999.1.1.1 01.002.3.255 1.2.3 256.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004 12345678901234567890123 0000000000000",
    "+1 (578) 555-6437 +44 20 7946 0958 +1 +123456789012345678 +4((( +49.30.1234567-",
    "tel (212) 555-0199, call 415-555-2671; john [at] example (dot) com; ssh 2001:db8:0:0:0:ff00:42:8329",
    "a" * 20000 + "@" + "b" * 20000 + ".com " + "1" * 5000 + " " + "+1" + "(" * 5000,
    "x@y.z" * 300 + " 1.1.1.1" * 700 + "\n@ +\n",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cand string")
    return pii.find_pii(df).collect()


def test_base_spans_are_the_definition(found):
    assert len(found) == len(TEXTS) + 1
    for row in found:
        assert [(s.kind, s.start, s.end) for s in row.base_spans] == base_of(TEXTS[row.doc_id]), row.doc_id


def test_additions_keep_the_base_and_do_not_overlap_it(found):
    for row in found:
        spans = [(s.kind, s.start, s.end) for s in row.pii_spans]
        base = [(s.kind, s.start, s.end) for s in row.base_spans]
        assert set(base) <= set(spans) and spans == sorted(spans)
        for s in set(spans) - set(base):
            assert all(s[2] <= b[1] or b[2] <= s[1] for b in base)


def test_labelers_agree_with_the_majority():
    belief = pii.fit_labelers([("0:1,1,1,1", 50), ("0:1,1,0,1", 100), ("0:-1,-1,0,-1", 80), ("0:-1,-1,-1,0", 40)])
    assert belief["0:1,1,0,1"] > 0.9 > 0.1 > belief["0:-1,-1,-1,0"]


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_pii_spans"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = base_of(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
