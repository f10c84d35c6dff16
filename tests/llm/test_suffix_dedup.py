"""Suffix-array dedup against a table of all strings; the suffix array alone."""

import hashlib
import random

import numpy as np
import pytest

from auditframe.llm import queries, suffix_dedup
from auditframe.llm.suffixes import permuted_common_prefixes, suffix_array


def brute(rows, length=100):
    """rows: (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, kept)
    return out


def documents():
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    passages = [line(n) for n in (99, 100, 101, 150, 400)]
    texts = [line(50) + p + line(rng.randrange(0, 60)) for p in passages for _ in range(6)]
    texts += [passages[4], passages[4][3:], passages[4][:-1] + "z", "ab" * 400, "x" * 5000, "x" * 99, "x" * 100, "", None]
    texts += [passages[3] + passages[3], passages[4][:200] + passages[4][100:], "\0" * 150, "é" * 60 + line(90), "é" * 60]
    for n in range(30):  # edits inside a long copy
        own = list(passages[4])
        own[rng.randrange(400)] = "#"
        texts.append("".join(own))
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, passages[4])]


def result(df, **options):
    rows = suffix_dedup.remove_repeats(df, **options).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}


@pytest.mark.parametrize("hot, sort_bytes", [(20_000, 1 << 21), (2, 600)])
def test_all_strings(spark, monkeypatch, hot, sort_bytes):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    rows = documents()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, chunk string, kept int")
    assert result(df.repartition(7)) == brute(rows)
    assert result(df.limit(0)) == {}


def test_rows_with_equal_ids(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (0, "y" + text)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 0), (1, 300), (1, 300), (2, 300)]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(1, rng.choice([2, 3, 4, 20])) for _ in range(rng.randrange(0, 60))] + [0]
        sa = suffix_array(np.array(s), len(s)).tolist()
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        for least in (0, 3):
            shared = permuted_common_prefixes(np.array(s), np.array(sa), 8, least)
            for i, j in zip(sa[1:], sa, strict=False):
                n = next((k for k in range(8) if s[i + k : i + k + 1] != s[j + k : j + k + 1] or max(i, j) + k >= len(s)), 8)
                assert shared[i] == (n if n >= least else 0)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in brute(rows).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op2_suffix_array_dedup"](spark, sf_dir).collect()}
    assert got == want
