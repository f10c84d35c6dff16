"""Line dedup against a plain reading of its definition; the perfect hash alone."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditframe.llm import line_dedup


def brute(rows, min_documents=3):
    """rows: (id, text); ids compared with null as the smallest."""
    low = lambda i: -(1 << 63) if i is None else i
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held.setdefault(key(line), {})[n] = low(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < min_documents or max(held[key(x)].values()) == low(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


L = ["a line that is long enough", "  A LINE that is long enough\t", "short", "", "É" * 20, "é" * 19 + " ", "x" * 70000]


def test_rows(spark):
    rows = [(1, "\n".join(L)), (2, "\n".join(L[:3])), (3, L[0]), (3, L[0] + "\n" + L[6]), (None, None), (None, L[1]), (4, ""),
            (5, L[4] + "\n" + L[4]), (6, L[6]), (7, L[6] + "\nend"), (8, L[4]), (9, "é" * 20), (10, L[4])]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, chunk string, n_lines int")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "chunk", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute(rows)
    assert line_dedup.drop_repeated_lines(df.limit(0)).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 2**64 - 1)), min_size=1, max_size=300))
def test_perfect_hash_numbers_every_key_once(pairs):
    keys = np.zeros(len(pairs), line_dedup._ENTRY)
    keys["at"], keys["print"] = np.array(sorted(pairs), dtype=np.uint64).T
    assert sorted(line_dedup.PerfectHash.build(keys)(keys).tolist()) == list(range(len(keys)))
