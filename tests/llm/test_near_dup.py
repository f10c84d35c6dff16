"""Near-duplicates against a comparison of all pairs."""

import random
import re

import pytest

from auditframe.llm import near_dup, queries
from auditframe.llm.components import components


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, roots=False):
    """(id, n, component) of each row; or the number of components."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    posted = {}
    for i, s in enumerate(sets):
        for x in s:
            posted.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in posted[x] if j < i}:
            shared = len(s & sets[j])
            if 100 * shared >= 80 * (len(s) + len(sets[j]) - shared):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d)
        least[root(i)] = min(least.get(root(i), key), key, key=lambda x: (x[0], x[1] or 0))
    if roots:
        return len(least)
    return sorted(((d, len(sets[i]), least[root(i)][1]) for i, (d, _) in enumerate(rows)), key=str)


def documents(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120]))]
        for _ in range(rng.choice([2, 5, 60 if group == 4 else 8])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 8))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    for step in range(40):  # a chain: neighbours are near, ends are not
        rows.append(" ".join(f"c{i}" for i in range(step, step + 30)))
    rows += ["", None, "one", "ONE", "one\ttwo", "One  two ", "two", "x " * 40000, "x " * 40000 + "y"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, "other words here"), (None, "other words here"), (None, "lonely"), (7, rows[7])]


@pytest.mark.parametrize("k", [2, 5])
def test_all_pairs(spark, k):
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, rid int, component_id string")
    got = near_dup.near_duplicates(df, shingle=k)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, k)


def test_blocks_agree(spark, monkeypatch):
    rows = documents(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BROADCAST_KEYS", 0)
    got = near_dup.near_duplicates(df, shingle=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)


def test_near_copies_beside_two_heavier_hubs(spark):
    """Copies share lists of two only; each shares a passage with each of two half-similar, better connected pages."""
    rng = random.Random(5)
    passage = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(30):
        core, own, (p, q, r, s) = passage(195), passage(165), [passage(18) for _ in range(4)]
        rows += [core + own + p + q, core + own + r + s, core + p + r, core + q + s, *(core + passage(60) for _ in range(4))]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 5)
    assert sum(d != c for d, _, c in want) >= 30
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_one_row_of_each_component_stays(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, kept int")
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "kept"]
    assert kept.count() == brute(rows, 5, roots=True)
    assert near_dup.drop_near_duplicates(df.limit(0)).collect() == []


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 100), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 105)}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op5_minhash_near_dedup"](spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
