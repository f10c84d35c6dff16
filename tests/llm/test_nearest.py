"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from auditframe.llm import nearest, queries


def brute(vectors, asked, k=10):
    """vectors: id -> list of rows."""
    out = {}
    for q, x in asked:
        scored = sorted((float(np.sqrt(((y - x) ** 2).sum())), v) for v, y in vectors if v != q)
        out[q] = scored[:k]
    return out


def recall(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) <= set(want)
    hits = total = 0
    for q, best in want.items():
        mine = got.get(q, [])
        assert len(mine) == len(best) and mine == sorted(mine)
        hits += sum(a <= best[-1][0] + 1e-12 for a, _ in mine)
        total += len(best)
    return hits / max(total, 1)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_query(spark, size):
    folder = f"/root/testdata/{size}"
    data = [(r.vec_id, np.asarray(r.embedding, dtype=float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding]
    rows = queries.QUERIES["op6_collision_counting_knn"](spark, folder).collect()
    want = brute(data, [(v, x) for v, x in data if v % 100 == 0])
    assert recall(rows, want) >= 0.95
    exact = dict(data)
    for r in rows:
        assert math.isclose(r.score, float(np.sqrt(((exact[r.query_id] - exact[r.vec_id]) ** 2).sum())), rel_tol=1e-12)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, [0.0] * 6), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (303, [float("nan")] + [1.0] * 5), (304, [float("inf")] + [1.0] * 5), (305, [1.0, 2.0]), (None, [1.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS score")
    asked = df.filter("vec_id % 50 = 0 OR vec_id IS NULL")
    got = nearest.nearest_neighbours(df, asked).collect()
    good = [(v, np.array(x, dtype=float)) for v, x in rows if v is not None and v < 300 and x]
    want = brute(good, [(v, x) for v, x in good if v % 50 == 0])
    assert recall(got, want) == 1.0
    first = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0]
    assert first == [200 + i for i in range(10)]  # ties go to smaller ids
    assert nearest.nearest_neighbours(df, asked, dim=2).collect() == []  # no query has two components
    assert nearest.nearest_neighbours(df.limit(0), asked).collect() == []
    assert nearest.nearest_neighbours(df, asked.limit(0)).collect() == []
    few = df.filter("vec_id < 4")
    assert len(nearest.nearest_neighbours(few, few.filter("vec_id = 0")).collect()) == 3
    (pair,) = nearest.nearest_neighbours(df.union(spark.createDataFrame([(400, [1.0, 2.5], 1, 2)], df.schema)), df.filter("vec_id = 305")).collect()
    assert (pair.vec_id, pair.score) == (400, 0.5)  # the queries say how many components count


@pytest.mark.parametrize("block", [300, 10_000])
def test_blocks_and_a_hot_vector(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 32)) * 3
    rows = [(i, (centres[i % 20] + rng.standard_normal(32)).tolist()) for i in range(1400)]
    rows += [(i, rows[3][1]) for i in range(2000, 2700)]  # a third of all rows
    rows += [(7, rows[7][1])] * 400  # and one row over and over
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    good = [(v, np.array(x)) for v, x in rows]
    asked = [(v, np.array(x)) for v, x in rows[:1400] if v % 25 == 3]
    got = nearest.nearest_neighbours(df, df.filter("vec_id < 2000 AND vec_id % 25 = 3")).collect()
    assert recall(got, brute(good, asked)) >= 0.97


def test_far_fewer_are_verified_than_there_are(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((50, 32)) * 4
    vectors = centres[rng.integers(0, 50, 8000)] + rng.standard_normal((8000, 32))
    index = nearest.ProjectionIndex(np.arange(8000), vectors)
    seen = []
    lexsort = np.lexsort
    monkeypatch.setattr(nearest.np, "lexsort", lambda keys: seen.append(len(keys[0])) or lexsort(keys))
    for q in range(0, 8000, 400):
        index.nearest(q, vectors[q], 10, math.inf)
    assert sum(seen) / 20 < 0.08 * 8000
