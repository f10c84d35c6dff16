"""Sharding: near-equal sizes, gapless slots, whole groups, hot keys and odd rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditframe.llm import queries, sharding

SCHEMA = "id long, text string, shard string, bw int"


def sharded(df, n, **options):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return sharding.shard_records(df, n, F.xxhash64("text"), size, F.xxhash64("id"), **options)


def size_of(text):
    return len((text or "").encode()) + 8


def judge(rows, source, n, whole=sharding.WHOLE_SHARE):
    assert Counter((r.id, r.text, r.bw) for r in rows) == Counter((r[0], r[1], r[3]) for r in source)
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += size_of(r.text)
        slots[r.shard].append(r.slot)
        groups[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(loads.values()), max(size_of(r[1]) for r in source)
    assert max(loads.values()) - min(loads.get(s, 0) for s in range(n)) <= 2 * (largest + whole * total / n)
    held = Counter()
    for r in source:
        held[r[1]] += size_of(r[1])
    assert all(len(groups[t]) == 1 for t, b in held.items() if b <= whole * total / n)
    return groups


def test_even_rows_and_groups(spark):
    rows = [(i, f"text {i % 3000} " * (1 + i % 7), "x", i) for i in range(9000)]
    judge(sharded(spark.createDataFrame(rows, SCHEMA), 5).collect(), rows, 5)


@pytest.mark.parametrize("partitions", [1, 6])
def test_hot_text_is_cut_and_leaves_others_alone(spark, partitions, monkeypatch):
    monkeypatch.setattr(sharding, "WHOLE_SHARE", 0.03)
    rows = [(i, f"small {i % 400} " * 3, "x", 0) for i in range(1200)] + [(10_000 + i, "hot text " * 9, "x", 1) for i in range(900)]
    groups = judge(sharded(spark.createDataFrame(rows, SCHEMA).repartition(partitions), 6).collect(), rows, 6, whole=0.03)
    assert len(groups["hot text " * 9]) > 2


def test_odd_rows(spark):
    rows = [(1, None, "x", 0), (1, None, "x", 0), (None, "", None, 1), (2, "é" * 50_000, "y", 2), (3, "a", "z", None), (3, "a", "z", None), (4, "日本", "", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sharded(df, 3)
    assert sorted(out.columns) == sorted(df.columns + ["slot"])
    got = out.collect()
    assert Counter((r.id, r.text, r.bw) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= {0, 1, 2}
    assert sharded(df.limit(0), 3).collect() == []
    # No size at all: everything in shard 0, in order.
    none = sharding.shard_records(df, 3, F.lit(None), F.lit(0), F.lit(None)).collect()
    assert {r.shard for r in none} == {0} and sorted(r.slot for r in none) == list(range(7))


def test_many_ranges_and_the_same_result_again(spark, monkeypatch):
    rows = [(i, f"text {i} " * (1 + i % 5), "x", i) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {(r.id, r.shard, r.slot) for r in sharded(df, 4).collect()}
    assert one == {(r.id, r.shard, r.slot) for r in sharded(df.repartition(9), 4).collect()}
    monkeypatch.setattr(sharding, "RANGE_SIZE", 200)
    judge(sharded(df, 4).collect(), rows, 4)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_sampled_sharding"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys()) and {r.law for r in rows} == {"bytes"}
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == size_of(texts[r.doc_id])
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 2 * (max(r["size"] for r in rows) + sharding.WHOLE_SHARE * sum(loads.values()) / 24)


def test_buckets():
    assert sharding._splitters([1, 5, 5, 5, 9]) == [1, 5, 6, 9]
    assert sharding._splitters([sharding._LEAST, sharding._LEAST]) == [sharding._LEAST + 1]


def test_groups_beside_a_heavy_key_stay_whole(spark, monkeypatch):
    """A range that a heavy key shares with others is cut by ties, their groups are not."""
    monkeypatch.setattr(sharding, "WHOLE_SHARE", 0.03)
    monkeypatch.setattr(sharding, "_splitters", lambda quantiles: [])
    rows = [(i, f"small {i % 40} " * 3, "x", 0) for i in range(120)] + [(10_000 + i, "hot text " * 9, "x", 1) for i in range(900)]
    groups = judge(sharded(spark.createDataFrame(rows, SCHEMA), 6).collect(), rows, 6, whole=0.03)
    assert len(groups["hot text " * 9]) > 2
