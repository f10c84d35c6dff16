"""Importance resampling against a plain version, and the selection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditframe.llm import resampling


def plain(docs, target, ngram=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """docs: (id, text) rows; the rank of equal keys is left to the caller."""

    def feats(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    rows = [(i, *feats(t)) for i, t in docs]
    raw = Counter(b for _, _, f in rows for b in f)
    aim = Counter(b for t in target for b in feats(t)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for i, n_words, f in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return out, [(r[0], r[4]) for r in drawn]


def held(rows, want):
    every, drawn = want
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == Counter((i, n, w, s) for i, _, n, w, s in every)
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


WORDS = ["alpha", "Beta", "gamma7", "délta", "ΕΨ", "x", "42", "it's", "a_b", "ß", "日本", "zeta" * 30]


@pytest.mark.parametrize("ngram", [1, 3])
def test_against_plain(spark, ngram):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(60)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "word " * 60_000), (1004, "w" * 100_000), (None, "alpha beta " * 20)]
    docs += [docs[7], docs[7], (7, "another text for an id that is taken " * 4), (1005, "tail"), (1006, "head")]
    target = [" ".join(rng.choices(WORDS[:4], k=50)) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS id", "4 AS carried").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aim, ngram=ngram, percent=40, last_keys=3, carry=["score", "text"]).collect()
    held(got, plain(docs, target, ngram, percent=40))
    assert Counter((r.doc_id, r.carried.text) for r in got) == Counter(docs) and {r.carried.score for r in got} == {1}


def test_words_do_not_cross_rows(spark):
    docs = [(1, "ab"), (2, "cd"), (3, ""), (4, "ef gh"), (5, "é"), (6, "é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    held(resampling.resample(df, df, ngram=2, min_words=1, percent=100).collect(), plain(docs, [t for _, t in docs], 2, min_words=1, percent=100))


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "one " * 30)], "doc_id long, text string")
    none = df.limit(0)
    assert resampling.resample(none, df).collect() == []
    assert [r["rank"] for r in resampling.resample(df, none).collect()] == [None]  # a tenth of one row is none
    assert [r["rank"] for r in resampling.resample(df, none, percent=100).collect()] == [1]


def test_text_ids(spark):
    df = spark.createDataFrame([(f"d{i:02d}", "same words " * 15) for i in range(30)], "doc_id string, text string")
    rows = resampling.resample(df, df, percent=50, last_keys=2).collect()
    best = sorted(rows, key=lambda r: (-r.score, r.doc_id))[:15]
    assert [r.doc_id for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == [r.doc_id for r in best]


def test_cutoff_is_exact_whatever_the_partitions(spark):
    rng = random.Random(3)
    # One value holds a third of all rows, and the partitions are sorted and of very different sizes.
    keys = [(0 if rng.random() < 0.33 else rng.randrange(-50, 50), rng.choice([None, *range(40)]), r) for r in range(3000)]
    df = spark.createDataFrame(keys, "score long, id long, rid long").withColumn("p", F.pow(F.rand(1), 4) * 6).repartitionByRange(6, "p").drop("p")
    order = sorted(keys, key=lambda k: (-k[0], k[1] is None, k[1] or 0, k[2]))
    for n in (1, 2, 700, 1500, 2999, 3000, 5000):
        got = resampling.cutoff_key(df, n, last_keys=4)
        assert (got.score, got.id, got.rid) == order[min(n, 3000) - 1]
    assert resampling.cutoff_key(df, 0) is None and resampling.cutoff_key(df.limit(0), 5) is None


def test_crc_of_bytes():
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 3000, 200))
    starts, ends = cuts[:-1], cuts[1:]
    got = resampling._crc_on(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
