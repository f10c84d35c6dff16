"""Packing: ids as the library gives them, complete slots, few sequences."""

import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditframe.llm import packing, queries

VOCABULARY = queries.word_vocabulary()


def ids_of(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


ODD = st.text(alphabet="aÉé́İΣσ 's't\n\t　\x0b12,.<|endoftext|>𝔘", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_words_alone_give_the_ids_of_the_text(texts):
    encode = packing.WordIds(VOCABULARY)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [ids[:-1] for ids in ids_of(texts)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_gives_every_rank_one_slot(histogram):
    plan = packing.plan_best_fit(histogram, 64)
    used = defaultdict(list)
    for length, first, n, sequence, each, at in plan:
        for i in range(n):
            used[sequence + i // each].append((at + i % each * length, length))
    ranks = defaultdict(list)
    for length, first, n, *_ in plan:
        ranks[length] += range(first, first + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for slots in used.values():
        ends = 0
        for at, length in sorted(slots):
            assert at == ends
            ends += length
        assert ends <= 64
    assert sorted(used) == list(range(len(used)))
    # Best fit never leaves two sequences that could be one.
    fill = sorted(sum(n for _, n in slots) for slots in used.values())
    assert len(fill) < 2 or fill[0] + fill[1] > 64


def check(rows, texts):
    want = [(i, p, s, len(x[s : s + 4096]), zlib.crc32(np.asarray(x[s : s + 4096], "<u4").tobytes()))
            for (i, _), x in zip(texts, ids_of([t or "" for _, t in texts]), strict=True)
            for p, s in enumerate(range(0, len(x), 4096))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        assert [o for o, _ in sorted(slots)] == [sum(n for _, n in sorted(slots)[:i]) for i in range(len(slots))]
        assert sum(n for _, n in slots) <= 4096
    return len(sequences), sum(r.length for r in rows)


def test_odd_rows(spark):
    rows = [(1, "", 5), (2, None, 6), (None, "word", 7), (3, "a b " * 9000, 8), (3, "a b " * 9000, 8), (4, "x" * 50000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    packed = packing.pack_documents(df, VOCABULARY)
    check(packed.collect(), [(r[0], r[1]) for r in rows])
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.pack_documents(df.limit(0), VOCABULARY).collect() == []


@pytest.mark.parametrize("name", ["op7_best_fit_packing"])
def test_query(spark, sf_dir, name):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, tokens = check(queries.QUERIES[name](spark, sf_dir).collect(), texts)
    assert n <= -(-tokens // 4096) + 1


def test_remembered_words_hold_little_memory():
    held = packing._Remembered()
    for lo in range(0, 500_000, 1000):
        _, new = held.known(f"word{i}" for i in range(lo, lo + 1000))
        held.add({w: bytes(8) for w in new})
    sizes = [sys.getsizeof(g) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in g.items()) for g in (held.young, held.old)]
    assert sum(sizes) < 48e6
