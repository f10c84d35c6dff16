"""Words: what a worker holds at a time."""

import tracemalloc

import pyarrow as pa

from auditframe.llm import near_dup, quality
from auditframe.llm import words as W


def test_working_memory_of_a_batch_is_small():
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i}x{j}" for j in range(150)) for i in range(1500)]})
    tracemalloc.start()
    try:
        for piece in W.slices(batch, "text"):
            quality.features(piece.column("text"))
            near_dup.signatures(near_dup.shingle_sets(piece.column("text"), 2))
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_slices_hold_every_row_once_and_long_texts_alone():
    texts = ["a" * 100, None, "b" * (W.SLICE_BYTES + 1), "", *["c" * 1000] * 600]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    pieces = [p.column("text").to_pylist() for p in W.slices(batch, "text")]
    assert [t for p in pieces for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= W.SLICE_BYTES for p in pieces)
