"""Documents packed into chunks, and blobs of keys sent between chunks and shards.

Some operators need to know of each small key (a line, a 32-byte string) whether it occurs elsewhere.
Rows of single keys would cost more than the keys, so a chunk of documents sends one blob per shard and
the shard answers with one blob per chunk. Keys are hashed evenly over shards and counted once per chunk,
so a key that every document has costs each chunk one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import stored

CHUNK_BYTES = 1 << 20
#: Text that one shard answers for, on average.
SHARD_BYTES = 32 << 20


def _size(batch: pa.RecordBatch) -> int:
    return max(1, batch.nbytes)


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(payload)) as stream:
        return stream.read_all()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        step = max(1, math.ceil(batch.num_rows * CHUNK_BYTES / _size(batch)))
        for lo in range(0, batch.num_rows, step):
            piece = batch.slice(lo, step)
            piece = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=batch.schema)
            payload = pack_rows(piece)
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([part << 32 | n], pa.int64()), "raw": pa.array([_size(piece)], pa.int64()),
                 "payload": pa.array([payload], pa.binary())}
            )
            n += 1


def pack_chunks(df: DataFrame) -> DataFrame:
    """A stored table (chunk, raw, payload) of all rows of ``df``, compressed, about a megabyte each.

    Chunks have ids of their own, so null or repeated ids of rows do no harm.
    """
    return stored(df.mapInArrow(_pack, "chunk long, raw long, payload binary"), "chunks")


def shard_count(chunks: DataFrame) -> int:
    """How many shards keep each one's share of keys small; grows with the input."""
    raw = chunks.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(raw / SHARD_BYTES))
