"""Nearest neighbours by collision counting: sorted projections, windows that widen, verified candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.llm.common import stored

NEIGHBOURS = 10
#: Lines that vectors are projected on, each with a sorted array.
PROJECTIONS = 64
#: Share of the projections in which a vector must fall into the query's window to be verified.
THRESHOLD = 0.75
#: Growth of the windows from one round to the next (virtual rehashing).
RATIO = 1.3
#: Half a window at the end, as a multiple of the distance to be covered. Differences projected on normal lines are
#: normal with the distance as deviation, so a vector at just that distance is inside on 0.866 of the lines and
#: on fewer than ``THRESHOLD`` of 64 with a chance below 1 in 100; nearer ones are missed less often.
REACH = 1.5
#: Vectors of a block, which has its own sorted arrays.
BLOCK = 16_384


class ProjectionIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        values = (self.vectors @ self.lines).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        # The first window holds about one vector in sixteen on a line.
        n = len(vectors)
        spread = self.sorted[:, (3 * n) // 4] - self.sorted[:, n // 4]
        self.width = float(np.median(spread)) / 16

    def nearest(self, own: int, query: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, none beyond ``bound``."""
        n, at = len(self.ids), query @ self.lines
        need = math.ceil(THRESHOLD * PROJECTIONS)
        counts, verified = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        lo = hi = [int(line.searchsorted(x)) for line, x in zip(self.sorted, at, strict=True)]
        got, distance = np.empty(0, np.int64), np.empty(0)
        half = REACH * bound if math.isfinite(bound) else max(self.width, 1e-12)
        while True:
            reached = [
                line.searchsorted((x - half, np.nextafter(x + half, np.inf))).tolist()
                for line, x in zip(self.sorted, at, strict=True)
            ]
            # Only what a window gains on either side is counted.
            gained = [o[min(a, l) : l] for o, (a, _), l in zip(self.order, reached, lo, strict=True)]
            gained += [o[h : max(b, h)] for o, (_, b), h in zip(self.order, reached, hi, strict=True)]
            counts += np.bincount(np.concatenate(gained), minlength=n)
            lo = [min(a, l) for (a, _), l in zip(reached, lo, strict=True)]
            hi = [max(b, h) for (_, b), h in zip(reached, hi, strict=True)]
            new = np.flatnonzero((counts >= need) & ~verified)
            verified[new] = True
            new = new[self.ids[new] != own]
            away = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
            got, distance = np.concatenate([got, new]), np.concatenate([distance, away])
            best = np.lexsort((self.ids[got], distance))[:k]
            got, distance = got[best], distance[best]
            if len(got) == k:
                bound = min(bound, float(distance[-1]))
            if half >= REACH * bound or all(a == 0 and b == n for a, b in zip(lo, hi, strict=True)):
                break
            # Once k are known their distance says how far the windows must still go.
            half = REACH * bound if math.isfinite(bound) else half * RATIO
        near = distance <= bound
        return self.ids[got[near]], distance[near]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _search(k: int, dim: int):
    """Rows come sorted by block, its vectors before its queries: one index is built a block and held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, ids, vectors = None, None, [], []
        for batch in batches:
            blocks, asks = np.asarray(batch.column("block")), np.asarray(batch.column("asks"))
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != current:
                    current, index, ids, vectors = blocks[lo], None, [], []
                mine, matrix = np.asarray(part.column("vec_id")), _matrix(part.column("vector"), dim)
                if not asks[lo]:
                    ids.append(mine)
                    vectors.append(matrix)
                    continue
                if index is None and ids:
                    index = ProjectionIndex(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                if index is None:
                    continue
                found = [index.nearest(q, x, k, b) for q, x, b in zip(mine.tolist(), matrix, part.column("bound").to_pylist(), strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(mine, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    schema=_FOUND,
                )

    return run


def nearest_neighbours(
    df: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, dim: int | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest vectors found for each query, ties to the smaller id.

    Vectors are dealt evenly into blocks of about ``BLOCK``. A block keeps the projections on each of
    ``PROJECTIONS`` random lines as a sorted array. A query's windows on all lines widen together by ``RATIO``; vectors that
    are inside on ``THRESHOLD`` of the lines are verified by their exact Euclidean distance, in double precision. As soon as
    ``k`` are known, the distance of the last says how wide the windows must be to hold everything nearer, and the search
    ends there. Each query first asks one block; with the distance found it opens its windows in all others at once and
    takes nothing beyond it. The best ``k`` of a task are chosen before those of all blocks meet.

    The query set is stated by the caller and meets every block: a block is a stream of its vectors and then the queries, so
    its index is built once and a task holds one block. Vectors have ``dim`` components, by default as many as the
    queries have (the commonest number among them, ties to the smaller). Others take no part, neither as queries nor as
    candidates; nor do vectors that are null, zero, or hold null or non-finite components, nor rows without id. A query
    never finds rows with its own id. Rows that repeat an id and vector are candidates each; a query that is asked
    twice is answered once for each different vector it comes with. Empty tables give no rows.
    """

    def usable(rows: DataFrame) -> DataFrame:
        components = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
        rows = rows.select(F.col(f"`{id}`").cast("long").alias("vec_id"), components.alias("vector"))
        finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        return rows.filter(
            F.col("vec_id").isNotNull()
            & F.col("vector").isNotNull()
            & F.forall("vector", finite)
            & F.exists("vector", lambda x: x != 0)
        )

    asked = stored(usable(queries).distinct(), "queries")
    if dim is None:
        lengths = asked.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        dim = lengths[0]["dim"] if lengths else 1
    length = F.size("vector") == dim
    asked = asked.filter(length)
    # Rows are dealt by their number, so a vector that fills a third of the table fills no block.
    vectors = stored(usable(df).filter(length).withColumn("row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, math.ceil(vectors.count() / BLOCK))
    deal = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")
    members = vectors.select(deal("row").alias("block"), F.lit(False).alias("asks"), "vec_id", "vector", F.lit(None).cast("double").alias("bound"))

    def search(rows: DataFrame, block: Column) -> DataFrame:
        ask = rows.select(block.alias("block"), F.lit(True).alias("asks"), "vec_id", "vector", "bound")
        streams = members.union(ask).repartition("block").sortWithinPartitions("block", "asks")
        return streams.mapInArrow(_search(k, dim), "query_id long, vec_id long, score double")

    first = F.lit(float("inf"))
    own = deal("vec_id")
    found = search(asked.withColumn("bound", first), own)
    if blocks > 1:
        found = stored(found, "first")
        reach = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("reach"))
        bounded = asked.join(reach, asked["vec_id"] == reach["query_id"], "left").withColumn("bound", F.coalesce("reach", first))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != own))
        found = found.union(search(bounded, others))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
