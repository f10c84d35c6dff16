"""Importance resampling towards a target distribution, by hashed n-gram features and Gumbel keys.

The draw is exact: the cutoff key is selected by weighted medians of the partitions' medians, and only rows above
it are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm import words as W
from auditframe.llm.common import stored

BUCKETS = 10_000
NGRAM = 1
MIN_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024
#: Keys between the bounds that the driver may hold: the search ends when no more are left.
LAST_KEYS = 50_000
#: Words longer than this are hashed one by one, the others byte by byte all at once.
SHORT_WORD = 48

#: Bytes of words once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_SPACE = 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words begin in these."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[data]
    # A word does not go on from one text into the next.
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if len(joined):
        starts, ends = np.union1d(starts, joined), np.union1d(ends, joined)
    return starts, ends, np.searchsorted(starts, offsets)


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes from ``starts`` to ``ends``."""
    lengths, state = ends - starts, state.copy()
    for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
        piece = data[starts[i] : ends[i]].tobytes()
        state[i] = zlib.crc32(piece, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = np.argsort(np.minimum(lengths, SHORT_WORD + 1), kind="stable")
    order = order[lengths[order] <= SHORT_WORD]
    sorted_lengths = lengths[order]
    at, own = starts[order], state[order]
    for j in range(int(sorted_lengths[-1]) if len(order) else 0):
        lo = np.searchsorted(sorted_lengths, j, side="right")  # words with more than j bytes
        own[lo:] = _CRC[(own[lo:] ^ data[at[lo:] + j]) & 255] ^ (own[lo:] >> 8)
    state[order] = own
    return state


def features(texts: pa.Array, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each feature, words of each row); a null text has none."""
    data, offsets = W.as_bytes(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, begins = _word_bounds(low, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(begins))
    last = begins[1:][row]
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    out, rows = [], []
    first = np.arange(len(starts))
    for n in range(ngram):
        whole = first + n < last[first]
        first, state = first[whole], state[whole]
        if n:
            state = _CRC[(state ^ np.uint32(_SPACE)) & 255] ^ (state >> 8)
        state = _crc_on(state, low, starts[first + n], ends[first + n])
        out.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        rows.append(row[first])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows), np.diff(begins)


def bucket_counts(df: DataFrame, text: str, ngram: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; added up in each task, at most ``buckets`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in W.slices(batch, "text"):
                counts += np.bincount(features(piece.column("text"), ngram, buckets)[0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[np.asarray(found["bucket"])] = np.asarray(found["n"])
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the raw one."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(gains: np.ndarray, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(batch, "text"):
                bucket, row, n_words = features(piece.column("text"), ngram, len(gains))
                n = np.bincount(row, minlength=len(piece))
                weight = np.zeros(len(piece), dtype=np.int64)
                np.add.at(weight, row, gains[bucket])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n_words), pa.array(n), pa.array(weight), *piece.columns[2:]],
                    ["id", "n_words", "n_features", "weight", *piece.schema.names[2:]],
                )

    return run


def score_rows(
    df: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, carry: Sequence[str] = (),
) -> DataFrame:
    """A stored table (id, n_words, n_features, weight, carried, score, rid), one row per row of ``df``."""
    raw = bucket_counts(df, text, ngram, buckets)
    gains = bucket_gains(raw, bucket_counts(target, target_text, ngram, buckets))
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), kept.alias("carried"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    weighed = rows.mapInArrow(
        _weigh(gains, ngram), f"id {types['id']}, n_words long, n_features long, weight long, carried {types['carried']}"
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(share)))
    return stored(weighed.withColumn("score", F.col("weight") + noise).withColumn("rid", F.monotonically_increasing_id()), "scored")


@dataclass(frozen=True)
class Key:
    """Place of a row in the order of the draw: highest score, smallest id (null last), first row."""

    score: int
    id: object
    rid: int

    def order(self) -> tuple:
        return (-self.score, self.id is None, 0 if self.id is None else self.id, self.rid)

    def reached(self, strictly: bool = False) -> Column:
        """Whether a row comes before this key, or is it."""
        score, id, rid = F.col("score"), F.col("id"), F.col("rid")
        here = rid < self.rid if strictly else rid <= self.rid
        if self.id is None:
            tie = id.isNotNull() | here
        else:
            tie = F.coalesce((id < F.lit(self.id)) | ((id == F.lit(self.id)) & here), F.lit(False))
        return (score > self.score) | ((score == self.score) & tie)


_ORDER = [("score", "descending"), ("id", "ascending"), ("rid", "ascending")]


def _median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The middle key of a partition and how many keys it has; keys are all that a task holds."""
    held = [b for b in batches if b.num_rows]
    if held:
        keys = pa.Table.from_batches(held)
        at = int(pc.sort_indices(keys, sort_keys=_ORDER, null_placement="at_end")[len(keys) // 2].as_py())
        n = pa.array([len(keys)], pa.int64())
        yield pa.RecordBatch.from_arrays([n, *[c.combine_chunks() for c in keys.slice(at, 1).columns]], ["size", *keys.schema.names])


def cutoff_key(rows: DataFrame, n: int, last_keys: int = LAST_KEYS) -> Key | None:
    """The ``n``-th key of the rows (score, id, rid) in the order of the draw, exactly; None for none.

    Each round every partition names its middle key, and the middle of these, weighted by how many keys each
    partition has left, splits the rest: at least a quarter lies on either side and the side without the cutoff
    is discarded. One key per partition comes to the driver, and at the end at most ``last_keys``.
    """
    keys = rows.select("score", "id", "rid")
    left = keys.count()
    if n <= 0 or not left:
        return None
    n, rest = min(n, left), keys
    lowest: Key | None = None
    highest: Key | None = None
    kind = keys.schema["id"].dataType.simpleString()
    while left > max(1, last_keys):
        found = rest.mapInArrow(_median, f"size long, score long, id {kind}, rid long").collect()
        medians = sorted(((Key(r["score"], r["id"], r["rid"]), r["size"]) for r in found), key=lambda m: m[0].order())
        seen, middle = 0, medians[-1][0]
        for key, size in medians:
            seen += size
            if 2 * seen >= left:
                middle = key
                break
        reached = rest.filter(middle.reached()).count()
        if reached == n:
            return middle
        if reached > n:
            # The middle key itself goes too: the cutoff comes before it.
            highest, left = middle, reached - 1
        else:
            lowest, left, n = middle, left - reached, n - reached
        rest = keys
        if lowest is not None:
            rest = rest.filter(~lowest.reached())
        if highest is not None:
            rest = rest.filter(highest.reached(strictly=True))
    last = sorted((Key(r["score"], r["id"], r["rid"]) for r in rest.collect()), key=Key.order)
    return last[n - 1]


def rank_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank from 1 in the order of the draw: sorted by ranges, counted up over partitions."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid").asc()]
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row per partition
    before, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, before))
        before += size
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, before long"))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("before") + within + 1).drop("part", "before", "place")


def resample(
    df: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    ngram: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = SHARE_PERCENT,
    seed: int = SEED, carry: Sequence[str] = (), last_keys: int = LAST_KEYS,
) -> DataFrame:
    """(id, n_features, weight, score, rank, carried) of every row of ``df``; rows with a rank are drawn.

    Features are runs of 1 to ``ngram`` words, hashed by CRC-32 into ``buckets``. A bucket's gain is the log ratio of
    its smoothed shares in ``target`` and ``df``; a text's weight is the sum of its features' gains, read from an array.
    Gumbel noise from the hash of the id makes the highest scores a draw without replacement. Of rows with at least
    ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn.

    A null text counts as empty: no features, weight 0, never drawn if ``min_words`` is above 0. A null id is hashed as
    an empty one and comes last among equal scores. Rows that repeat an id stay rows of their own; equal keys are drawn
    in the order of the stored table. Empty tables give no rows; an empty target gives gains from smoothing alone.
    ``carried`` holds the columns named by ``carry`` in a struct, so no name can clash.
    """
    scored = score_rows(df, target, id, text, target_text, ngram, buckets, seed, carry)
    able = scored.filter(F.col("n_words") >= min_words)
    last = cutoff_key(able, able.count() * percent // 100, last_keys)
    drawn = (F.col("n_words") >= min_words) & last.reached() if last else F.lit(False)
    columns = [F.col("id").alias(id), "n_features", "weight", "score", "rank", "carried"]
    undrawn = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*columns)
    return undrawn.union(rank_rows(scored.filter(drawn)).select(*columns)) if last else undrawn
