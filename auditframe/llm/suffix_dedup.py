"""Suffix-array dedup: bytes covered by a string that also starts earlier, found shard by shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.chunks import pack_chunks, shard_count, unpack_rows
from auditframe.llm.common import stored
from auditframe.llm.suffixes import permuted_common_prefixes, suffix_array
from auditframe.llm.words import as_bytes, mix, powers

LENGTH = 100
#: Bytes of an anchor. Each string of ``LENGTH`` bytes is found by the smallest hash among its anchors.
ANCHOR = 32
#: Different surroundings of an anchor beyond which its strings are dealt out one by one.
HOT = 20_000
#: Bytes of surroundings that are sorted together; an anchor's own are never parted.
SORT_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64), 31)
_LAST = (1 << 63) - 1


class Chunk:
    """Documents of a chunk: their bytes in one array, and the anchor of every string of ``length`` bytes.

    Strings with the same anchor place, one after the other, are a segment; its bytes are the anchor's
    surroundings. Equal strings have equal anchors, so equal strings meet wherever their anchor's hash goes.
    """

    def __init__(self, payload: bytes, length: int) -> None:
        rows = unpack_rows(payload)
        self.ids = np.asarray([_LAST if i is None else i for i in rows.column("id").to_pylist()], dtype=np.int64)
        self.data, self.offsets = as_bytes(rows.column("text").combine_chunks())
        n, k = len(self.data), min(ANCHOR, length)
        values = _BYTE[self.data]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)
        lengths = np.diff(self.offsets)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        empty = np.empty(0, np.int64)
        if n < length:
            self.anchor = self.first = self.last = empty
            self.hashes = empty.astype(np.uint64)
            return
        h = mix(self.content(np.arange(n - k + 1), np.arange(k, n + 1)))
        w = length - k + 1  # anchors in a string
        least = h
        span = 1
        while 2 * span <= w:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[: n - length + 1], least[w - span : w - span + n - length + 1])
        windows = sliding_window_view(h, w)
        run = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.append(run[1:], len(least)) - 1
        anchor = np.empty(len(least), np.int64)
        place = np.concatenate([empty, *(r + windows[r].argmin(axis=1) for r in np.array_split(run, len(run) // 20_000 + 1))])
        anchor[:] = np.repeat(place, end - run + 1)
        # A run outlives its first place only where the smallest hash occurs again: repeated text.
        late = np.flatnonzero(np.arange(len(anchor)) > anchor)
        for part in np.array_split(late, len(late) // 20_000 + 1):
            anchor[part] = part + windows[part].argmin(axis=1)
        starts = np.flatnonzero(self.row[: n - length + 1] == self.row[length - 1 :])
        anchor = anchor[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        self.anchor = anchor[begin]
        self.first = starts[begin]
        self.last = starts[np.append(begin[1:], len(starts)) - 1] if len(begin) else empty
        self.hashes = h[self.anchor]

    def content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each a to b."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each element is the first with its values, in the order given."""
    if not len(keys[0]):
        return np.empty(0, bool)
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def _by_shard(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (keys % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(shard[part[0]]), part


_COUNT = np.dtype([("hash", "<u8"), ("n", "<u4"), ("kinds", "<u4")])


def _send_anchors(n_shards: int, length: int):
    """The chunk's distinct anchor hashes: how often each occurs, and in how many surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch["chunk"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                own = Chunk(payload, length)
                kinds = _first_of(own.content(own.first, own.last + length), own.hashes)
                distinct, at, n = np.unique(own.hashes, return_inverse=True, return_counts=True)
                entries = np.empty(len(distinct), _COUNT)
                entries["hash"], entries["n"] = distinct, n
                entries["kinds"] = np.bincount(at, weights=kinds, minlength=len(distinct))
                shards = list(_by_shard(distinct, n_shards))
                if shards:
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([s for s, _ in shards], pa.int32()), "chunk": pa.array([chunk] * len(shards), pa.int64()),
                         "entries": pa.array([entries[p].tobytes() for _, p in shards], pa.binary())}
                    )

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For every chunk: which of its anchors occur more than once anywhere, and which of these are hot."""
    blobs = [np.frombuffer(x, _COUNT) for x in table["entries"].to_pylist()]
    every = np.concatenate([np.empty(0, _COUNT), *blobs])
    distinct, at = np.unique(every["hash"], return_inverse=True)
    n = np.bincount(at, weights=every["n"], minlength=len(distinct))
    kinds = np.bincount(at, weights=every["kinds"], minlength=len(distinct))
    chunks, answers = [], []
    lo = 0
    for chunk, blob in zip(table["chunk"].to_pylist(), blobs, strict=True):
        own = at[lo : lo + len(blob)]
        lo += len(blob)
        again = n[own] > 1
        if again.any():
            out = np.empty(int(again.sum()), _COUNT)
            out["hash"], out["n"], out["kinds"] = blob["hash"][again], 2, kinds[own][again] > HOT
            chunks.append(chunk)
            answers.append(out.tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "answer": pa.array(answers, pa.binary())})


_SEGMENT = np.dtype([("key", "<u8"), ("id", "<i8"), ("row", "<u4"), ("at", "<i8"), ("size", "<u4")])
_RANGE = np.dtype([("row", "<u4"), ("start", "<i8"), ("end", "<i8")])
_SENT = "shard int, chunk long, entries binary, texts binary"


def _send_segments(n_shards: int, length: int):
    """Surroundings of anchors that occur again: the first of equal ones goes to the anchor's shard, for the
    others the answer is known here. Rows without a shard carry ranges to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, answers in zip(*(batch[c].to_pylist() for c in ("chunk", "payload", "answers")), strict=True):
                if not answers:
                    continue
                own = Chunk(payload, length)
                told = np.concatenate([np.frombuffer(a, _COUNT) for a in answers])
                told = told[np.argsort(told["hash"])]
                at = np.minimum(np.searchsorted(told["hash"], own.hashes), len(told) - 1)
                again = told["hash"][at] == own.hashes
                hot = again & (told["kinds"][at] == 1)
                first, last, keys = own.first[again & ~hot], own.last[again & ~hot], own.hashes[again & ~hot]
                if hot.any():  # string by string, each under a key of its own
                    n = own.last[hot] - own.first[hot] + 1
                    single = np.repeat(own.first[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    first, last = np.append(first, single), np.append(last, single)
                    keys = np.append(keys, mix(own.content(single, single + length), 3))
                order = np.lexsort((first, own.row[first], own.ids[own.row[first]]))
                first, last, keys = first[order], last[order], keys[order]
                new = _first_of(own.content(first, last + length), last - first, keys)
                entries = np.empty(len(first), _SEGMENT)
                entries["key"], entries["id"], entries["row"] = keys, own.ids[own.row[first]], own.row[first]
                entries["at"], entries["size"] = first - own.offsets[own.row[first]], last - first + length
                shards, blobs, texts = [], [], []
                old = entries[~new]
                if len(old):
                    shards.append(None)
                    ranges = np.empty(len(old), _RANGE)
                    ranges["row"], ranges["start"], ranges["end"] = old["row"], old["at"], old["at"] + old["size"]
                    blobs.append(_merged(ranges).tobytes())
                    texts.append(b"")
                first, entries = first[new], entries[new]
                for shard, part in _by_shard(entries["key"], n_shards):
                    size = entries["size"][part].astype(np.int64)
                    take = np.repeat(first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    shards.append(shard)
                    blobs.append(entries[part].tobytes())
                    texts.append(zlib.compress(own.data[take].tobytes(), 1))
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array(shards, pa.int32()), "chunk": pa.array([chunk] * len(shards), pa.int64()),
                     "entries": pa.array(blobs, pa.binary()), "texts": pa.array(texts, pa.binary())}
                )

    return run


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges by row and start, overlapping and touching ones joined."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.lexsort((ranges["start"], ranges["row"]))]
    # Rows far apart on one line, so that a running maximum never reaches from row to row.
    reach = int(ranges["end"].max()) + 2
    shift = ranges["row"].astype(np.int64) * reach
    ends = np.maximum.accumulate(ranges["end"] + shift)
    new = np.ones(len(ranges), bool)
    new[1:] = ranges["start"][1:] + shift[1:] > ends[:-1]
    begin = np.flatnonzero(new)
    out = ranges[begin].copy()
    out["end"] = ends[np.append(begin[1:], len(ranges)) - 1] - shift[begin]
    return out


def _settle(length: int):
    """In a shard: ranges to remove, for every chunk that sent surroundings."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table["chunk"].to_numpy()
        blobs = [np.frombuffer(x, _SEGMENT) for x in table["entries"].to_pylist()]
        every = np.concatenate(blobs)
        source = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        data = np.frombuffer(b"".join(zlib.decompress(t) for t in table["texts"].to_pylist()), np.uint8)
        size = every["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
        content = (sums[begin + size] - sums[begin]) * powers(_INVERSE, len(data) + 1)[begin]
        # One order of all documents; rows that share an id come in the order of their chunks.
        order = np.lexsort((every["at"], every["row"], chunks[source], every["id"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        new = np.empty(len(order), bool)
        new[order] = _first_of(content[order], size[order], every["key"][order])
        gone = [_whole(every, source, np.flatnonzero(~new))]

        kept = np.flatnonzero(new)
        kept = kept[np.lexsort((rank[kept], every["key"][kept]))]
        # Anchors with one kind of surroundings have nothing to compare.
        keys = every["key"][kept]
        same = np.zeros(len(kept), bool)
        same[1:] = keys[1:] == keys[:-1]
        some = same.copy()
        some[:-1] |= same[1:]
        kept, same = kept[some], same[some]
        heads = np.flatnonzero(~same)
        total = np.concatenate([[0], np.cumsum(size[kept])])
        lo = 0
        while lo < len(kept):
            later = heads[heads > lo]
            fits = later[total[later] - total[lo] <= SORT_BYTES]
            hi = int(fits[-1]) if len(fits) else (int(later[0]) if len(later) else len(kept))
            if len(later) == len(fits) and total[-1] - total[lo] <= SORT_BYTES:
                hi = len(kept)
            gone.append(_sorted_repeats(every, source, kept[lo:hi], begin, size, rank, data, length))
            lo = hi
        rows = np.concatenate([g[0] for g in gone])
        ranges = np.concatenate([g[1] for g in gone])
        out_chunks, answers = [], []
        by_source = np.argsort(rows, kind="stable")
        cuts = np.flatnonzero(np.diff(rows[by_source])) + 1
        for part in np.split(by_source, cuts) if len(by_source) else ():
            out_chunks.append(int(chunks[rows[part[0]]]))
            answers.append(_merged(ranges[part]).tobytes())
        return pa.table({"chunk": pa.array(out_chunks, pa.int64()), "answer": pa.array(answers, pa.binary())})

    return run


def _whole(every: np.ndarray, source: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ranges = np.empty(len(which), _RANGE)
    own = every[which]
    ranges["row"], ranges["start"], ranges["end"] = own["row"], own["at"], own["at"] + own["size"]
    return source[which], ranges


def _sorted_repeats(every, source, which, begin, size, rank, data, length) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes that start earlier in another of these surroundings, by their suffix array."""
    n = size[which]
    # Text with a separator after each segment, and the sentinel.
    place = np.cumsum(n + 1) - (n + 1)
    text = np.ones(int((n + 1).sum()) + 1, np.uint16)
    text[-1] = 0
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(place, n) + inside] = data[np.repeat(begin[which], n) + inside].astype(np.uint16) + 2
    sa = suffix_array(text, length)
    shared = permuted_common_prefixes(text, sa, length, length)
    segment = np.full(len(text), -1, np.int64)
    windows = n - length + 1
    within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    segment[np.repeat(place, windows) + within] = np.repeat(np.arange(len(which)), windows)
    group = np.cumsum(shared[sa] < length)
    valid = segment[sa] >= 0
    sa, group = sa[valid], group[valid]
    seg = segment[sa]
    at = sa - place[seg]
    # Segments are ranked by document and place; two in one document never start at the same place.
    order = np.lexsort((at, rank[which][seg], group))
    again = np.zeros(len(order), bool)
    again[1:] = group[order][1:] == group[order][:-1]
    seg, at = seg[order][again], at[order][again]
    own = every[which[seg]]
    ranges = np.empty(len(seg), _RANGE)
    ranges["row"], ranges["start"] = own["row"], own["at"] + at
    ranges["end"] = ranges["start"] + length
    return source[which[seg]], ranges


def _finish(names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch["payload"].to_pylist(), batch["answers"].to_pylist(), strict=True):
                rows = unpack_rows(payload)
                data, offsets = as_bytes(rows.column("text").combine_chunks())
                gone = np.zeros(len(data) + 1, np.int64)
                for answer in answers or ():
                    ranges = np.frombuffer(answer, _RANGE)
                    base = offsets[ranges["row"]]
                    np.add.at(gone, base + ranges["start"], 1)
                    np.add.at(gone, base + ranges["end"], -1)
                gone = np.cumsum(gone)[: len(data)] > 0
                kept, sizes, removed, spans = [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = gone[a:b]
                    sizes.append(b - a)
                    removed.append(int(own.sum()))
                    spans.append(int(own[:1].sum() + np.count_nonzero(own[1:] & ~own[:-1])))
                    kept.append(data[a:b][~own].tobytes() if removed[-1] else data[a:b].tobytes())
                columns = [rows.column(f"c{k}") for k, c in enumerate(names) if c != text]
                counts = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
                out = pa.table([*columns, pa.array(kept, pa.binary()), *counts], names=[f"o{k}" for k in range(len(columns) + 4)])
                yield from out.combine_chunks().to_batches()

    return run


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The other columns of ``df``, then ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte of the text (as UTF-8) is removed if a string of ``length`` bytes covers it that also starts
    earlier: in a row with a smaller ``id``, or in the same row further in front. Matches stay within a row
    and are judged on the input. ``n_spans`` counts the runs removed; what is left may cut a character.

    Every string is known by the smallest hash among its substrings of ``ANCHOR`` bytes. Chunks of documents
    send their anchors' hashes to shards and learn which occur again; only the surroundings of those travel.
    A shard builds suffix arrays of the surroundings by induced sorting, and in each run of suffixes that share
    ``length`` characters all but the earliest are repeats. Equal surroundings are sent once per chunk. The
    strings of an anchor with more than ``HOT`` different surroundings are dealt out one by one, so that no
    shard gathers an unbounded group; nothing is left out.

    A null text is empty. A null id counts as the largest; rows with equal ids come in a fixed order of
    their own and count as earlier and later rows. An empty table gives no rows.
    """
    df = df.drop("kept", "n_bytes", "n_removed", "n_spans")
    names = df.columns
    others = [(k, c) for k, c in enumerate(names) if c != text]
    packed = pack_chunks(
        df.select(
            F.col(f"`{id}`").cast("long").alias("id"),
            F.col(f"`{text}`").cast("string").alias("text"),
            *[F.col(f"`{c}`").alias(f"c{k}") for k, c in others],
        )
    )
    n_shards = shard_count(packed)
    together = lambda answers: answers.groupBy("chunk").agg(F.collect_list("answer").alias("answers"))
    anchors = packed.select("chunk", "payload").mapInArrow(_send_anchors(n_shards, length), "shard int, chunk long, entries binary")
    again = anchors.groupBy("shard").applyInArrow(_answer_anchors, "chunk long, answer binary")
    sent = stored(
        packed.select("chunk", "payload").join(together(again), "chunk").select("chunk", "payload", "answers")
        .mapInArrow(_send_segments(n_shards, length), _SENT),
        "segments",
    )
    found = sent.filter("shard IS NOT NULL").groupBy("shard").applyInArrow(_settle(length), "chunk long, answer binary")
    ranges = found.union(sent.filter("shard IS NULL").select("chunk", F.col("entries").alias("answer")))
    kinds = [f"o{i} {df.schema[c].dataType.simpleString()}" for i, (_, c) in enumerate(others)]
    n = len(others)
    schema = ", ".join([*kinds, f"o{n} binary", *(f"o{n + i} long" for i in (1, 2, 3))])
    done = packed.select("chunk", "payload").join(together(ranges), "chunk", "left").select("payload", "answers")
    return done.mapInArrow(_finish(names, text), schema).toDF(*[c for _, c in others], "kept", "n_bytes", "n_removed", "n_spans")
