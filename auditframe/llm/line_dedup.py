"""Line dedup: shards of minimal perfect hashes over line hashes, probed by the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.chunks import pack_chunks, shard_count, unpack_rows
from auditframe.llm.common import stored

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
_SPACE = " \t\n\x0b\x0c\r"
_NULL_ID = -(1 << 63)
#: Per key in a blob: 128-bit hash, documents of the chunk that have it, largest id among them.
_ENTRY = np.dtype([("at", "<u8"), ("print", "<u8"), ("n", "<u4"), ("last", "<i8")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys["at"] + keys["print"] * np.uint64(((2 * level + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit hashes (``at``, ``print``): n keys to 0..n-1, in about three bits a key.

    Each level has a bit for every place that exactly one of its keys falls on; keys that meet go on to the
    next level. A key's number is the count of bits before its own. A hash that is no key may get any
    answer, or -1; the caller compares fingerprints.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [np.empty(0, np.uint64)], keys
        while len(left):
            m = len(left) + len(left) // 2 + 64
            m += -m % 64
            at = (_mixed(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        every = np.concatenate(words)
        ranks = np.cumsum(np.bitwise_count(every), dtype=np.uint32) - np.bitwise_count(every)
        return cls(np.array(sizes, np.int64), every, ranks.astype(np.uint32))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes.tolist()):
            at = (_mixed(keys[open_], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.words[base + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.ranks[base + (at >> 6)] + below)[hit]
            open_, base = open_[~hit], base + m // 64
        return out


def line_key(line: str, min_length: int) -> bytes | None:
    """What lines are compared by: no space at the ends, A-Z lower-cased; None if too short."""
    line = line.strip(_SPACE)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_length else None


def _digests(text: str | None, min_length: int) -> list[bytes | None]:
    keys = (line_key(x, min_length) for x in (text or "").split("\n"))
    return [k if k is None else xxhash.xxh3_128_digest(k) for k in keys]


def _ids(rows: pa.Table) -> list[int]:
    return [_NULL_ID if i is None else i for i in rows.column("id").to_pylist()]


def _send(n_shards: int, min_length: int):
    """From every chunk a blob of its distinct line keys for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch["chunk"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                rows = unpack_rows(payload)
                found: dict[bytes, list[int]] = {}
                for i, text in zip(_ids(rows), rows.column("text").to_pylist(), strict=True):
                    for digest in set(_digests(text, min_length)):
                        if digest is not None:
                            entry = found.setdefault(digest, [0, i])
                            entry[0] += 1
                            entry[1] = max(entry[1], i)
                if not found:
                    continue
                blob = np.empty(len(found), dtype=_ENTRY)
                hashes = np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2)
                blob["at"], blob["print"] = hashes[:, 0], hashes[:, 1]
                blob["n"], blob["last"] = np.array(list(found.values()), dtype=np.int64).T
                shard = (blob["at"] % np.uint64(n_shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                blob, shard = blob[order], shard[order]
                cuts = np.flatnonzero(np.diff(shard)) + 1
                parts = np.split(blob, cuts)
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array(shard[np.concatenate([[0], cuts])], pa.int32()),
                     "chunk": pa.array([chunk] * len(parts), pa.int64()),
                     "entries": pa.array([p.tobytes() for p in parts], pa.binary())}
                )

    return run


def _entries(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, _ENTRY), *(np.frombuffer(x, _ENTRY) for x in table["entries"].to_pylist())])


_INDEX = "shard int, sizes binary, words binary, ranks binary, prints binary, counts binary, lasts binary"


def _build():
    """A shard's index: a perfect hash over its distinct keys; print, documents and largest id of each."""

    def run(table: pa.Table) -> pa.Table:
        blob = _entries(table)
        order = np.lexsort((blob["print"], blob["at"]))
        blob = blob[order]
        new = np.ones(len(blob), dtype=bool)
        new[1:] = (blob["at"][1:] != blob["at"][:-1]) | (blob["print"][1:] != blob["print"][:-1])
        first = np.flatnonzero(new)
        counts = np.add.reduceat(blob["n"].astype(np.int64), first)
        lasts = np.maximum.reduceat(blob["last"], first)
        keys = blob[first]
        hashed = PerfectHash.build(keys)
        slot = hashed(keys)
        prints, n, last = (np.empty(len(keys), t) for t in ("<u8", "<u4", "<i8"))
        prints[slot], n[slot], last[slot] = keys["print"], np.minimum(counts, 0xFFFFFFFF), lasts
        arrays = (hashed.sizes, hashed.words, hashed.ranks, prints, n, last)
        names = [x.split()[0] for x in _INDEX.split(", ")][1:]
        return pa.table(
            {"shard": table["shard"].slice(0, 1)} | {k: pa.array([a.tobytes()], pa.binary()) for k, a in zip(names, arrays, strict=True)}
        )

    return run


def _probe(min_documents: int):
    """Answers for every chunk: the hashes of its lines that enough documents have, with the largest id."""

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        chunks, answers = [], []
        if index.num_rows:
            row = index.to_pylist()[0]
            hashed = PerfectHash(*(np.frombuffer(row[k], t) for k, t in (("sizes", "<i8"), ("words", "<u8"), ("ranks", "<u4"))))
            prints, n, last = (np.frombuffer(row[k], t) for k, t in (("prints", "<u8"), ("counts", "<u4"), ("lasts", "<i8")))
            for chunk, entries in zip(asked["chunk"].to_pylist(), asked["entries"].to_pylist(), strict=True):
                blob = np.frombuffer(entries, _ENTRY)
                slot = hashed(blob)
                hit = slot >= 0
                hit[hit] = (prints[slot[hit]] == blob["print"][hit]) & (n[slot[hit]] >= min_documents)
                if hit.any():
                    own = blob[hit]
                    own["last"] = last[slot[hit]]
                    chunks.append(chunk)
                    answers.append(own.tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "answer": pa.array(answers, pa.binary())})

    return run


def _finish(names: list[str], text: str, min_length: int):
    """The documents of a chunk without the lines that its answers condemn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch["payload"].to_pylist(), batch["answers"].to_pylist(), strict=True):
                rows = unpack_rows(payload)
                keep_in: dict[bytes, int] = {}
                for answer in answers or ():
                    blob = np.frombuffer(answer, _ENTRY)
                    hashes = np.stack([blob["at"], blob["print"]], axis=1).astype("<u8").tobytes()
                    keep_in.update((hashes[16 * i : 16 * i + 16], x) for i, x in enumerate(blob["last"].tolist()))
                texts, n_lines, n_dropped = [], [], []
                for i, whole in zip(_ids(rows), rows.column("text").to_pylist(), strict=True):
                    lines = (whole or "").split("\n")
                    n_lines.append(len(lines))
                    if keep_in:
                        digests = _digests(whole, min_length)
                        kept = [x for x, d in zip(lines, digests, strict=True) if d is None or keep_in.get(d, i) == i]
                    else:
                        kept = lines
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(whole if len(kept) == len(lines) else "\n".join(kept))
                out = {f"c{k}": rows.column(f"c{k}") for k in range(len(names)) if names[k] != text}
                at = [pa.array(texts, pa.string()) if c == text else out[f"c{k}"] for k, c in enumerate(names)]
                table = pa.table([*at, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[f"o{k}" for k in range(len(names) + 2)])
                yield from table.combine_chunks().to_batches()

    return run


def drop_repeated_lines(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``df`` with repeated lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least
    ``min_length`` code points that at least ``min_documents`` rows hold loses all its lines except those
    in the row with the largest ``id``. Other lines stay as they are, joined by line ends.

    Every chunk of documents sends its distinct line hashes to shards. A shard builds a minimal perfect
    hash over its distinct hashes, which indexes arrays of fingerprints (64 bits beside the 64 that find
    the place), document counts and largest ids. The chunks' blobs probe the arrays of their shard and the
    answers go back to the chunks; lines themselves are never joined or moved.

    A null or empty text is one empty line and stays null or empty. A null id counts as the smallest.
    Rows with equal ids are rows of their own; if they share the largest id of a line, each keeps it.
    Columns already called ``n_lines`` or ``n_dropped`` are replaced. An empty table stays empty.
    """
    df = df.drop("n_lines", "n_dropped")
    names = df.columns
    packed = pack_chunks(
        df.select(
            F.col(f"`{id}`").cast("long").alias("id"),
            F.col(f"`{text}`").cast("string").alias("text"),
            *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != text],
        )
    )
    sent = stored(
        packed.mapInArrow(_send(shard_count(packed), min_length), "shard int, chunk long, entries binary"), "lines"
    )
    index = sent.groupBy("shard").applyInArrow(_build(), _INDEX)
    answers = (
        sent.groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInArrow(_probe(min_documents), "chunk long, answer binary")
        .groupBy("chunk")
        .agg(F.collect_list("answer").alias("answers"))
    )
    schema = ", ".join(f"o{k} {df.schema[c].dataType.simpleString() if c != text else 'string'}" for k, c in enumerate(names))
    done = (
        packed.select("chunk", "payload")
        .join(answers, "chunk", "left")
        .select("payload", "answers")
        .mapInArrow(_finish(names, text, min_length), f"{schema}, o{len(names)} long, o{len(names) + 1} long")
    )
    return done.toDF(*names, "n_lines", "n_dropped")
