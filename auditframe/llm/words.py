"""Words of many texts at once as 64-bit hashes, by array operations over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is worked on alone. Working arrays take up to fifty times that.
SLICE_BYTES = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent hashes."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 17)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    have = 1
    while have < n:  # doubling
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


@dataclass
class Words:
    """``hashes`` of all words in order, the ``row`` of each, and where each row's words begin.

    ``heads`` has, for each length in bytes asked for, the hashes of the beginnings of longer words and their rows.
    """

    hashes: np.ndarray
    row: np.ndarray
    begins: np.ndarray
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _table(chars: str | None) -> np.ndarray:
    """Which bytes belong to words: letters, digits, ``_`` and all non-ASCII; or all but ``chars``."""
    if chars is None:
        return np.array([chr(b).isalnum() or b == 95 or b >= 128 for b in range(256)])
    return np.array([b >= 128 or chr(b) not in chars for b in range(256)])


WORD_BYTES = _table(None)
NOT_SPACE = _table(" \t\n\x0b\x0c\r")


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and their offsets in it; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES, heads: tuple[int, ...] = ()) -> Words:
    """Runs of ``inside`` bytes within each text."""
    n_rows = len(offsets) - 1
    word = inside[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    ends_of_rows = offsets[1:] - 1
    after[ends_of_rows[ends_of_rows >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    shift = powers(_INVERSE, len(data) + 1)[starts]
    hashes = mix((sums[ends] - sums[starts]) * shift)
    begins = np.searchsorted(starts, offsets)
    found = Words(hashes, np.repeat(np.arange(n_rows), np.diff(begins)), begins)
    for n in heads:
        long = ends - starts > n
        cut = starts[long]
        found.heads[n] = (mix((sums[cut + n] - sums[cut]) * shift[long], n), found.row[long])
    return found


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they all lie in the word's row."""
    n = max(0, len(words.hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words.hashes[j : j + n]
    return mix(out, k), words.row[:n] == words.row[k - 1 : k - 1 + n]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``SLICE_BYTES`` of text, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
