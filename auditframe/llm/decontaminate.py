"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact shingle similarity."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auditframe.llm import words as W
from auditframe.llm.common import fresh, stored

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
BLOCKS = 16
#: Differing bits within which every fingerprint is found. Windows at similarity 0.8 differ in 19 bits on
#: average with a deviation of 4, unrelated ones in 64 with a deviation of 6.
RADIUS = 40
#: Items that the driver and a task hold at a time; a larger benchmark is searched in several passes, one after the other.
ITEMS_PER_PASS = 20_000


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint (``BITS`` booleans) of a multiset of shingle hashes: each bit is the sign of its votes."""
    halves = [W.mix(hashes, 101 + i).astype("<u8") for i in range(BITS // 64)]
    bits = np.unpackbits(np.stack(halves, axis=1).view(np.uint8), axis=1, bitorder="little")
    return 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)


def _block_values(bits: np.ndarray) -> list[int]:
    return np.packbits(bits.reshape(BLOCKS, -1), axis=1, bitorder="little")[:, 0].tolist()


_WIDTH = BITS // BLOCKS
_MASKS = [
    sum(1 << b for b in flips) for n in range(RADIUS // BLOCKS + 1) for flips in itertools.combinations(range(_WIDTH), n)
]


@dataclass
class ItemIndex:
    """Benchmark items by size, by shingle, and by the blocks of their fingerprints.

    Two fingerprints within ``RADIUS`` agree in some block but for ``RADIUS // BLOCKS`` bits, so asking each
    block for all values that close finds every item within the radius.
    """

    ids: list = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # words
    sets: list[Counter] = field(default_factory=list)
    prints: list[np.ndarray] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=lambda: [defaultdict(list) for _ in range(BLOCKS)])
    #: (words a shingle, item size) -> sorted shingle hashes of those items
    known: dict = field(default_factory=dict)

    def fill(self, items: list[tuple], k: int) -> ItemIndex:
        texts = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
        found = W.hash_words(*W.as_bytes(texts))
        by_group = defaultdict(set)
        for n, (item, _) in enumerate(items):
            lo, hi = int(found.begins[n]), int(found.begins[n + 1])
            if lo == hi:
                continue
            own = W.Words(found.hashes[lo:hi], np.zeros(hi - lo, np.int64), np.array([0, hi - lo]))
            width = min(k, hi - lo)
            hashes, _ = W.shingles(own, width)
            self.ids.append(item)
            self.sizes.append(hi - lo)
            self.sets.append(Counter(hashes.tolist()))
            self.prints.append(simhash(hashes))
            for block, value in zip(self.blocks, _block_values(self.prints[-1]), strict=True):
                block[value].append(len(self.ids) - 1)
            by_group[width, hi - lo].update(hashes.tolist())
        self.known = {g: np.array(sorted(s), dtype=np.uint64) for g, s in sorted(by_group.items())}
        return self

    def near(self, print_: np.ndarray) -> list[int]:
        asked: set[int] = set()
        for block, value in zip(self.blocks, _block_values(print_), strict=True):
            for mask in _MASKS:
                asked.update(block.get(value ^ mask, ()))
        return [i for i in sorted(asked) if np.count_nonzero(self.prints[i] != print_) <= RADIUS]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight; a shingle weighs as often as it occurs."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def _least_shared(n: int, m: int, similarity: float) -> int:
    """Shared weight that two multisets of sizes n and m need."""
    return int(np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))


def _starts(at: np.ndarray, n: int, need: int) -> np.ndarray:
    """Starts of windows of ``n`` places that hold at least ``need`` of the sorted places ``at``."""
    if len(at) < need:
        return np.empty(0, np.int64)
    first, last = at[: len(at) - need + 1], at[need - 1 :]
    ok = last - first < n
    lows, highs = last[ok] - n + 1, first[ok]
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lows, highs, strict=True)] or [np.empty(0, np.int64)]))


class _Finder:
    def __init__(self, index: ItemIndex, similarity: float) -> None:
        self.index, self.similarity = index, similarity
        self.widths = sorted({width for width, _ in index.known})
        # One look in a small table rules out nearly all shingles that no item has.
        self.maybe = {}
        for width in self.widths:
            table = np.zeros(1 << 20, dtype=bool)
            for (w, _), known in index.known.items():
                if w == width:
                    table[(known >> np.uint64(44)).astype(np.int64)] = True
            self.maybe[width] = table

    def __call__(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text its best window per item: (item, first word, words, similarity)."""
        out: list[dict] = [{} for _ in range(len(texts))]
        words = W.hash_words(*W.as_bytes(pc.utf8_lower(texts)))
        for width in self.widths:
            hashes, whole = W.shingles(words, width)
            sieve = np.flatnonzero(self.maybe[width][(hashes >> np.uint64(44)).astype(np.int64)] & whole)
            if not len(sieve):
                continue
            values = hashes[sieve]
            for (w, size), known in self.index.known.items():
                if w != width:
                    continue
                at = sieve[known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values]
                for row in np.unique(words.row[at]).tolist():
                    begin, end = int(words.begins[row]), int(words.begins[row + 1])
                    # A window has the item's size, or is the whole text if that is shorter. One that shares
                    # too few places with all items of its size cannot reach the similarity.
                    n = min(size, end - begin) - width + 1
                    need = max(1, _least_shared(n, size - width + 1, self.similarity))
                    own = at[(words.row[at] == row)]
                    for start in _starts(own, n, need).tolist():
                        if begin <= start and start + n + width - 1 <= end:
                            self._judge(hashes[start : start + n], start - begin, n + width - 1, size, out[row])
        return [[(i, *m) for i, m in sorted(found.items())] for found in out]

    def _judge(self, window: np.ndarray, start: int, n_words: int, size: int, found: dict) -> None:
        own = None
        for i in self.index.near(simhash(window)):
            if self.index.sizes[i] == size:
                own = own or Counter(window.tolist())
                score = weighted_similarity(own, self.index.sets[i])
                if score >= self.similarity - 1e-12:
                    item = self.index.ids[i]
                    if item not in found or score > found[item][2]:
                        found[item] = (start, n_words, score)


def _search(index, similarity: float, text: str, carried: list[str], id_type: pa.DataType, only_found: bool = False):
    match = pa.list_(pa.struct([("item_id", id_type), ("start", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(index.value, similarity)
        for batch in batches:
            for piece in W.slices(batch, text):
                found = [
                    [dict(zip(("item_id", "start", "words", "similarity"), m, strict=True)) for m in row]
                    for row in find(piece.column(text))
                ]
                out = pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), pa.array(found, match)], [*carried, "__matches"])
                yield out.filter(pa.array([bool(f) for f in found])) if only_found else out

    return run


def find_matches(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``df`` (all, unless given) and ``matches``: the benchmark items each text holds.

    A match is (item_id, start, words, similarity): the most similar window of the item's size in words, the
    first of several. Similarity is that of multisets of ``shingle`` words in lower case; items with fewer
    words count as one shingle. Windows get a SimHash; blocks of its bits find all items within ``RADIUS``,
    and these are compared exactly. Windows that share fewer places with the items of their size than the
    similarity needs are not hashed, which loses none. A text shorter than an item is one window.

    The benchmark is searched in blocks of at most ``ITEMS_PER_PASS`` items, each in a pass of its own: a block's index is
    built, sent out and dropped again before the next one, so the driver and a task hold one at a time. With several
    blocks the texts are stored with a number first; a pass reads them and stores only the numbers and matches of texts that
    hold something, and these are joined in the end. With one block no text moves between tasks.

    Null or empty texts and items match nothing; items with equal ids count as one; ids may be of any atomic type (others
    are compared as text). Repeated rows are judged each. A column already called ``matches`` is replaced. Empty tables
    give no matches.
    """
    spark = df.sparkSession
    df = df.drop("matches")
    carry = [c for c in (carry if carry is not None else df.columns)]
    kind = benchmark.select(F.col(f"`{item_id}`")).schema[0].dataType
    own = F.col(f"`{item_id}`").cast("string") if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else F.col(f"`{item_id}`")
    items = benchmark.select(own.alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    id_type, id_sql = to_arrow_type(items.schema["i"].dataType), items.schema["i"].dataType.simpleString()
    matches_sql = f"array<struct<item_id:{id_sql},start:bigint,words:bigint,similarity:double>>"
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    # Names of our own, so that any column may be called anything.
    names = [f"c{n}" for n in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    kinds = {n: f.dataType.simpleString() for n, f in zip(names, df.schema.fields, strict=True)}
    work = df.toDF(*names)
    kept = [at[c] for c in carry]

    def index_of(number: int):
        block = items.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == number).dropDuplicates(["i", "t"])
        return spark.sparkContext.broadcast(ItemIndex().fill(sorted(tuple(r) for r in block.collect()), shingle))

    if passes == 1:
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), f"__matches {matches_sql}"])
        found = work.mapInArrow(_search(index_of(0), similarity, at[text], kept, id_type), schema)
    else:
        work = stored(work.withColumn("__row", F.monotonically_increasing_id()), "texts")
        parts = []
        for number in range(passes):
            index = index_of(number)
            run = _search(index, similarity, at[text], ["__row"], id_type, only_found=True)
            parts.append(stored(work.select("__row", at[text]).mapInArrow(run, f"__row long, __matches {matches_sql}"), "matches"))
            index.destroy()
        hits = reduce(DataFrame.union, parts).groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("__matches"))).alias("__matches"))
        none = F.array().cast(matches_sql)
        found = work.join(hits, "__row", "left").withColumn("__matches", F.coalesce("__matches", none))
    return found.select(*kept, "__matches").toDF(*carry, "matches")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item, with the columns of ``df``."""
    (name,) = fresh(df, "matches")
    columns = [F.col(f"`{c}`").alias(f"{c}") for c in df.columns]
    if any(c == "matches" for c in df.columns):
        df = df.withColumnRenamed("matches", name)
    clean = find_matches(df, benchmark, **options).filter(F.size("matches") == 0).drop("matches")
    return clean.withColumnRenamed(name, "matches").select(*columns)
