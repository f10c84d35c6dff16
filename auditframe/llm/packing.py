"""Best-fit packing of documents into sequences, planned on a histogram of lengths."""

from __future__ import annotations

import json
import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.llm.common import stored
from auditframe.llm.words import slices

CAPACITY = 4096
END_ID = 1
#: Words, and parts of words, whose ids a process remembers in each of two generations. Workers keep them between stages.
REMEMBERED = 100_000
_LONGEST_REMEMBERED = 64


# Fixed value: the vocabulary's own rule for the parts of a word, each of which it encodes alone.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Remembered:
    """Two generations of a cache: what is asked for again survives when the young one is full."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def known(self, keys: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is remembered of the keys, and the keys that are not."""
        found, new = {}, []
        young, old = self.young, self.old
        for key in keys:
            ids = young.get(key)
            if ids is None:
                ids = old.get(key)
                if ids is None:
                    new.append(key)
                    continue
                young[key] = ids
            found[key] = ids
        return found, new

    def add(self, found: dict[str, bytes]) -> None:
        if len(self.young) + len(found) > REMEMBERED:
            self.old, self.young = self.young, {"": b""}
        self.young.update(found)


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    names = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    for b in range(256):
        names.setdefault(b, chr(256 + sum(x >= 256 for x in map(ord, names.values()))))
    return names


class WordIds:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit numbers.

    A vocabulary whose rules are those of ``_PARTS`` never looks across a space or a line end (white space is
    dropped, words end themselves), so a text's ids are those of its words in turn. It does not look across the
    parts of a word either: a printable Latin-1 word, which normalising only lower-cases, is put together from
    parts seen before. All other words are encoded whole, so that special tokens and composed letters come out
    right, and texts for other vocabularies are never split.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        rules = json.loads(own.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = steps[0].get("pattern") == {"Regex": _PARTS} and rules["post_processor"] is None
        self.encode = getattr(own, "encode_batch_fast", own.encode_batch)  # without places in the text
        self.model = own.model.tokenize
        self.names = _byte_names()
        self.words, self.parts = _Remembered(), _Remembered()
        self.split = regex.compile(_PARTS).findall

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _spell(self, part: str) -> bytes:
        spelled = part.encode().decode("latin-1").translate(self.names)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model(spelled)])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain, whole = {}, []
        marks = string.punctuation
        for w in words:
            if not (w.isprintable() and (w.isascii() or max(w) < "\u0100")) or "<|" in w:
                whole.append(w)
                continue
            low = w.lower()
            head = low.rstrip(marks)
            if not head.isalpha() and head:
                plain[w] = self.split(low)
            elif head == low:
                plain[w] = (low,)
            else:
                plain[w] = (head, low[len(head) :])
        parts, new = self.parts.known(set().union(*plain.values()))
        spelled = {p: self._spell(p) for p in new}
        self.parts.add({p: ids for p, ids in spelled.items() if len(p) <= _LONGEST_REMEMBERED})
        parts |= spelled
        out = {w: parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own]) for w, own in plain.items()}
        return out | dict(zip(whole, self._whole(whole), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Of some megabytes of texts at a time: their distinct words are looked up once."""
        if not self.by_word:
            return self._whole(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found, new = self.words.known(set().union(*split))
        learned = self._learn(new)
        self.words.add({w: ids for w, ids in learned.items() if len(w) <= _LONGEST_REMEMBERED})
        found |= learned
        return [b"".join([found[w] for w in own]) for own in split]


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this process, so that tasks after the first start with its words."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def _cut(path: str, capacity: int, end_id: int):
    schema = pa.schema(
        [("row", pa.int32()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_ids(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for docs in slices(batch, batch.schema.names[1]):
                rows: list[tuple] = []
                for row, ids in enumerate(encode([t or "" for t in docs.column(1).to_pylist()])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((row, piece, at // 4, n, own, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.column(0).take(columns[0]), *columns[1:]], [batch.schema.names[0], *schema.names[1:]]
                )

    return run


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Gives rows (length, first, count, sequence, per_sequence, offset): pieces of that length ranked from
    ``first`` fill sequences from ``sequence`` on, ``per_sequence`` in each, starting at ``offset``. Bins with
    equal room are one entry, so the work depends on the number of different lengths, not of pieces.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms that some open sequences have
    bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    fresh_sequence = 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((first, n))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            else:
                room, first, n = capacity, fresh_sequence, -(-left // (capacity // length))
                fresh_sequence += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - room))
                give(room - each * length, first, full)
                first, n, rank, left = first + full, n - full, rank + full * each, left - full * each
            if left and n:  # the rest fits into one sequence
                plan.append((length, rank, left, first, left, capacity - room))
                give(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            give(room, first, n)
    return plan


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``id``, piece, start, length, ids (binary, unsigned 32-bit little-endian), ids_crc32,
    sequence_id and offset.

    A document's ids are those of its text by the vocabulary file ``tokenizer``, then ``end_id``; only
    documents of more than ``capacity`` ids are cut. Pieces are counted by length; best fit over this
    histogram (at most ``capacity`` rows) plans the sequences; a piece takes the slot planned for its rank
    among pieces of its length. A task ranks its own pieces as it makes them and the tasks' counts are added
    up, so no length gathers in one place.

    A null or empty text is the single id ``end_id``. Null or repeated ids are packed row by row; other
    columns stay behind. An empty table gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    pieces = stored(
        df.select(F.col(id), F.col(text).cast("string").alias("text" if id != "text" else "text_")).mapInArrow(
            _cut(tokenizer, capacity, end_id),
            f"`{id}` {kind}, piece int, start long, length long, ids binary, ids_crc32 long, part int, local long",
        ),
        "pieces",
    )
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    slots = (
        spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "length long, first long, n long, seq long, each long, at long")
        .groupBy("length")
        .agg(F.collect_list(F.struct("first", "n", "seq", "each", "at")).alias("slots"))
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("local")

    def holds(s: Column) -> Column:
        return (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["n"])

    nth = F.col("rank") - F.col("slot.first")
    return (
        pieces.join(bases, ["length", "part"])
        .join(F.broadcast(slots), "length")  # at most one row per length
        .withColumn("rank", rank)
        .withColumn("slot", F.filter("slots", holds)[0])
        .select(
            id,
            "piece",
            "start",
            "length",
            "ids",
            "ids_crc32",
            (F.col("slot.seq") + F.floor(nth / F.col("slot.each"))).alias("sequence_id"),
            (F.col("slot.at") + nth % F.col("slot.each") * F.col("length")).alias("offset"),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids of all pieces in order."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return packed.groupBy("sequence_id").agg(pieces.alias("p")).select("sequence_id", total.alias("length"), joined.alias("ids"))
