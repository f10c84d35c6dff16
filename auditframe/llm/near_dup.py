"""MinHash near-dedup by an inverted join on signature coordinates, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm import words as W
from auditframe.llm.common import fresh, stored
from auditframe.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
#: Coordinates that two documents must share. At similarity 0.8 they share 51 on average with a deviation of
#: 3.2, so a link is missed with a chance of about 3 in a million.
MATCHES = 36
#: Two documents that share ``MATCHES`` coordinates share one of these many rarest ones.
PREFIX = COORDINATES - MATCHES + 1
#: Coordinates that must agree in two bits each, of 54 expected at similarity 0.8 with a deviation of 2.9.
BIT_MATCHES = 38
SKETCH_CELLS = 1 << 20
#: Hubs that a class is compared with before components are formed; the others, lists of two included, wait for them.
HUBS = 2
#: Documents of one side that a task compares at a time, and those of a list's largest component on the other side.
BLOCK, MAIN_BLOCK = 512, 16_384
#: Keys that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
_SEEDS = W.mix(np.arange(COORDINATES, dtype=np.uint64), 211) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles: A-Z lower-cased, words between white space.

    A text with fewer than ``k`` words has one shingle of them all, one without words none.
    """
    data, offsets = W.as_bytes(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words = W.hash_words(low, offsets, W.NOT_SPACE)
    hashes, whole = W.shingles(words, k)
    counts = np.diff(words.begins)
    out = []
    for row, (begin, n) in enumerate(zip(words.begins[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= k:
            out.append(np.unique(hashes[begin : begin + n - k + 1]))
        elif n:
            own = W.Words(words.hashes[begin : begin + n], np.zeros(n, np.int64), np.array([0, n]))
            out.append(W.shingles(own, n)[0])
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash coordinates, 32 bits each, of non-empty sets."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    begins = np.cumsum([0, *(len(s) for s in sets[:-1])]) if sets else np.empty(0, np.int64)
    out = np.empty((len(sets), COORDINATES), dtype="<u4")
    for j, seed in enumerate(_SEEDS):
        if sets:
            out[:, j] = np.minimum.reduceat(((flat * seed) >> np.uint64(32)).astype(np.uint32), begins)
    return out


def _tokens(signature: np.ndarray) -> np.ndarray:
    """One 64-bit token per coordinate and value."""
    return W.mix(signature.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)), 5)


def _bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, as two 64-bit numbers."""
    mixed = W.mix(signature.astype(np.uint64), 9)
    places = np.arange(COORDINATES, dtype=np.uint64)
    return np.stack([(((mixed >> np.uint64(b)) & np.uint64(1)) << places).sum(axis=1, dtype=np.uint64) for b in (0, 1)], axis=1)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in W.slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), k)
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in some])
                digests, blobs = [None] * len(sets), [None] * len(sets)
                for i, row in zip(some, sig, strict=True):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    blobs[i] = row.tobytes()
                rids = (part << 40) + np.arange(seen, seen + len(sets))
                seen += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids), piece.column("id"), piece.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())],
                    ["rid", "id", "text_hash", "n", "digest", "sig"],
                )

    return run


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many classes have a token in each cell of the sketch, added up in each task."""
    counts = np.zeros(SKETCH_CELLS, dtype=np.int64)
    for batch in batches:
        blobs = batch.column("sig").to_pylist()
        if blobs:
            sig = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, COORDINATES)
            counts += np.bincount((_tokens(sig).ravel() % np.uint64(SKETCH_CELLS)).astype(np.int64), minlength=SKETCH_CELLS)
    cells = np.flatnonzero(counts)
    for lo in range(0, len(cells), 1 << 16):
        at = cells[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["cell", "n"])


def _post(sketch):
    """Postings of each document under its rarest tokens, with its bits and how common its tokens are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sketch.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
                tokens, bits = _tokens(sig), _bits(sig).view(np.int64)
                held = common[(tokens % np.uint64(SKETCH_CELLS)).astype(np.int64)]
                # One order of tokens for all documents: by count, then by value.
                order = np.lexsort((tokens, held), axis=1)[:, :PREFIX]
                prefix = np.take_along_axis(tokens, order, axis=1).view(np.int64)
                weight = np.log2(held + 1.0).sum(axis=1)
                rids = np.asarray(part.column("rid"))
                wide = lambda x: pa.array(np.repeat(x, PREFIX))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.ravel()), wide(rids), wide(bits[:, 0]), wide(bits[:, 1]), wide(weight)],
                    ["token", "rid", "lo", "hi", "weight"],
                )

    return run


def _agree(a: str, b: str) -> Column:
    """Coordinates whose two bits agree."""
    differ = F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")).bitwiseOR(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi")))
    return 64 - F.bit_count(differ)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int(np.count_nonzero(large[at] == small))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirmed(a: str, b: str, percent: int) -> Column:
    """The link condition on two full sets, inside the JVM: pairs of long documents never wait in a batch."""
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (F.size(a) + F.size(b) - shared)


_LARGEST = (1 << 63) - 1


class _Forest:
    """Union-find over row numbers; ``edges`` are those that joined two trees."""

    def __init__(self, groups: np.ndarray) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(g, i) for i, g in enumerate(groups.tolist())]
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[a] = b
            self.edges.append((i, j))


def _bit_matches(lo, hi, i, j):
    return 64 - np.bitwise_count((lo[i] ^ lo[j]) | (hi[i] ^ hi[j]))


def _contested(table: pa.Table) -> pa.Table:
    """Of the lists in a bucket: enough pairs of different components, and similar bits, to span all such pairs."""
    table = table.sort_by([("token", "ascending"), ("rid", "ascending"), ("side", "ascending")])
    token, rid, label, lo, hi, side = (np.asarray(table[c]) for c in ("token", "rid", "label", "lo", "hi", "side"))
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    out: set[tuple[int, int]] = set()
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    for a, b in zip(begins, [*begins[1:], len(token)], strict=True):
        rows = np.arange(a, b)
        left, right = rows[side[a:b] != 2], rows[side[a:b] != 1]
        values, counts = np.unique(label[rows], return_counts=True)
        if len(values) < 2:
            continue
        most = values[np.argmax(counts)]
        forest = _Forest(rid[rows])
        # Pairs within the largest component are not asked for: at least one end is outside it.
        for these, those in ((left, right), (right, left)):
            for i in these[label[these] != most].tolist():
                near = those[(_bit_matches(lo, hi, i, those) >= BIT_MATCHES) & (label[those] != label[i])]
                for j in near.tolist():
                    forest.join(i - a, j - a)
        # Each tree as links to its smallest class, so that lists with the same members give the same links.
        least: dict[int, int] = {}
        joined = {i for edge in forest.edges for i in edge}
        for i in joined:
            root = forest.root(i)
            least[root] = min(least.get(root, _LARGEST), int(rid[a + i]))
        out.update((int(rid[a + i]), least[forest.root(i)]) for i in joined if int(rid[a + i]) != least[forest.root(i)])
    pairs = sorted(out)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _settle(percent: int):
    """In a block pair of one cluster: confirmed links between components, enough to span them."""

    def run(table: pa.Table) -> pa.Table:
        rid, label, lo, hi, side = (np.asarray(table[c]) for c in ("rid", "label", "lo", "hi", "side"))
        lo, hi = lo.view(np.uint64), hi.view(np.uint64)
        items = table["items"].combine_chunks()
        flat, ends = np.asarray(items.flatten()).view(np.uint64), np.asarray(items.offsets) - items.offsets[0].as_py()
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        forest = _Forest(label)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        for i in left.tolist():
            near = right[(_bit_matches(lo, hi, i, right) >= BIT_MATCHES) & (label[right] != label[i])]
            for j in near.tolist():
                if forest.root(i) != forest.root(j) and _linked(sets[i], sets[j], percent):
                    forest.join(i, j)
        return pa.table(
            {c: pa.array([int(rid[e[k]]) for e in forest.edges], pa.int64()) for k, c in enumerate(("a", "b"))}
        )

    return run


def _keyed(df: DataFrame) -> DataFrame:
    """A side to join by key: broadcast if its rows are counted and few."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _ends(pairs: DataFrame) -> DataFrame:
    """(rid) of both sides, each once."""
    return pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()


class NearDuplicates:
    """Near-duplicate classes of the rows of ``df``; see ``near_duplicates``."""

    def __init__(self, df: DataFrame, id: str, text: str, shingle: int, percent: int) -> None:
        self.percent, self.shingle = percent, shingle
        self.texts = df.select(
            F.col(f"`{id}`").cast("long").alias("id"),
            F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"),
            F.col(f"`{text}`").cast("string").alias("text"),
        )
        self.rows = stored(
            self.texts.mapInArrow(_sign(shingle), "rid long, id long, text_hash long, n long, digest binary, sig binary"),
            "signatures",
        )
        # Equal sets are one class; its smallest row stands for it.
        self.classes = stored(
            self.rows.filter("n > 0").groupBy("digest", "n").agg(F.min("rid").alias("rid"), F.min_by("sig", "rid").alias("sig")),
            "classes",
        )
        edges = self._stars()
        labels = components(edges)
        more = self._rest(labels)
        if not more.isEmpty():
            # The further links join whole components: components of the graph of components.
            own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
            between = (
                more.join(own("a"), "a", "left")
                .join(own("b"), "b", "left")
                .select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
            )
            joined = components(between)
            labels = (
                labels.join(joined.toDF("label", "top"), "label", "full")
                .select(F.coalesce("node", "label").alias("node"), F.coalesce("top", "label").alias("label"))
            )
        self.labels = labels

    def _sets(self, rids: DataFrame) -> DataFrame:
        """(rid, items): full shingle sets of these rows, made from their whole texts."""
        wanted = self.rows.join(_keyed(stored(rids, "wanted")), "rid", "left_semi")
        keys = stored(
            wanted.groupBy("id", "text_hash").agg(F.collect_set("rid").alias("rids")).withColumnsRenamed({"id": "i", "text_hash": "h"}),
            "keys",
        )
        found = self.texts.join(_keyed(keys), F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
        k = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in W.slices(batch, "text"):
                    sets = [s.view(np.int64) for s in shingle_sets(piece.column("text"), k)]
                    rids = piece.column("rids").to_pylist()
                    flat = [(r, s) for own, s in zip(rids, sets, strict=True) for r in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r for r, _ in flat], pa.int64()), pa.array([s for _, s in flat], pa.list_(pa.int64()))],
                        ["rid", "items"],
                    )

        # Rows that repeat an id and text are alike; one of them is enough.
        once = found.select("i", "h", "rids", "text").dropDuplicates(["i", "h"])
        return stored(once.select("rids", "text").mapInArrow(run, "rid long, items array<bigint>"), "sets")

    def _stars(self) -> DataFrame:
        """Confirmed links between every document of a list and the list's most connected one."""
        spark = self.rows.sparkSession
        counted = self.classes.select("sig").mapInArrow(_count_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        cells = counted.toArrow()  # at most SKETCH_CELLS rows
        sketch = np.zeros(SKETCH_CELLS, dtype=np.int64)
        sketch[np.asarray(cells["cell"])] = np.asarray(cells["n"])
        postings = self.classes.select("rid", "sig").mapInArrow(
            _post(spark.sparkContext.broadcast(sketch)), "token long, rid long, lo long, hi long, weight double"
        )
        postings = stored(postings, "postings")
        hub = F.max(F.struct("weight", "rid", "lo", "hi")).alias("hub")
        lists = postings.groupBy("token").agg(hub, F.count("*").alias("size")).filter("size > 1")
        self.shared = stored(
            postings.drop("weight")
            .join(lists, "token")
            .select("token", "rid", "lo", "hi", "size", F.col("hub.weight").alias("hub"), F.col("hub.rid").alias("b"), F.col("hub.lo").alias("blo"), F.col("hub.hi").alias("bhi")),
            "lists",
        )
        # Of the hubs whose bits agree with a class, the best connected ones; the others are left to _rest.
        best = F.slice(F.sort_array(F.collect_set(F.struct("hub", "b")), asc=False), 1, HUBS)
        self.pairs = stored(
            self.shared.filter(F.col("rid") != F.col("b"))
            .filter(_agree("", "b") >= BIT_MATCHES)
            .groupBy(F.col("rid").alias("a"))
            .agg(best.alias("best"))
            .select("a", F.explode("best.b").alias("b")),
            "pairs",
        )
        return self._confirm(self.pairs, self._sets(_ends(self.pairs)))

    def _confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return stored(both.filter(_confirmed("set_a", "set_b", self.percent)).select("a", "b"), "links")

    def _cut(self, known: DataFrame) -> DataFrame:
        """Pairs of lists of two, of different components and with similar bits, that _stars left out."""
        twos = self.shared.filter("size = 2").filter(F.col("rid") != F.col("b")).filter(_agree("", "b") >= BIT_MATCHES)
        twos = twos.select(F.col("rid").alias("a"), "b").distinct().join(self.pairs, ["a", "b"], "left_anti")
        own = lambda c: known.select(F.col("rid").alias(c), F.col("label").alias(f"label_{c}"))
        named = twos.join(own("a"), "a", "left").join(own("b"), "b", "left")
        return stored(named.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"), "cut")

    def _rest(self, labels: DataFrame) -> DataFrame:
        """Confirmed links between components that no hub has found, enough to span them.

        The pair of a list of two is confirmed by itself if it was not among the best hubs. In longer lists,
        pairs of different components with similar bits make clusters, and in each cluster the documents outside its largest component are
        compared with all others, block by block. Every pair of a list is looked at; the number of rows that
        leave a task is that of its documents at most.
        """
        known = labels.withColumnRenamed("node", "rid")
        cut = self._cut(known)
        long = (
            self.shared.filter("size > 2").select("token", "rid", "lo", "hi", "size")
            .join(known, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        )
        long = stored(long, "long")
        # Of each list, its largest component against the rest, and the rest among itself. Where the rest fits in a block,
        # as nearly everywhere, every row is dealt once.
        # as nearly everywhere, every row is dealt once. Lists with the same members, as the words of a passage make them, ask
        # for the same pairs: one of them is enough. Members are told by their number and 128 bits of all their hashes.
        both = lambda c: (F.bit_xor(c("one")).alias("one"), F.bit_xor(c("two")).alias("two"))
        counts = long.groupBy("token", "label").agg(F.count("*").alias("n"), *both(lambda c: F.xxhash64("rid", F.lit(c))))
        lists = counts.groupBy("token").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), *both(F.col))
        lists = lists.filter(F.col("main.n") < F.col("n")).groupBy("n", "one", "two").agg(F.min("token").alias("token"), F.first("main").alias("main"))
        lists = lists.select(
            "token", F.col("main.label").alias("main"),
            F.ceil(F.col("main.n") / MAIN_BLOCK).cast("int").alias("inside"),
            F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("outside"),
            (F.col("main.n") * F.ceil((F.col("n") - F.col("main.n")) / BLOCK)).alias("copies"),
        )
        lists = stored(lists, "open")
        n_buckets = max(
            int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            (lists.agg(F.sum("copies")).first()[0] or 0) // 200_000 + 1,
        )
        mixed = stored(long.drop("size").join(lists.drop("copies"), "token"), "mixed")
        block = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        pair = lambda kind, a, b: F.xxhash64("token", F.lit(kind), a, b)
        mains = mixed.filter("label = main").withColumn("o", each("outside")).withColumns(
            {"key": pair("main", F.col("o"), block("inside")), "side": F.lit(2)}
        )
        outs = mixed.filter("label <> main").withColumn("o", block("outside"))
        against = outs.withColumn("x", each("inside")).withColumns({"key": pair("main", F.col("o"), F.col("x")), "side": F.lit(1)})
        among = outs.withColumn("x", each("outside")).withColumns(
            {
                "key": pair("rest", F.least("o", "x"), F.greatest("o", "x")),
                "side": F.when(F.col("o") == F.col("x"), 0).when(F.col("o") < F.col("x"), 1).otherwise(2),
            }
        )
        columns = ["key", "rid", "label", "lo", "hi", "side"]
        dealt = mains.select(*columns).union(against.select(*columns)).union(among.select(*columns))
        dealt = dealt.withColumnRenamed("key", "token").withColumn("bucket", F.pmod("token", F.lit(n_buckets)))
        near = stored(dealt.groupBy("bucket").applyInArrow(_contested, "a long, b long").distinct(), "contested")
        if near.isEmpty():
            return near if cut.isEmpty() else self._confirm(cut, self._sets(_ends(cut)))
        members = components(near).toDF("rid", "cluster")
        facts = long.groupBy("rid").agg(F.first("label").alias("label"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        docs = stored(members.join(facts, "rid"), "members")
        sizes = docs.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        clusters = sizes.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
        clusters = clusters.select(
            "cluster", F.col("main.label").alias("main"),
            F.ceil(F.col("main.n") / BLOCK).cast("int").alias("inside"),
            F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int")).alias("outside"),
        )
        placed = docs.join(clusters, "cluster").withColumn("is_main", F.col("label") == F.col("main"))
        mains = placed.filter("is_main").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outside") - 1))).withColumns(
            {"i": F.concat_ws("/", F.col("o").cast("string"), F.lit("m"), block("inside").cast("string")), "side": F.lit(2)}
        )
        outs = placed.filter("NOT is_main").withColumn("o", block("outside"))
        against = outs.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("inside") - 1))).withColumns(
            {"i": F.concat_ws("/", F.col("o").cast("string"), F.lit("m"), F.col("x").cast("string")), "side": F.lit(1)}
        )
        among = outs.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("outside") - 1))).withColumns(
            {
                "i": F.concat_ws("/", F.least("o", "x").cast("string"), F.lit("o"), F.greatest("o", "x").cast("string")),
                "side": F.when(F.col("o") == F.col("x"), 0).when(F.col("o") < F.col("x"), 1).otherwise(2),
            }
        )
        columns = ["cluster", "i", "rid", "label", "lo", "hi", "side"]
        every = mains.select(*columns).union(against.select(*columns)).union(among.select(*columns))
        sets = self._sets(docs.select("rid").union(_ends(cut)).distinct())
        settled = stored(
            every.join(sets, "rid").groupBy("cluster", "i").applyInArrow(_settle(self.percent), "a long, b long"), "links"
        )
        return settled if cut.isEmpty() else settled.union(self._confirm(cut, sets))

    def result(self) -> DataFrame:
        """(id, text_hash, rid, n, component_id, keeper) per row."""
        least = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))).alias("least")
        heads = self.rows.filter("n > 0").groupBy("digest", "n").agg(least)
        labelled = (
            self.classes.select("digest", "n", "rid")
            .join(self.labels.withColumnRenamed("node", "rid"), "rid", "left")
            .select("digest", "n", F.coalesce("label", "rid").alias("label"))
            .join(heads, ["digest", "n"])
        )
        best = labelled.groupBy("label").agg(F.min("least").alias("best"))
        named = labelled.join(best, "label").select(
            F.col("digest"), F.col("best.id").alias("component_id"), F.col("best.rid").alias("keeper")
        )
        rows = self.rows.select("id", "text_hash", "rid", "n", "digest").join(named, "digest", "left")
        return rows.select(
            "id", "text_hash", "rid", "n",
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            F.coalesce("keeper", "rid").alias("keeper"),
        )


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``df``: id, text_hash, n_shingles, component_id, kept.

    Words stand between white space, A-Z lower-cased. Texts whose sets of distinct shingles have a Jaccard
    similarity of at least ``similarity`` (compared in whole percents) are linked; ``component_id`` is the
    smallest id that links lead to, and one row of each component is ``kept``: the one with that id.

    Equal sets are one class. A class is posted under its ``PREFIX`` rarest coordinate-value pairs (counts
    come from a sketch of fixed size over all classes; any common order would do). In each list the most
    connected class is the hub; two bits per coordinate estimate the matches of each class with the hub, and
    pairs above the threshold are confirmed on full sets. Components of these links are then compared with
    each other wherever they share a list, so no hub has to be near everything in its list.

    A text without words has an empty set, is linked with nothing and kept. A null id counts as larger than
    all others; of rows with equal ids in one component one is kept. Other columns stay behind; ``text_hash``
    (xxhash64 of the text, null for null) tells rows with equal ids apart. An empty table gives no rows.
    """
    found = NearDuplicates(df, id, text, shingle, round(100 * similarity)).result()
    return found.select(
        F.col("id").alias(id), "text_hash", F.col("n").alias("n_shingles"), "component_id", (F.col("rid") == F.col("keeper")).alias("kept")
    )


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, columns and all, without near-duplicates: of each component one row stays."""
    i, h, n, gone, copies = fresh(df, "i", "h", "n", "gone", "copies")
    judged = near_duplicates(df, id, text, **options).toDF(i, h, n, "component_id", "kept")
    # Rows with equal id and text are alike; where some are not kept, as many must go.
    alike = judged.groupBy(i, h).agg(F.count("*").alias(copies), F.sum(F.col("kept").cast("int")).alias(n))
    going = stored(alike.filter(F.col(n) < F.col(copies)), "going")
    same = F.col(f"`{id}`").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(h))
    whole = df.join(_keyed(going.filter(F.col(n) == 0).select(i, h)), same, "left_anti")
    some = going.filter(F.col(n) > 0).select(i, h)
    if some.isEmpty():
        return whole
    again = _keyed(some)
    first = whole.join(again, same, "left_semi")
    keys = [F.col(f"`{id}`"), F.xxhash64(F.col(f"`{text}`").cast("string"))]
    one = first.groupBy(*[k.alias(a) for k, a in zip(keys, (i, h), strict=True)]).agg(
        *[F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(gone)]
    )
    return whole.join(again, same, "left_anti").union(one.select(f"{gone}.*"))
