"""Quality by hierarchical empirical Bayes: a document classifier's evidence and that of its host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm import words as W
from auditframe.llm.common import fresh, stored

#: Labelled rows that the document classifier is fitted on, at most; those with the smallest hash of their id.
FIT_ROWS = 20_000
HASH_BITS = 18
#: Sites that may be broadcast; more are joined by a shuffle.
BROADCAST_SITES = 500_000
_DENSE = 4096
FEATURES = (1 << HASH_BITS) + _DENSE
_EPOCHS = 300
_LEAST_ROWS, _LEAST_Z = 8, 5.0

_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_UPPER, _DIGIT, _SPACES = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BINS = np.array([1e-9, 0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text's binary features and where each text's begin.

    Hashed distinct words and their first four and five bytes, and bins of: the share of every punctuation mark, of capitals, digits and spaces,
    of words equal to the word before, of distinct words, the length of words and of the text.
    """
    n = len(texts)
    data, offsets = W.as_bytes(texts)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row_of * 256 + data, minlength=n * 256).reshape(n, 256)
    length = np.maximum(np.diff(offsets), 1)
    low = np.where(_UPPER[data], data + 32, data).astype(np.uint8)  # A-Z only; other letters keep their case
    found = W.hash_words(low, offsets, heads=(4, 5))
    n_words = np.diff(found.begins)
    some = np.maximum(n_words, 1)
    same = np.zeros(len(found.hashes), bool)
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (found.row[1:] == found.row[:-1])
    hashed = (found.hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    pairs = np.unique(found.row << HASH_BITS | hashed)
    distinct = np.bincount(pairs >> HASH_BITS, minlength=n)
    heads = [row << HASH_BITS | (h >> np.uint64(64 - HASH_BITS)).astype(np.int64) for h, row in found.heads.values()]
    pairs = np.unique(np.concatenate([pairs, *heads]))
    rows, ids = pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)

    shares = [counts[:, b] / length for b in _PUNCTUATION]
    shares += [counts[:, mask].sum(axis=1) / length for mask in (_UPPER, _DIGIT, _SPACES)]
    shares += [np.bincount(found.row, weights=same, minlength=n) / some, distinct / some]
    letters = length - counts[:, ~W.WORD_BYTES].sum(axis=1)
    shares += [letters / some / 40, np.log2(length) / 24]
    width = len(_BINS) + 1
    dense = np.stack([np.digitize(s, _BINS) + i * width for i, s in enumerate(shares)], axis=1) + (1 << HASH_BITS)
    rows = np.concatenate([rows, np.repeat(np.arange(n), dense.shape[1])])
    ids = np.concatenate([ids, dense.ravel()])
    order = np.argsort(rows, kind="stable")
    return ids[order].astype(np.int32), np.searchsorted(rows[order], np.arange(n + 1))


def telling(every: np.ndarray, hits: np.ndarray, n_rows: int, n_hits: int) -> np.ndarray:
    """Features that at least ``_LEAST_ROWS`` rows have, and whose share of the class is further from that of all
    rows than chance would have it (``_LEAST_Z`` deviations).

    The many words without meaning for the question cannot add up in a long text then.
    """
    share = (n_hits + 1) / (n_rows + 2)
    z = (hits - every * share) / np.sqrt(np.maximum(every, 1) * share * (1 - share))
    return (every >= _LEAST_ROWS) & (np.abs(z) >= _LEAST_Z)


def fit(ids: list[np.ndarray], targets: np.ndarray, use: np.ndarray, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on the binary features in ``use``, by adaptive gradient steps.

    With one class only, there are no weights and the intercept is the odds of its smoothed share.
    """
    share = (targets.sum() + 1) / (len(targets) + 2)
    weights, bias = np.zeros(FEATURES), float(np.log(share / (1 - share)))
    if len(set(targets.tolist())) < 2:
        return weights, bias
    kept = [own[use[own]] for own in ids]
    flat = np.concatenate(kept)
    row = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in kept])
    squares, bias_square = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(_EPOCHS):
        odds = np.bincount(row, weights=weights[flat], minlength=len(ids)) + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - targets
        gradient = np.bincount(flat, weights=error[row], minlength=FEATURES) / len(ids) + decay * weights
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
        g = float(error.mean())
        bias_square += g * g
        bias -= 0.5 * g / np.sqrt(bias_square)
    return weights, bias


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.slices(batch, "text"):
            ids, begins = features(piece.column("text"))
            blobs = [ids[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("quality"), piece.column("toxic"), pa.array(blobs, pa.binary())], ["quality", "toxic", "ids"]
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature: rows, good rows, toxic rows of this task."""
    counts = np.zeros((3, FEATURES), dtype=np.int64)
    for batch in batches:
        for quality, toxic, ids in zip(*(batch[c].to_pylist() for c in ("quality", "toxic", "ids")), strict=True):
            own = np.frombuffer(ids, dtype=np.int32)
            counts[0, own] += 1
            counts[1, own] += quality
            counts[2, own] += toxic
    some = np.flatnonzero(counts[0])
    for lo in range(0, len(some), 1 << 15):
        at = some[lo : lo + (1 << 15)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(c[at]) for c in counts)], ["feature", "n", "good", "toxic"])


def _keep(use):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = [np.frombuffer(x, dtype=np.int32) for x in batch["ids"].to_pylist()]
            ids = [own[use.value[own]].tobytes() for own in all_ids]
            yield pa.RecordBatch.from_arrays([batch["quality"], batch["toxic"], pa.array(ids, pa.binary())], ["quality", "toxic", "ids"])

    return run


def fit_classifiers(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS
) -> tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """(weights, intercept) for good quality and for toxicity, from at most ``rows`` labelled documents.

    A label is null or 0 or 1; an id's labels are those of its row with the greatest values.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    )
    # A repeated id counts once, so that the sample is bounded by its labels.
    texts = docs.select(F.col(f"`{id}`").alias("own_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows_sql = "quality int, toxic int, ids binary"
    sample = stored(
        texts.join(F.broadcast(chosen), F.col("own_id") == F.col("label_id"))  # at most ``rows`` rows
        .dropDuplicates(["label_id"])
        .select("text", "quality", "toxic")
        .mapInArrow(_extract, rows_sql),
        "sample",
    )
    # Counts of all features are added up by the tasks; the driver sees the telling features of each row.
    counts = (
        sample.mapInArrow(_count, "feature int, n long, good long, toxic long")
        .groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
        .toArrow()
    )
    every = np.zeros((3, FEATURES))
    every[:, np.asarray(counts["feature"])] = [np.asarray(counts[c]) for c in ("n", "good", "toxic")]
    n, n_good, n_toxic = (x or 0 for x in sample.agg(F.count("*"), F.sum("quality"), F.sum("toxic")).first())
    uses = [telling(every[0], hits, n, total) for hits, total in ((every[1], n_good), (every[2], n_toxic))]
    use = docs.sparkSession.sparkContext.broadcast(uses[0] | uses[1])
    got = sample.mapInArrow(_keep(use), rows_sql).toArrow()
    good, toxic = (np.asarray(got[c], dtype=float) for c in ("quality", "toxic"))
    ids = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in got["ids"]]  # views, not copies
    return fit(ids, good, uses[0]), fit(ids, toxic, uses[1])


def _score(models, carried: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (good, good_bias), (toxic, toxic_bias) = models.value
        for batch in batches:
            for piece in W.slices(batch, text):
                ids, begins = features(piece.column(text))
                row = np.repeat(np.arange(piece.num_rows), np.diff(begins))
                scores = [
                    np.bincount(row, weights=w[ids], minlength=piece.num_rows) + b
                    for w, b in ((good, good_bias), (toxic, toxic_bias))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in carried), *(pa.array(s, pa.float64()) for s in scores)],
                    [*carried, "good", "toxic"],
                )

    return run


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    fit_rows: int = FIT_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``df`` (all, unless given), ``p_good``, ``p_toxic`` and ``kept``.

    A logistic classifier fitted on a bounded sample of labelled documents gives each document's own odds.
    Their means over all documents give every host, and every path within a host, a rate: hosts are shrunk to
    the global rate and paths to their host's, by a prior whose weight follows from how much sites differ.
    ``documents`` carries no URL, so ``source`` stands for the host and ``lang`` for the path unless named.
    A document's odds are then moved by its path's odds against the global ones. A document is kept if it is
    more likely good than not, and less likely toxic than not.

    A null or empty text is judged by its lack of words like any other. Null hosts and paths are sites of
    their own. Without labels, or with one class only, the odds are the labels' smoothed share. Rows are
    judged one by one, so repeated rows get equal answers; columns of the three names are replaced.
    """
    spark = df.sparkSession
    df = df.drop("p_good", "p_toxic", "kept")
    carry = list(carry if carry is not None else df.columns)
    models = spark.sparkContext.broadcast(fit_classifiers(df, labels, id, text, fit_rows))
    names = {c: f"c{n}" for n, c in enumerate(df.columns)}
    kinds = {names[f.name]: f.dataType.simpleString() for f in df.schema.fields}
    carried = list(dict.fromkeys(names[c] for c in [*carry, host, path]))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), "good double", "toxic double"])
    scored = stored(df.toDF(*names.values()).mapInArrow(_score(models, carried, names[text]), schema), "scored")

    h, p = names[host], names[path]
    chance = lambda c: F.lit(1.0) / (1 + F.exp(-F.col(c)))
    sites = scored.groupBy(h, p).agg(
        F.count("*").alias("n"), F.sum(chance("good")).alias("g"), F.sum(chance("toxic")).alias("t")
    )
    hosts = sites.groupBy(h).agg(F.sum("n").alias("hn"), F.sum("g").alias("hg"), F.sum("t").alias("ht"))
    totals = hosts.agg(
        *[F.sum(c).alias(c) for c in ("hn", "hg", "ht")],
        F.var_pop(F.col("hg") / F.col("hn")).alias("vg"),
        F.var_pop(F.col("ht") / F.col("hn")).alias("vt"),
        F.avg(1 / F.col("hn")).alias("inverse"),
    )
    n, g, t, vg, vt, inverse = (x if x is not None else 0 for x in totals.first())
    # One row of figures for all documents; with none there is nothing to shrink.
    mean_g, mean_t = ((x + 1) / (n + 2) for x in (g, t))

    def strength(mean: float, variance: float) -> float:
        """Documents that a prior is worth, by moments: how far hosts differ beyond what chance explains."""
        spread = mean * (1 - mean)
        return max(1.0, spread / max(variance - spread * inverse, spread / 10_000) - 1)

    kg, kt = strength(mean_g, vg), strength(mean_t, vt)
    host_g = (F.col("hg") + mean_g * kg) / (F.col("hn") + kg)
    host_t = (F.col("ht") + mean_t * kt) / (F.col("hn") + kt)
    rated = (
        sites.withColumns({"h_": F.col(h)})
        .join(hosts.withColumnRenamed(h, "h2"), F.col("h_").eqNullSafe(F.col("h2")))
        .select(
            F.col(h).alias("h2"),
            F.col(p).alias("p2"),
            (_logit((F.col("g") + host_g * kg) / (F.col("n") + kg)) - _logit(F.lit(mean_g))).alias("up"),
            (_logit((F.col("t") + host_t * kt) / (F.col("n") + kt)) - _logit(F.lit(mean_t))).alias("tox"),
        )
    )
    rated = stored(rated, "sites")
    if rated.count() <= BROADCAST_SITES:
        rated = F.broadcast(rated)
    moved = scored.join(rated, F.col(h).eqNullSafe(F.col("h2")) & F.col(p).eqNullSafe(F.col("p2")), "left")
    both = [F.col(a) + F.coalesce(b, F.lit(0.0)) for a, b in (("good", F.col("up")), ("toxic", F.col("tox")))]
    return moved.select(
        *[F.col(names[c]).alias(c) for c in carry],
        (F.lit(1.0) / (1 + F.exp(-both[0]))).alias("p_good"),
        (F.lit(1.0) / (1 + F.exp(-both[1]))).alias("p_toxic"),
        ((both[0] >= 0) & (both[1] < 0)).alias("kept"),
    )
