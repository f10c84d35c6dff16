"""Sharding by sampled splitters: near-equal shards from range-partitioned records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditframe.llm.common import fresh, stored

RANGES_PER_SHARD = 16
#: Bytes (or whatever sizes count) of a range, on average, once there are more than ``RANGES_PER_SHARD`` of them a shard.
RANGE_SIZE = 256 << 20
#: The driver holds the bounds of all ranges: beyond this many, ranges grow instead.
MOST_RANGES = 20_000
#: Sampled records for each range, and altogether at least.
SAMPLE_PER_RANGE, SAMPLE_ROWS = 32, 50_000
#: A key with at most this share of a shard's size is not cut where a shard ends.
WHOLE_SHARE = 0.005
_UNIT = 1 << 30
_LEAST = -(1 << 63)


def _longs(values: list) -> Column:
    """A literal array, nested or not, as one constant: no expression for each number."""
    kind = "array<array<bigint>>" if values and isinstance(values[0], list) else "array<bigint>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: two short searches instead of one long."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(_longs([b[0] for b in blocks]), lambda x: x <= value))
    inside = F.element_at(_longs(blocks), F.greatest(block, F.lit(1)))
    found = F.size(F.filter(inside, lambda x: x <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * step + found).cast("int")


def _quantiles(n: int) -> Column:
    return F.from_json(F.lit(json.dumps([i / n for i in range(1, max(n, 2))])), "array<double>")


def _splitters(quantiles: list[int]) -> list[int]:
    """Bounds from quantiles. A key that fills a quantile and more gets a range of its own, so nothing shares its fate."""
    repeated = [a for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b]
    return sorted({*quantiles, *(v + 1 for v in repeated if v < (1 << 63) - 1)} - {_LEAST})


def shard_records(
    df: DataFrame,
    n_shards: int,
    key: Column,
    size: Column,
    tie: Column,
    ranges_per_shard: int = RANGES_PER_SHARD,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Records are ordered by ranges of ``key`` (long). The ranges are quantiles of a sample in
    which a record's chance grows with its ``size``; their number grows with the data. A key that fills
    a range has it for itself. A range that proves overfull when all records are weighed is
    subdivided at quantiles of its keys, and one that a single key fills at quantiles of ``tie`` (long), so one key may
    hold any part of the data. Exact running sizes inside each range then cut the order into shards.

    Equal keys stay together if they hold at most ``WHOLE_SHARE`` of a shard: where a shard ends among them, they go to the
    one they begin in. Sizes of shards differ by no more than that and the largest record. Larger groups are cut where a
    shard ends. Null keys and ties count as the smallest value, null or negative sizes as 0; with no size at all
    every record goes to shard 0. Rows with equal key and tie are placed in the order of their
    other sortable columns. The result is stored, with all columns of ``df``; columns already
    called ``shard`` or ``slot`` are replaced. No Python runs on the executors. An empty table gives no rows.
    """
    k, t, w, part, base_w, base_n, before, at, own = fresh(df, "k", "t", "w", "part", "bw", "bn", "before", "at", "own")
    lowest = F.lit(_LEAST)
    df = df.drop("shard", "slot")
    keep = df.columns
    work = df.withColumns(
        {
            k: F.coalesce(key.cast("long"), lowest),
            t: F.coalesce(tie.cast("long"), lowest),
            w: F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)),
        }
    )
    slim = work.select(k, t, w)
    total, rows = slim.agg(F.coalesce(F.sum(w), F.lit(0)), F.count("*")).first()
    n_ranges = max(n_shards * ranges_per_shard, min(MOST_RANGES, total // RANGE_SIZE))
    sample_rows = max(sample_rows, SAMPLE_PER_RANGE * n_ranges)

    # Splitters: a size-weighted sample, the same on every attempt because the draw is a hash.
    draw = F.pmod(F.xxhash64(k, t, F.lit("draw")), F.lit(_UNIT)) / _UNIT
    sampled = slim.filter(draw < F.col(w) * sample_rows / max(total, 1))
    bounds = _splitters(sampled.agg(F.percentile_approx(k, _quantiles(n_ranges), 5 * n_ranges)).first()[0] or [])

    # Overfull ranges, all records weighed: at most n_ranges of them can be twice the aim. Those with several keys
    # get more splitters, what is still overfull is cut by ties.
    aim = max(1, total // n_ranges)

    def overfull(column: str, splitters: list[int]) -> list[tuple]:
        ranged = slim.withColumn(part, _bucket(F.col(k), splitters))
        weighed = ranged.groupBy(part).agg(F.sum(w).alias(w), F.min(k).alias(k), F.max(k).alias(own))
        heavy = weighed.filter(F.col(w) > 2 * aim).filter((F.col(k) < F.col(own)) if column == k else F.lit(True)).collect()
        if not heavy:
            return []
        pieces = min(n_ranges, -(-max(r[w] for r in heavy) // aim)) + 1
        cuts = ranged.filter(F.array_contains(_longs([r[part] for r in heavy]), F.col(part).cast("long")))
        return [tuple(r) for r in cuts.groupBy(part).agg(F.percentile_approx(column, _quantiles(pieces), 10_000)).collect()]

    bounds = sorted({*bounds, *(b for _, cut in overfull(k, bounds) for b in _splitters(cut))})
    whole = F.col(own) <= max(1.0, total * WHOLE_SHARE / n_shards)
    cuts = overfull(t, bounds)
    sub = F.lit(0)
    for heavy, cut in cuts:
        sub = F.when(F.col(part) == heavy, _bucket(F.col(at), sorted(set(cut)))).otherwise(sub)
    ranged = work.withColumn(part, _bucket(F.col(k), bounds))
    if cuts:
        # Quantiles of keys are rounded, so a heavy key may still share its range: the groups beside it go whole where their first tie goes.
        beside = slim.withColumn(part, _bucket(F.col(k), bounds)).filter(F.col(part).isin([r for r, _ in cuts]))
        sizes = beside.groupBy(k).agg(F.sum(w).alias(own), F.count("*").alias(base_n), F.min(t).alias(at))
        ranged = ranged.join(sizes.filter(whole & (F.col(base_n) > 1)).select(k, at), k, "left").withColumn(at, F.coalesce(at, t))
    ranged = ranged.withColumn(part, F.col(part).cast("long") * (n_ranges + 2) + sub).drop(at)

    # Where each range begins. The table has as many rows as there are ranges: bounded by the parameters.
    loads = ranged.groupBy(part).agg(F.sum(w).alias(base_w), F.count("*").alias(base_n))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    loads = loads.select(
        part,
        F.coalesce(F.sum(base_w).over(earlier), F.lit(0)).alias(base_w),
        F.coalesce(F.sum(base_n).over(earlier), F.lit(0)).alias(base_n),
    )
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = [c for c in keep if not isinstance(kinds[c], T.MapType | T.VariantType) and "map<" not in kinds[c].simpleString()]
    inside = Window.partitionBy(part).orderBy(k, t, *plain)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(part, k)
    placed = (
        ranged.withColumn(before, F.coalesce(F.sum(w).over(running), F.lit(0)))
        .withColumn(at, F.row_number().over(inside).cast("long") - 1)
        .withColumns({own: F.sum(w).over(group), base_w: F.min(before).over(group)})
        .withColumn(before, F.when(whole, F.col(base_w)).otherwise(F.col(before)))
        .drop(base_w)
        .join(F.broadcast(loads), part)
        .select(
            *keep,
            F.least(
                F.floor((F.col(before) + F.col(base_w)) / F.lit(max(total, 1)) * n_shards), F.lit(n_shards - 1)
            ).cast("int").alias("shard"),
            (F.col(at) + F.col(base_n)).alias(at),
        )
    )
    placed = stored(placed, "shards")
    firsts = placed.groupBy("shard").agg(F.min(at).alias(base_n))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(at) - F.col(base_n)).drop(at, base_n)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its records in the order of their slots."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .option("compression", "zstd")
        .parquet(path)
    )
