"""Global positions and running counts without a one-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import peerwatch
from peerwatch.functions import columns as C
from peerwatch.operators.quantiles import nth_smallest
from peerwatch.sources.staging import local_table, stage

_SLOT_BITS = 33


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted, each with its partition and place, written once.

    Writing fixes the boundaries: the counts and the rows below must come from
    the same partitioning, which a recomputation would sample anew.
    """
    slot = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_slot", slot)
    return stage(placed, "ranged").withColumn("_part", F.shiftright("_slot", _SLOT_BITS))


def _before(parts: DataFrame, amount: Column) -> DataFrame:
    """Amount held by the earlier partitions; one row per partition."""
    window = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(amount.alias("_amount"))
    return sums.select("_part", F.coalesce(F.sum("_amount").over(window), F.lit(0)).alias("_before"))


def number_rows(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """1-based global position in a total order (the order must end in a unique key)."""
    placed = ranged(df, order)
    within = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.join(F.broadcast(_before(placed, F.count(F.lit(1)))), "_part")
        .withColumn(out, F.col("_before") + within + 1)
        .drop("_part", "_slot", "_before")
    )


def _same(a, b):
    """Equal as values of a sort: NaN is a value."""
    return (a == b) | (np.isnan(a) & np.isnan(b))


def _count_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (value, weight, ...) with their partition, the weight below their value there, and that of the value.

    The rows of the last value are held until it is over; a partition of the range sort bounds them.
    """
    part = TaskContext.get().partitionId()
    below, tie, current, waiting = 0, 0, np.nan, []

    def told(rows: pa.RecordBatch, lows: np.ndarray, ties: np.ndarray) -> pa.RecordBatch:
        more = [pa.array(np.full(len(rows), part, np.int32)), pa.array(lows), pa.array(ties)]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "_part", "_below", "_tie"])

    def over() -> Iterator[pa.RecordBatch]:
        for rows in waiting:
            yield told(rows, np.full(len(rows), below), np.full(len(rows), tie))

    for batch in batches:
        v, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(v):
            continue
        starts = np.nonzero(np.concatenate(([not waiting or not _same(v[0], current)], ~_same(v[1:], v[:-1]))))[0]
        head = int(starts[0]) if len(starts) else len(v)
        if head:
            waiting.append(batch.slice(0, head))
            tie += int(w[:head].sum())
        if not len(starts):
            continue
        yield from over()
        below += tie
        sums = np.add.reduceat(w, starts)
        lows, last = below + np.cumsum(sums) - sums, int(starts[-1])
        if last > head:
            lengths = np.diff(starts)
            yield told(batch.slice(head, last - head), np.repeat(lows[:-1], lengths), np.repeat(sums[:-1], lengths))
        below, tie, current, waiting = int(lows[-1]), int(sums[-1]), v[-1], [batch.slice(last)]
    yield from over()


def average_ranks(df: DataFrame, value: str, out: str, weight: str | None = None) -> DataFrame:
    """The rows with the average rank of their value among all rows, each counted `weight` times; NULL values are left out.

    One range sort on the value and the other columns, written once, so rows of
    one value may lie in several partitions; a partition counts its own ties, and
    the totals and outermost values of the partitions, a row each, do the rest.
    No join on values, and nothing is sorted or gathered by value.
    """
    others = [c for c in df.columns if c not in (value, weight)]
    amount = (F.col(weight) if weight else F.lit(1)).cast("bigint")
    inner = df.where(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("_v"), amount.alias("_w"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)]
    )
    cloudpickle.register_pickle_by_value(peerwatch)
    order = [F.col(c) for c in inner.columns if c != "_w"]
    schema = T.StructType([*inner.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_below", T.LongType()), T.StructField("_tie", T.LongType())])
    placed = stage(inner.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_count_ties, schema), "ties")
    parts = placed.groupBy("_part").agg(
        F.sum("_w").alias("w"), F.min("_v").alias("first"), F.max("_v").alias("last"),
        F.min_by("_tie", "_v").alias("first_tie"), F.max_by("_tie", "_v").alias("last_tie"),
    ).orderBy("_part").collect()  # one row per partition
    edges = local_table(df.sparkSession, _edges(parts), _EDGES)
    first, last = F.col("_v").eqNullSafe(F.col("_first")), F.col("_v").eqNullSafe(F.col("_last"))
    head, tail = F.when(first, F.col("_head")).otherwise(0), F.when(last, F.col("_tail")).otherwise(0)
    rank = F.col("_before") + F.col("_below") - head + (F.col("_tie") + head + tail + 1) / 2.0
    kept = [F.col("_v").cast(df.schema[value].dataType).alias(value), *([F.col("_w").alias(weight)] if weight else [])]
    return placed.join(edges, "_part").select(*kept, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)], rank.alias(out))


_EDGES = T.StructType([
    T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_first", T.DoubleType()),
    T.StructField("_head", T.LongType()), T.StructField("_last", T.DoubleType()), T.StructField("_tail", T.LongType()),
])


def _edges(parts: list) -> list[tuple]:
    """Per partition: weight before it, its first value and that value's weight before it, its last and that one's weight after it."""
    heads, tails = {}, {}
    for rows, ends, near, far, ties in ((parts, heads, "first", "last", "last_tie"), (parts[::-1], tails, "last", "first", "first_tie")):
        value, held = None, 0
        for p in rows:
            ends[p["_part"]] = held if value is not None and _same(p[near], value) else 0
            held = p[ties] + (ends[p["_part"]] if _same(p["first"], p["last"]) else 0)
            value = p[far]
    out, before = [], 0
    for p in parts:
        out.append((p["_part"], before, p["first"], heads[p["_part"]], p["last"], tails[p["_part"]]))
        before += p["w"]
    return out


def top_rows(df: DataFrame, order: list[Column], n: int, out: str = "position") -> DataFrame:
    """First n rows of a total order, numbered; only n rows meet in one task."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def hashed_sample(df: DataFrame, n: int, keys: list[Column], order_keys: list[str], seed: int = 42) -> DataFrame:
    """The n rows with the smallest key hash: a sample that does not depend on partitioning.

    Rows with a NULL key are never drawn.  The n-th smallest hash is found by
    counting, so only the rows up to it are gathered, at every size alike.
    """
    hashed = df.withColumn("_hash", C.fold32(*keys, F.lit(seed))).where(F.col("_hash").isNotNull())
    cut = nth_smallest(hashed, "_hash", n)
    drawn = hashed.where(F.col("_hash") <= F.lit(cut)) if cut is not None else hashed
    return drawn.orderBy("_hash", *order_keys).limit(n).drop("_hash")
