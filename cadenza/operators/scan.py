"""Scans of clamped sums over streams of any length, by blocks that many tasks share.

A step takes a state x to min(max(x + add, low), high).  Steps after one another are again
such a step, so the frames of a block become one, the blocks of a stream are run through in
order (one row for each block), and then every block runs alone from the state it starts at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of the order column that a block spans.
BLOCK = 1 << 16

#: Stored bytes of a shuffle's part: some hundred thousand frames, whose sorts then fit a task at any size.
PART_BYTES = 1 << 18

Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def parts_for(rows: DataFrame) -> int | None:
    """Parts of shuffles of these rows, where their stored bytes ask for more than the session's setting; else None."""
    try:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no statistics, for instance on a remote session
        return None
    n = size // PART_BYTES
    return n if int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n < 1 << 20 else None


def dealt_by(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def then(first: Steps, second: Steps) -> Steps:
    """One step for two: add, low and high."""
    (a, low, high), (b, least, most) = first, second
    return a + b, np.minimum(np.maximum(low + b, least), most), np.minimum(np.maximum(high + b, least), most)


def composed(steps: Steps, fresh: np.ndarray) -> Steps:
    """For each row all steps of its run up to it; runs begin where ``fresh`` is set.  Doubles the reach in each pass."""
    run = np.cumsum(fresh)
    longest = int(np.bincount(run).max(initial=0))
    steps = tuple(s.copy() for s in steps)
    reach = 1
    while reach < longest:
        at = np.flatnonzero(run[reach:] == run[:-reach]) + reach
        joined = then(tuple(s[at - reach] for s in steps), tuple(s[at] for s in steps))
        for s, value in zip(steps, joined, strict=True):
            s[at] = value
        reach *= 2
    return steps


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch, and where a value of its first ``keys`` columns differs from the row before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            fresh[1:] |= code[1:] != code[:-1]
        now = [batch.column(k)[0].as_py() for k in range(keys)]
        fresh[0] = last != now
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(keys)]
        yield batch, fresh


def _steps(batch: pa.RecordBatch, first: int) -> Steps:
    return tuple(batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))


def _carried(batches: Iterator[pa.RecordBatch], keys: int, steps_at: int, start_at: int | None = None, start: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Steps]]:
    """Batches with the steps of each row's run up to it, whatever batch the run began in.

    With a start (a column or a value) runs begin at that state, and low equals high: the state after the row.
    """
    carry = None
    for batch, fresh in _runs(batches, keys):
        steps = _steps(batch, steps_at)
        if start_at is not None:
            at = np.flatnonzero(fresh)
            begin = np.full(len(at), start) if start_at < 0 else batch.column(start_at).to_numpy(zero_copy_only=False)[at]
            for s, value in zip(steps, then((np.zeros(len(at), np.int64), begin, begin), tuple(s[at] for s in steps)), strict=True):
                s[at] = value
        if carry is not None and not fresh[0]:
            for s, value in zip(steps, then(carry, tuple(s[:1] for s in steps)), strict=True):
                s[:1] = value
        steps = composed(steps, fresh)
        carry = tuple(s[-1:] for s in steps)
        yield batch, fresh, steps


def clamped(rows: DataFrame, key: str, order: str, add: Column, low: Column, high: Column, start: int, before: str) -> DataFrame:
    """Adds ``before``: the state of each stream ahead of each row, from ``start`` on, in the order given.

    Rows of equal order share a block, and follow one another in any order.
    """
    names, kind = rows.columns, rows.schema[key].dataType.simpleString()
    steps = rows.select(F.col(key).alias("_key"), F.floor(F.col(order) / BLOCK).alias("_block"), add.cast("long").alias("_add"), low.cast("long").alias("_low"), high.cast("long").alias("_high"), F.struct(*names).alias("_row"))
    parts = parts_for(rows)
    dealt = dealt_by(steps, parts, "_key", "_block")
    ordered = [F.col("_key"), F.col("_block"), F.col(f"_row.{order}")]

    def whole(batches):
        """The last row of each run has the steps of all."""
        kept = None
        for batch, fresh, found in _carried(batches, 2, 2):
            ends = np.append(fresh[1:], False)
            if kept is not None and fresh[0]:
                yield kept
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], names=["_key", "_block", "_add", "_low", "_high"])
            yield made.filter(pa.array(ends))
            kept = made.slice(batch.num_rows - 1)
        if kept is not None:
            yield kept

    light = dealt.select("_key", "_block", "_add", "_low", "_high", F.col(f"_row.{order}").alias("_order")).sortWithinPartitions("_key", "_block", "_order")
    blocks = light.drop("_order").mapInArrow(whole, f"_key {kind}, _block bigint, _add bigint, _low bigint, _high bigint")

    def starts(batches):
        after = start
        for batch, fresh, found in _carried(batches, 1, 2, -1, start):
            state = np.concatenate([[after], found[1][:-1]])
            state[fresh] = start
            after = found[1][-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state)], names=["_key", "_block", "_start"])

    begun = dealt_by(blocks, parts, "_key").sortWithinPartitions("_key", "_block").mapInArrow(starts, f"_key {kind}, _block bigint, _start bigint")
    begun = begun.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), "_start")
    joined = dealt.join(begun, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    joined = dealt_by(joined.select("_key", "_block", "_add", "_low", "_high", "_start", "_row"), parts, "_key", "_block").sortWithinPartitions(*ordered)

    def states(batches):
        after = 0
        for batch, fresh, found in _carried(batches, 2, 2, 5):
            state = np.concatenate([[after], found[1][:-1]])
            state[fresh] = batch.column(5).to_numpy(zero_copy_only=False)[fresh]
            after = found[1][-1]
            yield pa.RecordBatch.from_arrays([batch.column(6), pa.array(state)], names=["_row", "_before"])

    row = joined.schema["_row"].dataType.simpleString()
    found = joined.mapInArrow(states, f"_row {row}, _before bigint")
    return found.select("_row.*", F.col("_before").alias(before))
