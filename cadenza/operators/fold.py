"""Folds over the ordered rows of each key, in batches, with a carried state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, key: str, order: str, start: Any, step: Callable[..., tuple[Any, tuple]], schema: str) -> DataFrame:
    """step(state, *row) gives the next state and an output row; the state begins anew with each key.

    Rows are dealt by key and sorted, so a key's rows stream through one task,
    whatever their number, and no row holds a whole key.
    """
    at = df.columns.index(key)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), start
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != now:
                    now, state = row[at], start
                state, made = step(state, *row)
                out.append(made)
            columns = zip(*out, strict=True) if out else ([] for _ in kind)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def ranked_fold(df: DataFrame, key: str, order: str, start: np.ndarray, step: Callable[..., tuple[np.ndarray, list]], schema: str) -> DataFrame:
    """The same for states that are vectors: step(states, rows) goes over one row of each of many keys at once.

    ``rows`` is a record batch of the columns after key and order; the step returns the next
    states and one Arrow array for each column of ``schema``.  Within a batch the n-th rows of
    all its keys are one call, and only the last key's state goes on to the next batch.  The
    result holds key and order before the step's columns.
    """
    fields = {f.name: f for f in df.schema.fields}
    whole = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in (key, order)), schema])
    kind = to_arrow_schema(StructType.fromDDL(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
            rank = np.arange(len(codes)) - first[run_of]
            states = np.tile(start, (len(first), 1))
            if batch.column(0)[0].as_py() == last:
                states[0] = state
            by_rank = np.argsort(rank, kind="stable")
            made = []
            for rows in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]):
                states[run_of[rows]], out = step(states[run_of[rows]], batch.select(batch.schema.names[2:]).take(pa.array(rows)))
                made.append(pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, list(kind)[2:], strict=True)], schema=pa.schema(list(kind)[2:])))
            last, state = batch.column(0)[len(codes) - 1].as_py(), states[-1]
            back = np.empty(len(codes), np.int64)
            back[by_rank] = np.arange(len(codes))
            found = pa.Table.from_batches(made).combine_chunks().take(pa.array(back)).to_batches()[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind.field(0).type), batch.column(1).cast(kind.field(1).type), *found.columns], schema=kind)

    rest = [c for c in df.columns if c not in (key, order)]
    return df.select(key, order, *rest).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, whole)
