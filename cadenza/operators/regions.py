"""Code tables of spectral regions by cost, and quantiser steps in a budget of payload bits.

Each table's cost of each pair of lines is summed along the spectrum, so that the cost of
any region under any table is a difference of two sums, and the cheapest table of every
region between two borders is one minimum.  All rows of a slice of an Arrow batch are
worked on at once; a spectrum needs nothing but itself, so there is no shuffle.

Code tables are the caller's: lengths of pairs of magnitudes, and of quads of zeros and
ones.  Signs are a bit for each line that isn't zero, and lines of 15 or more add the
suffix of an escape table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Largest magnitude that can be coded, and the one from which suffixes follow; fixed values of the format.
MOST, ESCAPE = 8191, 15
#: Suffix bits of the tables from 16 on and from 24 on; fixed values of the format.
SUFFIX = {16: (1, 2, 3, 4, 6, 8, 10, 13), 24: (4, 5, 6, 7, 8, 9, 11, 13)}
#: Numbers and largest magnitudes of the tables without suffix; fixed values of the format.
PLAIN = ((1, 1), (2, 2), (3, 2), (5, 3), (6, 3), (7, 5), (8, 5), (9, 5), (10, 7), (11, 7), (12, 7), (13, 15), (15, 15))
#: Lengths of quads in the two tables, by magnitudes from 0000 to 1111; fixed values of the format.
QUADS = ((1, 4, 4, 5, 4, 6, 5, 6, 4, 5, 5, 6, 5, 6, 6, 6), (4,) * 16)
#: Rows worked on at once.
SLICE = 256


@dataclass(frozen=True)
class PairTable:
    """``lengths[x][y]`` of magnitudes up to ``most``; with ``suffixed``, 15 stands for all from 15 on."""

    table: int
    most: int
    lengths: tuple[tuple[int, ...], ...]
    suffixed: bool = False


def ruled_tables() -> list[PairTable]:
    """Tables of the format's numbers and sizes, with lengths by a rule: 1 + v + (4 - v)(bits of x + bits of y) div 2 + bits of the size.

    v is 0, 1, 2 among tables of one size in order, 0 for table 16 and 2 for table 24.
    """

    def made(table: int, most: int, v: int, suffixed: bool) -> PairTable:
        length = lambda x, y: 1 + v + (4 - v) * (x.bit_length() + y.bit_length()) // 2 + most.bit_length()
        return PairTable(table, most, tuple(tuple(length(x, y) for y in range(most + 1)) for x in range(most + 1)), suffixed)

    plain = [made(t, m, sum(m == n for _, n in PLAIN[:k]), False) for k, (t, m) in enumerate(PLAIN)]
    return [*plain, made(16, 15, 0, True), made(24, 15, 2, True)]


@dataclass
class Costs:
    """Prefix sums along the pairs of each row, by table; edges are pairs, cut at each row's last one."""

    big_pairs: np.ndarray
    quads: np.ndarray
    fits: np.ndarray
    sums: np.ndarray  # table, row, edge
    escapes: np.ndarray  # row, edge
    tops: np.ndarray  # row, span between edges
    count1: np.ndarray  # row, quad table


def _regions(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, and quads of magnitudes up to one behind them."""
    n = size.shape[1]
    last = np.where(size > 0, np.arange(1, n + 1), 0).max(1, initial=0)
    large = np.where(size > 1, np.arange(1, n + 1), 0).max(1, initial=0)
    quads = (last - large) // 4
    return (last - 4 * quads + 1) // 2, quads


def costs(q: np.ndarray, edges: Sequence[int], tables: Sequence[PairTable], quad_tables: Sequence[Sequence[int]] = QUADS) -> Costs:
    """Of rows of quantised lines; ``edges`` are the lines between which regions may lie, 0 and the last one among them."""
    size = np.abs(q)
    fits = (size <= MOST).all(1)
    size = np.where(fits[:, None], size, 0)
    big, quads = _regions(size)
    rows, lines = size.shape
    x, y = size[:, 0 : lines - 1 : 2], size[:, 1::2]
    own = np.arange(x.shape[1]) < big[:, None]
    at = np.minimum(np.asarray(edges) // 2, big[:, None])
    total = lambda v: np.take_along_axis(np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(np.where(own, v, 0), 1)], 1), at, 1)
    signs = (x > 0).astype(np.int64) + (y > 0)
    sums = []
    for t in tables:
        lengths = np.asarray(t.lengths)
        sums.append(total(lengths[np.minimum(x, t.most), np.minimum(y, t.most)] + signs))
    tall = np.where(own, np.maximum(x, y), 0)
    spans = [np.where((np.arange(tall.shape[1]) >= at[:, [k]]) & (np.arange(tall.shape[1]) < at[:, [k + 1]]), tall, 0).max(1, initial=0) for k in range(len(edges) - 1)]
    wide = np.concatenate([size, np.zeros((rows, 4), size.dtype)], 1)
    place = 2 * big[:, None] + np.arange(lines // 4 * 4)
    small = np.take_along_axis(wide, np.minimum(place, lines), 1).reshape(rows, -1, 4)
    mine = np.arange(small.shape[1]) < quads[:, None]
    name = np.minimum(small, 1) @ np.array([8, 4, 2, 1])
    bits = np.stack([np.where(mine, np.asarray(t)[name] + np.minimum(small, 1).sum(2), 0).sum(1) for t in quad_tables], 1)
    return Costs(big, quads, fits, np.stack(sums), total((x >= ESCAPE).astype(np.int64) + (y >= ESCAPE)), np.stack(spans, 1), bits)


def _suffix(table: int, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table of a family whose suffix holds the magnitude, and its bits."""
    need = np.array([int(v).bit_length() for v in np.maximum(top - ESCAPE, 0)]) if len(top) else np.zeros(0, np.int64)
    k = np.searchsorted(SUFFIX[table], need)
    return table + k, np.asarray(SUFFIX[table])[np.minimum(k, len(SUFFIX[table]) - 1)]


def cheapest_table(c: Costs, tables: Sequence[PairTable], start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, suffix bits and bits of the region between two edges of each row; the first table where equal, 0 for silence."""
    top = c.tops[:, start:end].max(1, initial=0)
    best, number, suffix = np.full(len(top), np.iinfo(np.int64).max), np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)
    for k, t in enumerate(tables):
        bits = c.sums[k][:, end] - c.sums[k][:, start]
        if t.suffixed:
            name, more = _suffix(t.table, top)
            bits = bits + more * (c.escapes[:, end] - c.escapes[:, start])
            better = bits < best
        else:
            name, more = np.full(len(top), t.table), np.zeros(len(top), np.int64)
            better = (bits < best) & (top <= t.most)
        best, number, suffix = np.where(better, bits, best), np.where(better, name, number), np.where(better, more, suffix)
    silent = top == 0
    return np.where(silent, 0, number), np.where(silent, 0, suffix), np.where(silent, 0, best)


def cheapest_borders(c: Costs, tables: Sequence[PairTable], counts: tuple[int, int] = (16, 8)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of the first and second region, each less one, and the bits of all three; the first pair where equal."""
    n = c.tops.shape[1]
    head = {j: cheapest_table(c, tables, 0, j)[2] for j in range(1, min(counts[0], n) + 1)}
    tail = {j: cheapest_table(c, tables, j, n)[2] for j in range(2, n + 1)}
    best = (np.full(len(c.tops), np.iinfo(np.int64).max), np.zeros(len(c.tops), np.int64), np.zeros(len(c.tops), np.int64))
    for i in head:
        for j in range(i + 1, min(i + counts[1], n) + 1):
            bits = head[i] + cheapest_table(c, tables, i, j)[2] + tail[j]
            better = bits < best[0]
            best = np.where(better, bits, best[0]), np.where(better, i - 1, best[1]), np.where(better, j - i - 1, best[2])
    return best[1], best[2], best[0]


def payload_bits(q: np.ndarray, edges: Sequence[int], tables: Sequence[PairTable]) -> np.ndarray:
    """Bits of all regions between the given edges and of the quads; -1 for rows that can't be coded."""
    c = costs(q, edges, tables)
    bits = sum(cheapest_table(c, tables, k, k + 1)[2] for k in range(len(edges) - 1)) + c.count1.min(1)
    return np.where(c.fits, bits, -1)


def quantised(lines: np.ndarray, step: float) -> np.ndarray:
    """sign(x) round(|x|^(3/4) / step), halves away from zero."""
    return (np.sign(lines) * np.floor(np.abs(lines) ** 0.75 / step + 0.5)).astype(np.int64)


def finest_fitting(lines: np.ndarray, budget: np.ndarray, steps: Sequence[float], bits_of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step, bits and number of steps looked at, of the finest step whose payload is within the budget; 0 and -1 where none is.

    Steps are taken from the finest on, in rounds, and a round evaluates only the rows
    that no finer step has fitted.
    """
    step, bits, rounds = np.zeros(len(lines)), np.full(len(lines), -1), np.zeros(len(lines), np.int64)
    left = np.arange(len(lines))
    for s in sorted(set(steps)):
        if not len(left):
            break
        found = bits_of(quantised(lines[left], s))
        rounds[left] += 1
        right = (found >= 0) & (found <= budget[left])
        step[left[right]], bits[left[right]] = s, found[right]
        left = left[~right]
    return step, bits, rounds


def by_rows(df: DataFrame, column: str, size: int, fields: dict[str, str], run: Callable[..., dict[str, np.ndarray]], *more: str) -> DataFrame:
    """Adds the columns that ``run`` makes of the matrix of an array column (and of further columns), slice by slice; the array goes.

    Rows whose array is null or of another size get nulls.
    """
    kept = [c for c in df.columns if c != column]
    names = df.columns
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                values = batch.column(names.index(column)).cast(pa.list_(pa.float64()))
                right = (np.diff(values.offsets.to_numpy()) == size) & values.is_valid().to_numpy(zero_copy_only=False)
                rows = values.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                given = [batch.column(names.index(c)).filter(pa.array(right)).to_numpy(zero_copy_only=False) for c in more]
                found, place = run(rows, *given), np.cumsum(right) - 1
                take = pa.array(place, pa.int64(), mask=~right)
                made = [pa.array(found[c].tolist(), kinds[k]).take(take) for c, k in fields.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *made], names=[*kept, *fields])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column]
    return df.mapInArrow(batches_of, ", ".join([*schema, *(f"`{c}` {k}" for c, k in fields.items())]))
