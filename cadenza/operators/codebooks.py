"""Codebooks as tables, sections of bands, and searches for the cheapest coding."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pcm


def pair_codebook(spark: SparkSession, books: Iterable[tuple[int, int]]) -> DataFrame:
    """codebook, x, y, bits: for each (codebook, largest magnitude) all pairs, with lengths by a rule.

    A pair costs 1 bit, and 2 more for each bit of either magnitude, and a bit for the size of the book.
    Callers with code tables of their own pass those instead.
    """
    rows = [(b, x, y, 1 + 2 * (x.bit_length() + y.bit_length()) + most.bit_length()) for b, most in books for x, y in itertools.product(range(most + 1), repeat=2)]
    return spark.createDataFrame(rows, "codebook long, x long, y long, bits long")


def cheapest(costs: DataFrame, keys: list[str], choice: str, cost: str) -> DataFrame:
    """The choice of least cost for each key, the first in order of choice where equal."""
    return costs.groupBy(*keys).agg(F.min(F.struct(cost, choice)).alias("_m")).select(*keys, f"_m.{choice}", f"_m.{cost}")


def merge_sections(bands: DataFrame, keys: list[str], band: str, choice: str, start: str, end: str, bits: str) -> DataFrame:
    """Neighbouring bands of one choice become a section: first line, last line, choice and bits."""
    order = Window.partitionBy(*keys).orderBy(band)
    fresh = F.coalesce((F.lag(choice).over(order) != F.col(choice)).cast("int"), F.lit(1))
    numbered = bands.withColumn("_fresh", fresh).withColumn("section", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "section", choice).agg(F.min(start).alias("line_start"), F.max(end).alias("line_end"), F.sum(bits).alias("bits"))


def spectral_regions(q: Column) -> Column:
    """big pairs, count1 quads and zero lines of an array of quantised lines.

    The last non-zero line ends what is coded; from there back, quads of magnitudes
    of at most one are counted, and pairs before them.
    """
    last = F.aggregate(F.transform(q, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda m, x: F.greatest(m, x))
    coded = F.slice(q, 1, last)
    # Largest distance from the end, by quads, within which all magnitudes are at most one.
    firsts = F.aggregate(F.transform(F.reverse(coded), lambda x, i: F.when(F.abs(x) > 1, i).otherwise(last)), last, lambda m, x: F.least(m, x))
    quads = F.floor(firsts / 4)
    rest = last - 4 * quads
    return F.struct(F.ceil(rest / 2).cast("long").alias("big_pairs"), quads.cast("long").alias("count1_quads"), (F.size(q) - last).cast("long").alias("zero_lines"))


def huffman_lengths(counts: list[int]) -> list[int]:
    """Code lengths of a Huffman tree over a histogram; ties go to the node made first; 0 for what doesn't occur."""
    heap = [(n, i) for i, n in enumerate(counts) if n > 0]
    if len(heap) == 1:
        return [1 if n > 0 else 0 for n in counts]
    heapq.heapify(heap)
    parent, fresh = {}, len(counts)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = fresh
        heapq.heappush(heap, (a + b, fresh))
        fresh += 1
    depth = {fresh - 1: 0}
    for node in range(fresh - 2, -1, -1):
        if node in parent:
            depth[node] = depth[parent[node]] + 1
    return [depth.get(i, 0) if n > 0 else 0 for i, n in enumerate(counts)]


def codewords(lengths: list[int]) -> list[int | None]:
    """Canonical codes of given lengths, lowest free code first, in order of symbol; raises on an overfull set."""
    if sum(2.0**-n for n in lengths if n) > 1:
        raise ValueError("the lengths don't fit a prefix code")
    code, last, out = 0, 0, [None] * len(lengths)
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        code <<= n - last
        out[i], last = code, n
        code += 1
    return out


def huffman_table(histogram: DataFrame, keys: list[str], symbol: str, count: str) -> DataFrame:
    """Adds the length and code of each symbol, by group; a group is one alphabet, so it stays small."""
    schema = ", ".join([*(f"`{k}` {histogram.schema[k].dataType.simpleString()}" for k in keys), f"`{symbol}` long, `{count}` long, length long, code long"])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(symbol)
        lengths = huffman_lengths(group[count].tolist())
        return group.assign(length=lengths, code=codewords(lengths))[[*keys, symbol, count, "length", "code"]]

    return histogram.groupBy(*keys).applyInPandas(build, schema)


def pack_codes(codes: Column, lengths: Column) -> Column:
    """Codes in a row, most significant bit first, as text of 0 and 1; ``packed`` turns it into bytes."""
    return F.array_join(F.zip_with(codes, lengths, lambda c, n: F.when(n > 0, F.lpad(F.bin(c), n, F.lit("0"))).otherwise("")), "")


def packed(bits: Column) -> Column:
    """Text of 0 and 1 as bytes, filled with zeros."""
    whole = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    octets = F.transform(F.sequence(F.lit(0), F.greatest(F.length(whole) / 8 - 1, F.lit(0)).cast("int")), lambda i: F.lpad(F.conv(F.substr(whole, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(F.length(bits) == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(octets, "")))


def nearest(vector: Column, entries: Column) -> Column:
    """The index of the entry, in an array of vectors, at the least squared distance rounded to 9 digits, the first where equal."""
    away = lambda e: F.round(pcm.total(F.zip_with(vector, e, lambda a, b: (a - b) * (a - b))), 9)
    return F.array_min(F.transform(entries, lambda e, k: F.struct(away(e).alias("d"), k.cast("long").alias("entry"))))["entry"]


def rice_choice(samples: Column, n: int, depth: int, orders: range = range(1, 5), most_k: int = 14) -> Column:
    """(bits, order, k) of the cheapest fixed predictor and Rice parameter; the first of equal cost."""
    shifts = F.sequence(F.lit(0), F.lit(most_k))

    def of(order: int, folded: Column) -> Column:
        high = lambda k: F.aggregate(folded, F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftright", x, k))
        bits = lambda k: (18 + order * depth + high(k) + (n - order) * (1 + k)).cast("long")
        return F.array_min(F.transform(shifts, lambda k: F.struct(bits(k).alias("bits"), F.lit(order).cast("long").alias("order"), k.cast("long").alias("k"))))

    return F.array_min(F.array(*(_let_order(samples, order, of) for order in orders)))


def _let_order(samples: Column, order: int, of) -> Column:
    return pcm.let(F.transform(pcm.difference(samples, order), pcm.fold_sign), lambda f: of(order, f))


def pulse_vector(x: np.ndarray, pulses: int) -> np.ndarray:
    """Integer vector of so many unit pulses that points most nearly along x, by greedy search; zeros go to the first entry."""
    signs, y = np.where(x < 0, -1, 1), np.zeros(len(x), np.int64)
    size = np.abs(x).astype(np.float64)
    total = size.sum()
    if total > 1e-15:
        y = np.floor(size / total * max(0, pulses - 1)).astype(np.int64)
    elif len(y):
        y[0] = pulses
    xy, yy = float(size @ y), float(y @ y)
    for _ in range(pulses - int(y.sum())):
        gain = (xy + size) ** 2 / (yy + 2 * y + 1)
        best = int(np.argmax(gain))
        xy, yy = xy + size[best], yy + 2 * y[best] + 1
        y[best] += 1
    return y * signs


def pulse_codewords(n: int, k: int) -> int:
    """Number of integer vectors of n entries whose magnitudes add up to k."""
    row = [1] + [0] * k
    for _ in range(n):
        fresh = [1] + [0] * k
        for j in range(1, k + 1):
            fresh[j] = fresh[j - 1] + row[j] + row[j - 1]
        row = fresh
    return row[k]


def pulse_index(y: list[int]) -> int:
    """Place of a pulse vector among all of its size, counted from the last entry: magnitudes from 0 up, positive before negative."""
    index, left = 0, sum(abs(v) for v in y)
    for i, v in enumerate(y[:-1]):
        rest = len(y) - i - 1
        for m in range(abs(v)):
            index += pulse_codewords(rest, left - m) * (1 if m == 0 else 2)
        left -= abs(v)
        if v < 0:
            index += pulse_codewords(rest, left)
    return index + (1 if y and y[-1] < 0 else 0)


def pulse_from_index(index: int, n: int, k: int) -> list[int]:
    out = []
    for i in range(n - 1):
        rest, m = n - i - 1, 0
        while index >= (size := pulse_codewords(rest, k - m) * (1 if m == 0 else 2)):
            index -= size
            m += 1
        half = pulse_codewords(rest, k - m)
        negative = m > 0 and index >= half
        index -= half if negative else 0
        out.append(-m if negative else m)
        k -= m
    return [*out, -k if index else k]
