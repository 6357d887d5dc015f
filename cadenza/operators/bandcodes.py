"""Standard codebooks of scale factor bands by cost, pairs and quads side by side, and sections of bands.

A band's cost under a book is a sum over the band's tuples, so all bands of all rows of a
slice of an Arrow batch are looked up at once, book by book; a spectrum needs nothing but
itself, so there is no shuffle.  Books are the caller's and are checked when they are made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pcm
from .regions import by_rows

#: Borders of the bands of short blocks at 44.1 and 48 kHz; fixed values of the format.
SHORT = (0, 4, 8, 12, 16, 20, 28, 36, 44, 56, 68, 80, 96, 112, 128)
#: Values in a tuple, largest magnitude and whether values are told with their sign, by book; fixed values of the format.
SHAPES = {1: (4, 1, True), 2: (4, 1, True), 3: (4, 2, False), 4: (4, 2, False), 5: (2, 4, True), 6: (2, 4, True), 7: (2, 7, False), 8: (2, 7, False), 9: (2, 12, False), 10: (2, 12, False), 11: (2, 16, False)}
#: The book with escapes, the magnitude that stands for an escape, and the largest one that can be coded; fixed values of the format.
ESCAPE_BOOK, ESCAPE, MOST = 11, 16, 8191


@dataclass(frozen=True)
class Book:
    """``lengths[v]...[w]`` of tuples of values up to ``most``; with ``signed``, values count from -most and carry no sign bits."""

    book: int
    lengths: np.ndarray
    signed: bool

    def __post_init__(self):
        if self.book not in SHAPES:
            raise ValueError(f"no book {self.book}")
        width, most, _ = SHAPES[self.book]
        lengths = np.asarray(self.lengths)
        if lengths.shape != ((2 * most + 1 if self.signed else most + 1),) * width:
            raise ValueError(f"book {self.book} has lengths for another set of tuples")
        if not np.issubdtype(lengths.dtype, np.integer) or (lengths < 1).any() or (lengths > 32).any():
            raise ValueError(f"book {self.book} has a length outside 1 to 32")
        if sum(int(n) << 32 - k for k, n in enumerate(np.bincount(lengths.ravel(), minlength=33))) > 1 << 32:
            raise ValueError(f"the lengths of book {self.book} don't fit a prefix code")

    @property
    def width(self) -> int:
        return SHAPES[self.book][0]

    @property
    def most(self) -> int:
        return SHAPES[self.book][1]


def ruled_book(book: int, slope: int, signed: bool | None = None) -> Book:
    """A book by a rule: ``slope`` for each bit of each magnitude, and the least base that makes a prefix code."""
    width, most, own = SHAPES[book]
    signed = own if signed is None else signed
    bits = np.array([slope * abs(v).bit_length() for v in range(-most if signed else 0, most + 1)])
    base = math.ceil(width * math.log2((2.0**-bits).sum()))
    return Book(book, base + sum(np.ix_(*(bits,) * width)), signed)


def ruled_books() -> list[Book]:
    """All eleven, in order: steep ones of odd numbers but the last, flat ones of even numbers."""
    return [ruled_book(b, 2 if b % 2 and b != ESCAPE_BOOK else 1) for b in SHAPES]


def checked_offsets(offsets: Sequence[int], lines: int) -> np.ndarray:
    """Borders from 0 to the number of lines, each after the one before by an even number; raises on others."""
    at = np.asarray(offsets, np.int64)
    if len(at) < 2 or at[0] != 0 or at[-1] != lines or (np.diff(at) <= 0).any():
        raise ValueError("borders go up from 0 to the number of lines")
    if (np.diff(at) % 2).any():
        raise ValueError("bands hold an even number of lines")
    return at


def band_costs(q: np.ndarray, offsets: np.ndarray, book: Book) -> np.ndarray:
    """Bits of each band of each row under a book; -1 where it can't hold the band, by size, width or magnitude."""
    size, widths = np.abs(q), np.diff(offsets)
    tops = np.maximum.reduceat(size, offsets[:-1], axis=1)
    limit = MOST if book.book == ESCAPE_BOOK else book.most
    fits = (tops <= limit) & (widths % book.width == 0)
    held = np.flatnonzero(widths % book.width == 0)
    bits = np.full(tops.shape, -1, np.int64)
    if not len(held) or not len(q):
        return bits
    firsts = np.concatenate([np.arange(offsets[b], offsets[b + 1], book.width) for b in held])
    starts = np.append(0, np.cumsum(widths[held] // book.width)[:-1])
    capped = np.clip(q, -book.most, book.most)
    places = tuple((capped[:, firsts + k] + book.most) if book.signed else np.abs(capped[:, firsts + k]) for k in range(book.width))
    cost = np.asarray(book.lengths)[places].astype(np.int64)
    for k in range(book.width):
        magnitude = np.minimum(size[:, firsts + k], MOST)
        if not book.signed:
            cost += magnitude > 0
        if book.book == ESCAPE_BOOK:
            cost += np.where(magnitude >= ESCAPE, 2 * np.frexp(magnitude.astype(float))[1] - 5, 0)
    bits[:, held] = np.add.reduceat(cost, starts, axis=1)
    return np.where(fits, bits, -1)


def cheapest_books(q: np.ndarray, offsets: np.ndarray, books: Sequence[Book]) -> tuple[np.ndarray, np.ndarray]:
    """Book and bits of each band, the first of equal ones in the order given; 0 and 0 for silence, -1 and -1 where no book holds it."""
    most = np.iinfo(np.int64).max
    best, found = np.full((len(q), len(offsets) - 1), most), np.full((len(q), len(offsets) - 1), -1)
    for book in books:
        bits = band_costs(q, offsets, book)
        better = (bits >= 0) & (bits < best)
        best, found = np.where(better, bits, best), np.where(better, book.book, found)
    silent = np.maximum.reduceat(np.abs(q), offsets[:-1], axis=1) == 0
    return np.where(silent, 0, found), np.where(silent, 0, np.where(best == most, -1, best))


def band_books(df: DataFrame, column: str, offsets: Sequence[int], books: Sequence[Book]) -> DataFrame:
    """Adds ``codebooks`` and ``bits``, arrays by band, in place of an array of quantised lines.

    A band that no book holds, as one with a magnitude over 8191 or with a null, has -1 in
    both; rows whose array is null or of another length get nulls.
    """
    lines = int(offsets[-1])
    at = checked_offsets(offsets, lines)

    def run(values: np.ndarray) -> dict[str, np.ndarray]:
        q = np.where(np.abs(values) <= MOST, values, MOST + 1).astype(np.int64)
        codebooks, bits = cheapest_books(q, at, books)
        return {"codebooks": codebooks, "bits": bits}

    return by_rows(df, column, lines, {"codebooks": "array<bigint>", "bits": "array<bigint>"}, run)


def sections(codebooks: Column, bits: Column, offsets: Sequence[int], field: int = 5) -> Column:
    """Neighbouring bands of one book: array of line_start, line_end, codebook, bits and header_bits; null if a band has no book.

    A header takes four bits and as many fields of ``field`` bits as its bands need, a full
    field asking for one more: fields are of five bits for long blocks and of three for short.
    """
    n, full = len(offsets) - 1, (1 << field) - 1
    line = F.lit([int(o) for o in offsets])

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == 0) | (F.get(s["c"], i) != F.get(s["c"], F.greatest(i - 1, F.lit(0)))))

        def one(b: Column, e: Column) -> Column:
            return F.struct(
                F.get(line, b).cast("long").alias("line_start"), F.get(line, e).cast("long").alias("line_end"), F.get(s["c"], b).cast("long").alias("codebook"),
                F.aggregate(F.slice(s["b"], b + 1, e - b), F.lit(0).cast("long"), lambda t, v: t + v).alias("bits"), (4 + field * (F.floor((e - b) / full) + 1)).cast("long").alias("header_bits"),
            )

        return pcm.let(starts, lambda a: F.transform(a, lambda b, j: one(b, F.coalesce(F.get(a, j + 1), F.lit(n)))))

    whole = (F.size(codebooks) == n) & F.forall(codebooks, lambda c: c >= 0)
    return F.when(whole, pcm.let(F.struct(codebooks.alias("c"), bits.alias("b")), of))
