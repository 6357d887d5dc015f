"""Standard codebooks: costs value by value, order of ties, widths, edges, checks of books and borders, sections."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.operators import bandcodes as B

BOOKS = B.ruled_books()


def cost(band, book):
    """Bits of a band, tuple by tuple; None where the book can't hold it."""
    if len(band) % book.width:
        return None
    total = 0
    for k in range(0, len(band), book.width):
        for v in band[k : k + book.width]:
            if abs(v) > (8191 if book.book == 11 else book.most):
                return None
        name = [min(abs(v), 16) if not book.signed else v + book.most for v in band[k : k + book.width]]
        total += int(book.lengths[tuple(name)])
        for v in band[k : k + book.width]:
            total += int(v != 0 and not book.signed)
            if book.book == 11 and abs(v) >= 16:
                ones = abs(v).bit_length() - 5
                total += ones + 1 + ones + 4
    return total


def plain(row, offsets, books):
    out = []
    for a, b in itertools.pairwise(offsets):
        band, best = row[a:b], None
        if not any(band):
            out.append((0, 0))
            continue
        for book in books:
            bits = cost(band, book)
            if bits is not None and (best is None or bits < best[1]):
                best = (book.book, bits)
        out.append(best or (-1, -1))
    return out


tops = st.sampled_from([0, 1, 2, 4, 7, 12, 15, 16, 17, 8191, 8192])
rows = st.lists(st.lists(tops, min_size=5, max_size=5), min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(rows, st.integers(0, 2**31), st.permutations(range(13)))
def test_books_as_value_by_value(shapes, seed, order):
    offsets, rng = (0, 4, 10, 12, 20, 26), np.random.default_rng(seed)
    q = np.array([np.concatenate([rng.integers(-t, t + 1, b - a) for t, (a, b) in zip(s, itertools.pairwise(offsets), strict=True)]) for s in shapes])
    books = [[*BOOKS, B.ruled_book(5, 2, False), B.ruled_book(6, 1, False)][k] for k in order]
    ids, bits = B.cheapest_books(q, np.array(offsets), books)
    for i, row in enumerate(q.tolist()):
        assert list(zip(ids[i].tolist(), bits[i].tolist(), strict=True)) == plain(row, offsets, books)


def test_by_hand():
    flat = [B.Book(b, np.full(((2 * m + 1) if s else m + 1,) * w, 9), s) for b, (w, m, s) in B.SHAPES.items()]
    ids, bits = B.cheapest_books(np.array([[1, 0, -1, 0, 2, 0, 0, 0, 40, -16]]), np.array([0, 4, 8, 10]), flat)
    # a signed quad is 9 bits; an unsigned one 9 and a sign; escapes of 40 and 16: 2 * 5 - 3 and 2 * 4 - 3, and two signs
    assert ids.tolist() == [[1, 3, 11]] and bits.tolist() == [[9, 10, 9 + 2 + 7 + 5]]


def test_ruled_books_are_prefix_codes_of_every_shape():
    assert [b.book for b in BOOKS] == list(range(1, 12))
    for b in BOOKS:
        assert 0.5 < (2.0 ** -np.asarray(b.lengths, float)).sum() <= 1


@pytest.mark.parametrize(
    ("book", "lengths", "signed"),
    [(12, np.full((8, 8), 9), False), (7, np.full((9, 9), 9), False), (7, np.full((8, 8), 5), False), (7, np.full((8, 8), 33), False), (7, np.full((8, 8), 0), False), (7, np.full((8, 8), 9.0), False), (5, np.full((5, 5), 9), True)],
)
def test_books_are_checked(book, lengths, signed):
    with pytest.raises(ValueError):
        B.Book(book, lengths, signed)


@pytest.mark.parametrize("offsets", [(0,), (2, 4), (0, 4, 4, 8), (0, 8, 4), (0, 3, 8), (0, 4, 6)])
def test_borders_are_checked(offsets):
    with pytest.raises(ValueError):
        B.checked_offsets(offsets, 8)


def test_sections_and_edges(spark):
    rng = np.random.default_rng(3)
    q = [rng.integers(-t, t + 1, 128).tolist() for t in (0, 1, 2, 4, 30, 8191) for _ in range(4)]
    mixed = [np.repeat(rng.choice([0, 1, 3, 9, 20], 32), 4).tolist() for _ in range(20)]
    odd = [None, [1] * 127, [], [9000] + [0] * 127, [None] + [1] * 127]
    df = spark.createDataFrame(list(enumerate(q + mixed + odd)), "id long, q array<long>")
    got = {r.id: r for r in B.band_books(df, "q", B.SHORT, BOOKS).withColumn("s", B.sections(F.col("codebooks"), F.col("bits"), B.SHORT, 3)).collect()}
    assert len(got) == len(df.collect())
    for i, row in enumerate(q + mixed):
        best = plain(row, B.SHORT, BOOKS)
        assert list(zip(got[i].codebooks, got[i].bits, strict=True)) == best
        made, k = [], 0
        for book, run in itertools.groupby(best, key=lambda b: b[0]):
            run = list(run)
            made.append((B.SHORT[k], B.SHORT[k + len(run)], book, sum(b for _, b in run), 4 + 3 * (len(run) // 7 + 1)))
            k += len(run)
        assert [tuple(s) for s in got[i].s] == made
    first = len(q + mixed)
    assert all(got[first + k][1:] == (None, None, None) for k in range(3))
    for k in (3, 4):
        assert (got[first + k].codebooks[0], got[first + k].bits[0], got[first + k].s) == (-1, -1, None)
    assert B.band_books(df.limit(0), "q", B.SHORT, BOOKS).count() == 0
