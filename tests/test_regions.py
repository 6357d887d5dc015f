"""Code tables, borders and steps against direct search."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import regions as R

TABLES = R.ruled_tables()


def region_cost(pairs):
    """(bits, order) of the cheapest table of a region, by going through all of them."""
    top = max((max(abs(a), abs(b)) for a, b in pairs), default=0)
    if not top:
        return 0, 0, 0
    found = []
    for k, t in enumerate(TABLES):
        if not t.suffixed and top > t.most:
            continue
        table, more = t.table, 0
        if t.suffixed:
            need = max(0, top - 15).bit_length()
            step = next(s for s, bits in enumerate(R.SUFFIX[t.table]) if bits >= need)
            table, more = t.table + step, R.SUFFIX[t.table][step]
        bits = 0
        for pair in pairs:
            x, y = (min(abs(v), t.most) for v in pair)
            bits += t.lengths[x][y] + sum(v != 0 for v in pair) + more * sum(abs(v) >= 15 for v in pair)
        found.append((bits, k, table, more if t.suffixed else 0))
    bits, _, table, more = min(found)
    return table, more, bits


def parts(row):
    last = max((k + 1 for k, v in enumerate(row) if v), default=0)
    start = last
    while start >= 4 and max(abs(v) for v in row[start - 4 : start]) <= 1:
        start -= 4
    big = -(-start // 2)
    return big, (last - start) // 4, [tuple(row[2 * k : 2 * k + 2]) for k in range(big)]


def spectra(n=40, lines=64):
    rng = np.random.default_rng(3)
    slope = np.linspace(5, 0, lines) * rng.uniform(0, 2, (n, 1))
    q = np.round(rng.normal(size=(n, lines)) * np.exp(slope - 2)).astype(np.int64)
    q[0], q[1, :] = 0, 1
    q[2, 3:] = 0
    q[3, 0] = 8191
    q[4, -1] = 1
    return q


EDGES = (0, 4, 8, 12, 20, 40, 64)


def test_tables_of_regions():
    q = spectra()
    c = R.costs(q, EDGES, TABLES)
    for i, j in itertools.combinations(range(len(EDGES)), 2):
        table, more, bits = R.cheapest_table(c, TABLES, i, j)
        for r, row in enumerate(q.tolist()):
            big, quads, pairs = parts(row)
            assert (c.big_pairs[r], c.quads[r]) == (big, quads)
            assert (table[r], more[r], bits[r]) == region_cost(pairs[EDGES[i] // 2 : EDGES[j] // 2])


def test_quads():
    q = spectra()
    c = R.costs(q, EDGES, TABLES)
    for r, row in enumerate(q.tolist()):
        big, quads, _ = parts(row)
        groups = [(row + [0] * 4)[2 * big + 4 * k : 2 * big + 4 * k + 4] for k in range(quads)]
        for t in range(2):
            assert c.count1[r, t] == sum(R.QUADS[t][int("".join(str(abs(v)) for v in g), 2)] + sum(map(abs, g)) for g in groups)


def test_borders():
    q = spectra(12)
    first, second, bits = R.cheapest_borders(R.costs(q, EDGES, TABLES), TABLES, (3, 2))
    for r, row in enumerate(q.tolist()):
        pairs = parts(row)[2]
        cost = lambda a, b: region_cost(pairs[EDGES[a] // 2 : EDGES[b] // 2])[2]  # noqa: E731, B023
        want = min((cost(0, i) + cost(i, j) + cost(j, 6), i - 1, j - i - 1) for i in (1, 2, 3) for j in range(i + 1, min(i + 2, 6) + 1))
        assert (bits[r], first[r], second[r]) == want


def test_unfit_and_known_costs():
    q = np.zeros((3, 64), np.int64)
    q[0, 0], q[1, 0], q[2, 0] = 9000, 2, -20
    c = R.costs(q, EDGES, TABLES)
    assert c.fits.tolist() == [False, True, True]
    # Magnitude 2 under table 2: 1 + 0 + 4 * 2 // 2 + 2 bits, and a sign; 20 under table 24: 1 + 2 + 2 * 4 // 2 + 4, four of suffix, and a sign.
    assert [x.tolist() for x in R.cheapest_table(c, TABLES, 0, 1)] == [[0, 2, 24], [0, 0, 4], [0, 8, 16]]
    assert R.payload_bits(q, EDGES, TABLES).tolist() == [-1, 8, 16]


def test_steps():
    rng = np.random.default_rng(5)
    lines = rng.normal(size=(30, 64)) * np.exp(rng.normal(size=(30, 1)) * 3)
    steps, budget = [0.9, 0.05, 0.2, 0.4, 0.1, 3.0], rng.integers(1, 500, 30)
    price = lambda q: R.payload_bits(q, EDGES, TABLES)
    step, bits, rounds = R.finest_fitting(lines, budget, steps, price)
    for r in range(30):
        full = [(s, int(price(R.quantised(lines[[r]], s))[0])) for s in sorted(steps)]
        fit = [(s, b) for s, b in full if 0 <= b <= budget[r]]
        assert (step[r], bits[r]) == (fit[0] if fit else (0, -1))
        assert rounds[r] == (full.index(fit[0]) + 1 if fit else len(steps))


def test_rows_of_tables(spark):
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(spectra(9).tolist())] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "name long, lines array<double>")
    found = R.by_rows(df, "lines", 64, {"bits": "bigint", "both": "array<bigint>"}, lambda q: {"bits": R.payload_bits(q.astype(np.int64), EDGES, TABLES), "both": q[:, :2].astype(np.int64)})
    got = {r["name"]: (r["bits"], r["both"]) for r in found.collect()}
    want = R.payload_bits(spectra(9), EDGES, TABLES)
    assert got == {**{k: (int(want[k]), spectra(9)[k, :2].tolist()) for k in range(9)}, 100: (None, None), 101: (None, None)}
    assert found.where(F.col("bits") < 0).count() == 0


def test_numbers():
    assert len(TABLES) == 15 and [t.table for t in TABLES][-2:] == [16, 24]
    with pytest.raises(IndexError):
        R.costs(np.zeros((1, 8), np.int64), (0, 8), TABLES, ((1,),)).count1[0, 1]
