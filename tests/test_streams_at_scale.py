"""Scans by blocks and layouts by borders, against loops over single streams."""

import random
import re

import numpy as np
import pytest

from cadenza.operators import layout, rate, scan


@pytest.fixture
def small_batches(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_compose():
    rng = np.random.default_rng(1)
    add, low = rng.integers(-9, 9, 200), rng.integers(-5, 3, 200)
    high = low + rng.integers(0, 9, 200)
    fresh = rng.random(200) < 0.1
    fresh[0] = True
    found = scan.composed((add, low, high), fresh)
    for x in (-20, -1, 0, 4, 30):
        for k in range(200):
            state = x
            for j in range(max(i for i in range(k + 1) if fresh[i]), k + 1):
                state = min(max(state + add[j], low[j]), high[j])
            assert min(max(x + found[0][k], found[1][k]), found[2][k]) == state


def streams():
    rnd = random.Random(3)
    return [(key, i, rnd.choice([0, 50, 90, 100, 110, 300]), rnd.choice([None, 8, 700, 900])) for key in ("a", "b", "c", None) for i in range({"a": 95, "b": 1, "c": 10, None: 31}[key])]


def lent(rows, capacity, most):
    left, out = 0, {}
    for key, i, p, t in rows:
        left = 0 if i == 0 else left
        begin = min(left, most)
        whole = begin + capacity
        aim = None if t is None else max(min((t + 7) // 8, whole), 1)
        targeted = aim is not None and p <= aim
        budget = aim if targeted else whole
        left = whole - min(p, budget)
        out[key, i] = (begin, budget, min(p, budget), left, p > budget, targeted)
    return out


def test_reservoir_by_blocks(spark, small_batches):
    rows = streams()
    df = spark.createDataFrame(rows, "stream string, i long, bytes long, target long").repartition(5)
    for target in (None, "target"):
        found = rate.reservoir(df, "stream", "i", "bytes", 100, 120, target)
        got = {(r["stream"], r["i"]): tuple(r)[2:] for r in found.collect()}
        assert got == lent([(*r[:3], r[3] if target else None) for r in rows], 100, 120)


def test_a_stream_is_many_tasks(spark, small_batches):
    df = spark.range(100).selectExpr("1L AS stream", "id AS i", "90L AS bytes")
    plan = rate.reservoir(df, "stream", "i", "bytes", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_key" in plan and "_block" in plan
    assert [r["reservoir_after"] for r in rate.reservoir(df, "stream", "i", "bytes", 100).orderBy("i").collect()] == [min(10 * i, 511) + 10 for i in range(100)]


def test_no_frames(spark):
    assert rate.reservoir(spark.createDataFrame([], "stream long, i long, bytes long"), "stream", "i", "bytes", 100).collect() == []


def test_pieces_cover_payloads(spark):
    rnd = random.Random(5)
    rows = []
    for key in ("a", "b"):
        lead = 0
        for i in range(40):
            slot = rnd.choice([100, 101, 57])
            begin = min(lead, 80)
            used = rnd.choice([0, 3, begin + slot, min(begin + slot, 60)])
            lead = begin + slot - used
            rows.append((key, i, slot, begin, used))
    df = spark.createDataFrame(rows, "stream string, i long, size long, begin long, used long").repartition(3)
    pieces = layout.reservoir_pieces(df, "stream", "i", "size", "begin", "used").collect()
    want = []
    for key in ("a", "b"):
        own = [r for r in rows if r[0] == key]
        at = [sum(r[2] for r in own[:k]) for k in range(len(own))]
        for (_, i, _, begin, used), place in zip(own, at, strict=True):
            for (_, j, size, *_), slot in zip(own, at, strict=True):
                a, b = max(place - begin, slot), min(place - begin + used, slot + size)
                if a < b:
                    want.append((key, i, j, a - place + begin, a - slot, b - a))
    assert sorted(tuple(r) for r in pieces) == sorted(want)
    assert sum(r["length"] for r in pieces) == sum(r[4] for r in rows)


def test_parts_grow_with_stored_bytes(spark, monkeypatch, tmp_path):
    """Sorts of a task stay as they are when the table grows: more bytes, more parts, in all shuffles of the layout."""
    from cadenza.plans import rate as plans

    for n in (1, 3):
        path = f"{tmp_path}/{n}"
        lines = spark.range(4000 * n).selectExpr("id div 5 AS l_orderkey", "id % 5 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "cast(id % 50 AS double) AS l_quantity", "1.0D AS l_extendedprice", "cast('2020-01-01' AS date) AS l_shipdate", "0.0D AS l_discount", "0.0D AS l_tax")
        lines.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    usual = {n: plans.reservoir_layout(spark, f"{tmp_path}/{n}") for n in (1, 3)}
    monkeypatch.setattr(scan, "PART_BYTES", 1 << 10)
    shuffles = {}
    for n in (1, 3):
        df = plans.reservoir_layout(spark, f"{tmp_path}/{n}")
        found = {int(x) for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION", df._jdf.queryExecution().executedPlan().toString())}
        shuffles[n] = min(found)
        assert sorted(df.collect()) == sorted(usual[n].collect())
    assert shuffles[1] > 4 and shuffles[3] > 2 * shuffles[1]
