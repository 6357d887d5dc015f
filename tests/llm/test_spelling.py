"""Spelling variants against brute force over all pairs, with edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def words_of(rows):
    out = collections.Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute(words):
    best, out = {}, []
    for w in words:
        near = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        best[w] = (form if form is not None and words[form] >= 10 * words[w] else None, len(near))
    for w in words:
        root = w
        while best[root][0] is not None:
            root = best[root][0]
        form, many = best[w]
        out.append((w, form, root, words[w], many, words[form] if form is not None else None))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("aeéstrnÀ×") for _ in range(rnd.randint(6, 10))) for _ in range(25)] + ["aaaaaaaa", "b" * 3000]
    rows = []
    for k in range(120):
        picks = []
        for _ in range(60):
            w = stems[int(rnd.random() ** 3 * len(stems))]
            if rnd.random() < 0.12:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "e", "é", w[at] + w[at]]) + w[at + 1 :]
            picks.append(w.title() if rnd.random() < 0.1 else w)
        rows.append((k, " ".join(picks)))
    rows += [(7, rows[7][1]), (None, rows[3][1]), (1, None), (2, ""), (3, "Abcdefgh1abcdefgh_ABCDEFGH ŁbcdefghŁ"), (4, "abcdefgh " * 200), (5, ("bbcdefgh " * 15 + "bbcdefgi ") * 2)]
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, 1, "n", "w") for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, n string, word string").repartition(5)
    return sorted((tuple(r) for r in spelling.variants(spelling.vocabulary(docs)).collect()), key=str)


def test_all_pairs(found):
    words = words_of(corpus())
    assert found == brute(words)
    assert sum(r[1] is not None for r in found) > 20


def test_small_chunks(spark, monkeypatch):
    """Blocks of many chunks, products of few visitors."""
    monkeypatch.setattr(spelling, "CHUNK", 3)
    monkeypatch.setattr(spelling, "VISITORS", 4)
    rnd = random.Random(8)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 8))): rnd.choice([2, 3, 40, 500]) for _ in range(250)}
    table = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in words.items()], "word binary, n long")
    got = sorted((tuple(r) for r in spelling.variants(table).collect()), key=str)
    assert got == brute(words)
    assert any(r[2] != r[1] for r in got if r[1] is not None)  # a form that has one itself


def test_edits():
    rnd = random.Random(9)
    words = [w for n in (5, 6) for w in {"".join(rnd.choice("abc") for _ in range(n)) for _ in range(80)}]
    lists = {n: spelling._Words(*(np.array(x) for x in ([list(w.encode()) for w in words if len(w) == n], [1] * sum(len(w) == n for w in words)))) for n in (5, 6)}
    for a, b in ((6, 6), (6, 5), (5, 6)):
        x, y = [w for w in words if len(w) == a], [w for w in words if len(w) == b]
        if a < b:
            continue
        i, j = spelling.near(lists[a], lists[b])
        want = {(k, m) for k, u in enumerate(x) for m, v in enumerate(y) if one_edit(u, v) and u != v}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []
    lone = spark.createDataFrame([("x", "longword longword")], "doc_id string, text string")
    assert [tuple(r) for r in spelling.variants(spelling.vocabulary(lone)).collect()] == [("longword", None, "longword", 2, 0, None)]
