"""Conversation repair against all lists of edits, with edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import turns

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    """Least (cost, letters, lines) of all edits of (role, text, remove, truncated) with up to two insertions at a place."""
    inserts = [list(x) for n in range(3) for x in itertools.product(["user", "assistant"], repeat=n)]
    best = None
    for places in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
            cost, letters, lines, roles = 0, "", [], ""
            for k, ahead in enumerate(places):
                for role in ahead:
                    cost, letters, roles = cost + 2, letters + "I", roles + role[0]
                    lines.append(f"{role}:")
                if k == len(rows):
                    break
                role, text, remove, truncated = rows[k]
                letters += edits[k][0]
                if edits[k] == "D":
                    cost += 3
                    continue
                cost += (2 if edits[k] != "K" else 0) + truncated + (1000 if remove else 0)
                role = {"K": role, "Ru": "user", "Ra": "assistant"}[edits[k]]
                roles += role[:1] if role[:1] else "?"
                lines.append(f"{role}:{text}")
            if PATTERN.match(roles) and (best is None or (cost, letters) < best[:2]):
                best = cost, letters, lines
    return best


def run(rows):
    repair = turns.Repair()
    for row in rows:
        repair.read(*row)
    return repair.close()


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_edits(n):
    kinds = [(r, f"t{k}", d, t and not d) for k, r in enumerate(["user", "assistant", "system", "tool", ""]) for d in (False, True) for t in (False, True)]
    cases = list(itertools.product(kinds, repeat=n))
    for case in random.Random(1).sample(cases, min(60, len(cases))):
        cost, letters, lines = exhaustive(case)
        assert run(case) == (cost, letters, digest(lines)), case


def plain(rows):
    """The same optimum with strings in place of integers."""
    best = {0: (0, "")}
    for role, _, remove, truncated in rows:
        new = {}
        for (s, (cost, letters)), (a, b, c, ls, _) in itertools.product(best.items(), turns.MOVES[role[:1] if role[:1] in "sua" else "", remove, truncated]):
            if a == s:
                new[b] = min(new.get(b, (cost + c, letters + ls)), (cost + c, letters + ls))
        best = new
    return min((c + 2 * len(turns.CLOSING[s]), x + "I" * len(turns.CLOSING[s])) for s, (c, x) in best.items())


def test_long_conversations():
    rnd = random.Random(4)
    for n in (63, 64, 65, 200, 1000):
        rows = [(rnd.choice(["user", "assistant", "system", "x"]), str(k), rnd.random() < 0.2, rnd.random() < 0.3) for k in range(n)]
        cost, letters, _ = run(rows)
        assert (cost, letters) == plain(rows)
        assert sum(x != "I" for x in letters) == n


SCHEMA = "conv_id long, turn int, role string, text string, _role string, part int"


def kind(conv, turn):
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    return zlib.crc32(key.encode()) % 20


def turn_of(wanted, conv, start=0):
    return next(t for t in itertools.count(start) if kind(conv, t) == wanted)


def test_damage(spark):
    rows = [(7, turn_of(k, 7), "assistant", " A. b! c? ", "x", 1) for k in range(6)] + [(None, None, None, None, "y", 2)]
    found = {(r["_conv"], r["_turn"], r["_gone"], r["_role"], r["_text"], n) for *_, r, n in ((x, x["count"]) for x in turns.damage(spark.createDataFrame(rows, SCHEMA)).groupBy("_conv", "_turn", "_gone", "_role", "_text").count().collect())}
    want = set()
    for k in range(6):
        want.add((7, turn_of(k, 7), k == 0, "user" if k == 4 else "assistant", "" if k == 1 else " A b c " if k == 2 else " A. b! c? ", 2 if k == 3 else 1))
    k = kind(None, None)
    want.add((None, None, k == 0, "user" if k == 4 else " ", "" if k == 1 else " ", 2 if k == 3 else 1))
    assert found == want


def by_hand(rows):
    """Counts and repair of undamaged (turn, role, text) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, given = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        given.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    t = [r[0] for r in rows if r[0] is not None]
    counts["gaps"] = max(t) - min(t) + 1 - len(set(t)) if t else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, sha = run(given)
    return {**counts, "cost": cost, "audit": audit, "repaired_sha256": sha}


def test_repair_of_tables(spark):
    rnd = random.Random(2)
    text = lambda: rnd.choice(["A.", "A. \n", "b", " \t", "", "Ü!", "x" * 5000 + "?", "c.\x85", "c.\n\x0b"])
    plain = [(c, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "", "tool"]), text(), "x", 1) for c in [None, 1, 2, 3, 4] for _ in range(rnd.randint(1, 30))]
    plain += [(9, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.", "x", 1) for k in range(400)]
    rows = [(*r[:4], False) for r in plain] + [(5, 1, "user", "gone", True)]
    damaged = spark.createDataFrame(rows, "_conv long, _turn int, _role string, _text string, _gone boolean").repartition(3)
    found = {r["conv_id"]: r.asDict() for r in turns.repair(damaged).collect()}
    assert set(found) == {None, 1, 2, 3, 4, 5, 9}
    for c in found:
        want = by_hand([r[1:4] for r in plain if r[0] == c])
        assert found[c] == {"conv_id": c, **want}
    assert found[5] == {"conv_id": 5, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": digest([])}
    assert found[9]["audit"] == "K" * 400


def test_no_rows(spark):
    assert turns.repair(turns.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    named = spark.createDataFrame([("a", 1.0, "user", "Hm.")], "conv_id string, turn double, role string, text string")
    assert turns.repair(turns.damage(named)).select(F.col("conv_id")).first()[0] == "a"
