"""Repair of the turn structure of conversations by scalar big-integer weights.

A conversation is its rows in order of turn (nulls first), role and text.  Its
repair is the cheapest list of edits (Keep, Rerole, Delete, Insert) after which
the initials of its roles are ``(s?(ua)+)?``; of equally cheap lists the one whose
letters are the ASCII-least string is taken.

How it is decided: every path through the graph of (rows read, state of the
pattern) has one integer as its weight.  The high digits are the cost; below them
lie ``WIDTH`` digits of fixed size, in which the n-th letter has the n-th place, and
the places after the last letter are zeros.  Weights of edges are added, and the
smaller integer wins at every node, which settles cost and ties alike.  A row is one
edge: what is inserted before it, then what happens to it.  So no path is a prefix of
another that has read the same rows, and the order of two paths to a node stays as it
is whatever follows.  After ``BLOCK`` rows the letters of the paths that live are put
away, and their rank becomes the first digit of the next block; numbers stay small in
conversations of any length.  Each living path also carries the running hash of the
conversation it has repaired.

How it runs: one shuffle by conversation, sorted by Spark, then one pass over the
sorted rows that holds a row, four weights, the letters and four hashes at a time, so a
conversation of any number of rows needs little memory.  It is one task's, as the hash
of its text is one sequence of bytes by definition; the others are dealt elsewhere.

Edge cases: null roles, texts, ids and turns count as one space where they are written
(as text, or in the key of the damage); rows with a null id are one conversation; roles
other than user, assistant and system can't be kept; repeated rows are duplicates; rows
of equal turn are taken by role, then text; texts and conversations may be of any length;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
BITS = 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing written, system, user, assistant.  What may be written next, and where it leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Digits of a block: rank, then up to three letters for each row.
WIDTH = 1 + 3 * BLOCK

_PLAIN = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """_conv, _turn, _role, _text, _gone: rows after the damage that the checksum of ``conv_id:turn`` prescribes.

    Dropped rows stay, marked as gone, so that their conversations are known.
    """
    space = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(F.col("text")), "[.!?]", "")).otherwise(space(F.col("text")))
    role = F.when(kind == 4, "user").otherwise(space(F.col("role")))
    out = rows.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"), (kind == 0).alias("_gone"), F.when(kind == 3, 2).otherwise(1).alias("_copies"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copy", "_copies")


def faults() -> tuple[Column, Column, Column]:
    """Whether a row is blank, whether it repeats the one before it, and whether its text breaks off."""
    repeats = Window.partitionBy("_conv", "_gone", "_role", "_text").orderBy("_turn")
    last = F.regexp_extract("_text", rf"({_PLAIN})[\x20\x09-\x0D]*\z", 1)
    return last == "", F.row_number().over(repeats) > 1, ~last.isin(".", "!", "?")


def _moves(initial: str, remove: bool, truncated: bool) -> list[tuple[int, int, int, str, str]]:
    """(from, to, cost, letters, initials written) of the least edge between each two states over one row."""
    found: dict[tuple[int, int], tuple[int, str, str]] = {}
    for start in range(4):
        state, written = start, ""
        for n in range(3):  # a third insertion leads where the first did
            before, ahead = INSERT * n, "I" * n
            edges = [(state, DELETE, "D", "")]
            if not remove:
                if initial in NEXT[state]:
                    edges.append((NEXT[state][initial], KEEP + TRUNCATED * truncated, "K", initial))
                role = next(r for r in NEXT[state] if r in ROLES)
                edges.append((NEXT[state][role], REROLE + TRUNCATED * truncated, "R", role))
            for to, cost, letter, role in edges:
                edge = (before + cost, ahead + letter, written + role)
                found[start, to] = min(found.get((start, to), edge), edge)
            role = next(r for r in NEXT[state] if r in ROLES)
            state, written = NEXT[state][role], written + role
    return [(a, b, *edge) for (a, b), edge in found.items()]


#: Edges by (initial, to be deleted, truncated); initials that no pattern holds are "".
MOVES = {(i, r, t): _moves(i, r, t) for i in ("s", "u", "a", "") for r in (False, True) for t in (False, True)}
#: Insertions that end the pattern, by state.
CLOSING = {0: "", 1: "ua", 2: "a", 3: ""}


class Repair:
    """The living paths of one conversation: weights, letters put away, and hashes of what they have written."""

    def __init__(self) -> None:
        self.weights: dict[int, int] = {0: 0}
        self.lengths: dict[int, int] = {0: 1}
        self.letters: dict[int, tuple] = {0: ()}
        self.tails: dict[int, str] = {0: ""}
        self.hashes = {0: (hashlib.sha256(), False)}
        self.rows = 0

    @staticmethod
    def _written(state: tuple, initials: str, row: tuple[str, str] | None) -> tuple:
        """The hash after inserted roles, of which the last is the row's own if there is one."""
        h, any_before = state
        if not initials:
            return state
        h = h.copy()
        lines = [f"{ROLES[i]}:" for i in (initials if row is None else initials[:-1])]
        if row is not None:
            lines.append(f"{row[0]}:{row[1]}")
        h.update((("\n" if any_before else "") + "\n".join(lines)).encode())
        return h, True

    def read(self, role: str, text: str, remove: bool, truncated: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        best: dict[int, tuple[int, int, int, str, str]] = {}
        for start, to, cost, letters, initials in MOVES[initial, remove, truncated]:
            if start in self.weights:
                weight, at = self.weights[start] + (cost << BITS * WIDTH), self.lengths[start]
                for k, letter in enumerate(letters):
                    weight += LETTERS[letter] << BITS * (WIDTH - 1 - at - k)
                if to not in best or weight < best[to][0]:
                    best[to] = weight, start, at + len(letters), letters, initials
        hashes, tails, lists = {}, {}, {}
        for to, (_, start, _, letters, initials) in best.items():
            own = role if letters[-1] == "K" else ROLES.get(initials[-1:], "")
            hashes[to] = self._written(self.hashes[start], initials, (own, text) if letters[-1] != "D" else None)
            tails[to], lists[to] = self.tails[start] + letters, self.letters[start]
        self.weights = {to: b[0] for to, b in best.items()}
        self.lengths = {to: b[2] for to, b in best.items()}
        self.hashes, self.tails, self.letters = hashes, tails, lists
        self.rows += 1
        if self.rows % BLOCK == 0:
            self._put_away()

    def _put_away(self) -> None:
        """Ranks the letters of the paths, and starts a block with the ranks as first digits."""
        low = (1 << BITS * WIDTH) - 1
        rank = {digits: k for k, digits in enumerate(sorted({w & low for w in self.weights.values()}))}
        self.weights = {s: (w >> BITS * WIDTH << BITS * WIDTH) + (rank[w & low] << BITS * (WIDTH - 1)) for s, w in self.weights.items()}
        self.letters = {s: (self.letters[s], self.tails[s]) for s in self.weights}
        self.tails, self.lengths = dict.fromkeys(self.weights, ""), dict.fromkeys(self.weights, 1)

    def close(self) -> tuple[int, str, str]:
        """Cost, letters and the hash of the repaired conversation."""
        ends = {}
        for s, weight in self.weights.items():
            letters = "I" * len(CLOSING[s])
            weight += INSERT * len(letters) << BITS * WIDTH
            for k, letter in enumerate(letters):
                weight += LETTERS[letter] << BITS * (WIDTH - 1 - self.lengths[s] - k)
            ends[weight] = s, letters
        weight = min(ends)
        s, letters = ends[weight]
        h, _ = self._written(self.hashes[s], CLOSING[s], None)
        parts, kept = [self.tails[s] + letters], self.letters[s]
        while kept:
            kept, part = kept
            parts.append(part)
        return weight >> BITS * WIDTH, "".join(reversed(parts)), h.hexdigest()


class _Tally:
    """Counts over the rows of one conversation, beside its repair."""

    def __init__(self) -> None:
        self.repair, self.before = Repair(), None
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def read(self, turn, role: str, text: str, gone: bool, blank: bool, repeat: bool, cut: bool) -> None:
        if gone:
            return
        if turn is not None and (self.last is None or turn != self.last):
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if blank:
            self.blank += 1
        elif repeat:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self.repair.read(role, text, blank or repeat, cut and not (blank or repeat))

    def row(self, conv) -> dict:
        gaps = int(self.last - self.first) + 1 - self.turns if self.turns else 0
        cost, audit, digest = self.repair.close()
        return {"conv_id": conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _fold(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    rows: list[dict] = []
    tally, conv = None, None
    for batch in batches:
        for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tally is None or now != conv:
                if tally is not None:
                    rows.append(tally.row(conv))
                tally, conv = _Tally(), now
            tally.read(*row)
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if tally is not None:
        rows.append(tally.row(conv))
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def repair(damaged: DataFrame) -> DataFrame:
    """One row for each conversation of rows as ``damage`` gives them: its faults, and its cheapest repair."""
    rows = damaged.repartition("_conv")
    blank, repeat, cut = faults()
    rows = rows.select("*", blank.alias("_blank"), repeat.alias("_repeat"), cut.alias("_cut"))
    rows = rows.sortWithinPartitions(F.col("_conv"), F.col("_turn").asc_nulls_first(), "_role", "_text")
    rows = rows.select("_conv", "_turn", "_role", "_text", "_gone", "_blank", "_repeat", "_cut")

    def fold(batches):
        first = next(batches, None)
        if first is not None:
            yield from _fold((b for part in ([first], batches) for b in part), first.schema.field(0).type)

    kind = damaged.schema["_conv"].dataType.simpleString()
    return rows.mapInArrow(fold, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
