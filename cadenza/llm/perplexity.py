"""Quality by perplexity under an interpolated modified Kneser-Ney word model.

The model is learned from all trusted texts, whole: documents with quality label
1, but for those held back for the thresholds.  Trigrams are counted, then
bigrams and words by the number of their left neighbours (Chen and Goodman,
1998).  Every document is then scored whole, and kept if its perplexity is at
most the ``QUANTILE`` of the trusted documents of its language that the model was
not learned from, taken of counts by steps of ``GRAIN`` in its logarithm to base ten.

How it runs: batches of trusted texts send their distinct trigrams, packed, to
shards by context; these send bigrams on to shards by their own hash, and those words
to shards of their own.  Counts and context sums stay in buckets by the shards that
made them, as trigrams are looked up where their contexts are.  Documents are dealt to
parts, a part asks the shards about its distinct words, bigrams and trigrams, and the
answers are the part's own piece of the model.  Parts take turns in ``ROUNDS``, each of
which gives the disk of its shuffles back.  The driver sees sums by shard and order only.

Edge cases: null and empty texts have the end mark alone; a null language is one
of its own; a language without trusted documents takes the quantile of all; with
no trusted documents every document is kept, with perplexity over an empty
vocabulary; unlabelled rows don't train; repeated rows are each scored; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shards as S
from . import text as T

U64 = np.uint64
QUANTILE = 0.98
GRAIN = 0.001
#: Turns in which documents are scored, one for every ``ROUND_BYTES`` of stored input at most.
ROUNDS, ROUND_BYTES = 8, 8 << 20
#: Turns of shards in which n-grams of one order are counted, where documents are scored in several.
COUNT_TURNS = 3
START, END = U64(0x1111111111111111), U64(0x2222222222222222)


def _positions(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word and end mark: two words before it, itself, and the n + 1 offsets."""
    n = len(at) - 1
    size = np.diff(at) + 3
    bounds = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(int(bounds[-1]), START, U64)
    flat[bounds[1:] - 1] = END
    flat[T.ragged(bounds[:-1] + 2, np.diff(at))] = words
    place = T.ragged(bounds[:-1] + 2, size - 2)
    return flat[place - 2], flat[place - 1], flat[place], at + np.arange(n + 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix(a * U64(0x9E3779B97F4A7C15) + T.mix(b ^ U64(0x5851F42D4C957F2D)))


#: Bits of a key that say its shard.  A trigram has those of its context.
_PLACE = 16
_REST = U64((1 << 64 - _PLACE) - 1)


def _triple(u: np.ndarray, uv: np.ndarray, vw: np.ndarray) -> np.ndarray:
    return (uv & ~_REST) | (_pair(u, vw) & _REST)


def _by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted keys (the shard grows with the key)."""
    return np.searchsorted(((keys >> U64(64 - _PLACE)) * U64(shards)) >> U64(_PLACE), np.arange(shards + 1, dtype=U64))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of n-grams counted once, twice, and more often."""
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / max(1, n3)))]


class Sums:
    """Of all words, bigrams and trigrams: those counted 1 to 4 times, all, and the sum of their counts."""

    def __init__(self, sums: np.ndarray):
        self.discounts = np.array([[0.0, *_discounts(*row[:4].tolist())] for row in sums])
        n1, n2, _, _, self.vocabulary, self.total = sums[0].tolist()
        self.root = float(self.discounts[0, 1:] @ [n1, n2, self.vocabulary - n1 - n2] / self.total) if self.total else 1.0


@dataclass
class Model:
    """Sorted n-grams with their counts, and contexts with the sums of theirs: all, or those that a part asks about."""

    grams: list[tuple[np.ndarray, np.ndarray]]  # words, bigrams, trigrams
    contexts: list[tuple[np.ndarray, np.ndarray]]  # one word, two words: total, n-grams counted once, twice, more often
    sums: Sums

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys, which are found several times faster than others."""
        names, values = table
        if not len(names):
            return np.zeros((len(keys), *values.shape[1:]), np.int64)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        seen = names[at] == keys
        return values[at] * (seen[:, None] if values.ndim > 1 else seen)

    @classmethod
    def get(cls, table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(keys, return_inverse=True)
        return cls.look(table, distinct)[at]

    def _mix(self, order: int, keys: np.ndarray, context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        count, sums = self.get(self.grams[order], keys), self.get(self.contexts[order - 1], context)
        discounts, total = self.sums.discounts[order], np.maximum(1, sums[:, 0])
        rest = np.where(sums[:, 0] > 0, sums[:, 1:] @ discounts[1:] / total, 1.0)
        return (count - discounts[np.minimum(count, 3)]) / total + rest * shorter

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        count, sums = self.get(self.grams[0], w), self.sums
        p = (count - sums.discounts[0][np.minimum(count, 3)]) / max(1, sums.total) + sums.root / (sums.vocabulary + 1)
        vw, uv = _pair(v, w), _pair(u, v)
        return np.log10(self._mix(2, _triple(u, uv, vw), uv, self._mix(1, vw, v, p)))


#: Kinds of rows: counts by order and sums of contexts by their length.
GRAM, CONTEXT = 0, 10
#: What rows are: pieces of the model, sums by order, and trigrams, bigrams and words on their way to be counted.
MODEL, SUMS, ROUTES = "model", "sums", ("words", "bigrams", "trigrams")
#: ``home`` made a row, ``shard`` is to have it.
ROWS = pa.schema([("what", pa.string()), ("home", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
ROWS_SQL = "what string, home int, shard int, kind int, keys binary, vals binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return S.table(ROWS, **dict(zip(ROWS.names, map(list, zip(*rows, strict=True)) if rows else ([],) * 6, strict=True)))


def _ints(x: np.ndarray) -> bytes:
    """Numbers, or columns of numbers, packed."""
    return S.packed(np.ascontiguousarray(x.T).reshape(-1).astype(np.int64))


def _columns(raw: bytes, n: int) -> np.ndarray:
    return S.unpacked(raw).astype(np.int64).reshape(n, -1).T


def _routed(home: int, order: int, by: np.ndarray, words: list[np.ndarray], counts: np.ndarray, shards: int) -> list[tuple]:
    """N-grams with counts, for the shards of ``by``, as indices into the words of each row: the first as steps."""
    sort = np.argsort(by)
    at, out = _by_shard(by[sort], shards), []
    for k in np.flatnonzero(np.diff(at)):
        own = sort[at[k] : at[k + 1]]
        names, index = np.unique(np.concatenate([w[own] for w in words]), return_inverse=True)
        index = np.column_stack([*index.reshape(order, -1), counts[own]])
        index = index[np.argsort(index[:, 0])]
        index[1:, 0] = np.diff(index[:, 0])
        out.append((ROUTES[order - 1], home, int(k), order, S.packed(names), _ints(index)))
    return out


def _gathered(group: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    words, counts = [[] for _ in range(order)], []
    for names, index in zip(group["keys"], group["vals"], strict=True):
        names, index = S.unpacked(names.as_py()), _columns(index.as_py(), order + 1)
        words[0].append(names[np.cumsum(index[:, 0])])
        for k in range(1, order):
            words[k].append(names[index[:, k]])
        counts.append(index[:, order])
    return [np.concatenate(w) for w in words], np.concatenate(counts)


def _counted(key: np.ndarray, words: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in order, their words, and the sums of their counts."""
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, counts)
    return key, [w[first] for w in words], total


def _key(words: list[np.ndarray]) -> np.ndarray:
    """Of two or three words each."""
    last = _pair(words[-2], words[-1])
    return last if len(words) == 2 else _triple(words[0], _pair(words[0], words[1]), last)


def _totals(counts: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of n contexts: the sum of its n-grams' counts, and how many are counted once, twice, more often."""
    columns = [np.bincount(at, counts, n), *(np.bincount(at[np.minimum(counts, 3) == k], minlength=n) for k in (1, 2, 3))]
    return np.column_stack(columns).astype(np.int64)


def _count(shards: int, order: int):
    """Counts the n-grams that are routed to a shard, and routes what they end in."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        home = key[0].as_py()
        here = lambda kind, keys, values: (MODEL, home, home, kind, S.packed(keys), _ints(values))
        if order == 1:
            names, at = np.unique(np.concatenate([S.unpacked(x.as_py()) for x in group["keys"]]), return_inverse=True)
            values = np.concatenate([_columns(x.as_py(), 5) for x in group["vals"]])
            values = np.column_stack([np.bincount(at, x, len(names)) for x in values.T]).astype(np.int64)
            counts, first = values[:, 0], values[:, 1] > 0
            seen = counts > 0
            rows = [here(GRAM + 1, names[seen], counts[seen]), here(CONTEXT + 1, names[first], values[first, 1:])]
            counts = counts[seen]
        else:
            words, counts = _gathered(group, order)
            keys, words, counts = _counted(_key(words), words, counts)
            rows = [here(GRAM + order, keys, counts)]
        if order == 3:
            names, at = np.unique(_key(words[:2]), return_inverse=True)
            rows.append(here(CONTEXT + 2, names, _totals(counts, at, len(names))))
            ends, last, left = _counted(_key(words[1:]), words[1:], np.ones(len(keys), np.int64))
            rows += _routed(home, 2, ends, last, left, shards)
        if order == 2:  # of each word: those before it, and what follows it
            names, at = np.unique(np.concatenate(words), return_inverse=True)
            before, after = np.bincount(at[len(keys) :], minlength=len(names)), _totals(counts, at[: len(keys)], len(names))
            values, bounds = np.column_stack([before, after]), _by_shard(names, shards)
            rows += [(ROUTES[0], home, int(k), 1, S.packed(names[bounds[k] : bounds[k + 1]]), _ints(values[bounds[k] : bounds[k + 1]])) for k in np.flatnonzero(np.diff(bounds))]
        sums = np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), len(counts), counts.sum()], np.int64)
        return _rows([*rows, (SUMS, home, home, order, b"", S.blob(sums))])

    return run


def _rounds(docs: DataFrame) -> int:
    return max(1, min(ROUNDS, S.stored_bytes(docs) // ROUND_BYTES))


def count(docs: DataFrame, trusted: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Sums]:
    """Counts of the n-grams and contexts of all texts of the ids in ``trusted``, in buckets by shard, and their sums."""
    spark = docs.sparkSession
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(ids, "_id", "left_semi").select("text")

    def trigrams(batches):
        for batch in batches:
            parts = [_positions(words, at)[:3] for _, _, words, at in T.hashed(batch.column(0))]
            if parts:
                words = [np.concatenate(x) for x in zip(*parts, strict=True)]
                _, words, counts = _counted(_key(words), words, np.ones(len(words[0]), np.int64))
                yield from _rows(_routed(-1, 3, _key(words[:2]), words, counts, shards)).to_batches()

    turns = min(COUNT_TURNS, _rounds(docs))
    if turns > 1:
        with S.releasing(spark):
            texts = S.kept(texts)
    made, table = texts.mapInArrow(trigrams, ROWS_SQL), S.Buckets(spark, "what", "home", shards)
    for order in (3, 2, 1):
        for t in range(turns):
            with S.releasing(spark):
                table.add(made.where(F.col("shard") % turns == t).groupBy("shard").applyInArrow(_count(shards, order), ROWS_SQL))
        if order < 3:
            table.drop(ROUTES[order - 1])
        if order > 1:
            made = table.read(ROUTES[order - 2])
    sums = np.zeros((3, 6), np.int64)
    for r in table.read(SUMS).select("kind", "vals").toLocalIterator():  # one row for each shard and order
        sums[r["kind"] - 1] += np.frombuffer(r["vals"], np.int64)
    return table.read(MODEL).select("home", "kind", "keys", "vals"), Sums(sums)


def _tables(kinds: list[int], keys: list[bytes], values: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for kind in (GRAM + 1, GRAM + 2, GRAM + 3, CONTEXT + 1, CONTEXT + 2):
        mine = [r for r, k in enumerate(kinds) if k == kind]
        names = np.concatenate([np.zeros(0, U64), *(S.unpacked(keys[r]) for r in mine)])
        width = 4 if kind > CONTEXT else 1
        found = np.concatenate([np.zeros((0, width), np.int64), *(_columns(values[r], width) for r in mine)])
        order = np.argsort(names, kind="stable")
        out[kind] = names[order], (found if kind > CONTEXT else found[:, 0])[order]
    return out


def train(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The whole model at the driver, for small tables; ``score`` looks counts up at their shards instead."""
    counts, sums = count(docs, trusted, S.partitions(docs.sparkSession), id_col, text_col)
    rows = counts.collect()
    t = _tables(*([r[c] for r in rows] for c in ("kind", "keys", "vals")))
    return Model([t[GRAM + k] for k in (1, 2, 3)], [t[CONTEXT + k] for k in (1, 2)], sums)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order.  By sorting: the hash table of np.unique is far slower where most keys differ."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _asked(texts: pa.ChunkedArray) -> list[np.ndarray]:
    """Distinct words, bigrams and trigrams of the texts; contexts are among the first two."""
    found: list[list[np.ndarray]] = [[np.array([START])], [_pair(np.array([START]), np.array([START]))], []]
    for _, _, words, at in T.hashed(texts):
        u, v, w, _ = _positions(words, at)
        vw = _pair(v, w)
        for own, x in zip(found, (w, vw, _triple(u, _pair(u, v), vw)), strict=True):
            own.append(_distinct(x))
    return [_distinct(np.concatenate(x)) for x in found]


ASKED = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((f"x{k}", pa.binary()) for k in (1, 2, 3))])
ANSWERED = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((f"x{k}", pa.binary()) for k in (1, 2, 3)), *((f"c{k}", pa.binary()) for k in (1, 2))])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'int'}" for f in schema)


def score(docs: DataFrame, counts: DataFrame, sums: Sums, shards: int, rounds: int | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob and perplexity of docs with doc_id, lang and text, some parts after others."""
    rounds = _rounds(docs) if rounds is None else rounds
    rows = S.with_part(docs.select("doc_id", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), S.parts_for(docs), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys = _asked(group["text"])
        at = [_by_shard(x, shards) for x in keys]
        blobs = {f"x{n + 1}": [S.packed(x[b[k] : b[k + 1]]) for k in range(shards)] for n, (x, b) in enumerate(zip(keys, at, strict=True))}
        return S.table(ASKED, part=[key[0].as_py()] * shards, shard=list(range(shards)), **blobs)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _tables(*(right[c].to_pylist() for c in ("kind", "keys", "vals")))
        look = lambda kind, x: [_ints(Model.look(t[kind], S.unpacked(b.as_py()))) for b in left[x]]
        found = {f"x{k}": look(GRAM + k, f"x{k}") for k in (1, 2, 3)} | {f"c{k}": look(CONTEXT + k, f"x{k}") for k in (1, 2)}
        return S.table(ANSWERED, part=left["part"].combine_chunks(), shard=left["shard"].combine_chunks(), **found)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = _asked(left["text"])
        right = right.take(pc.sort_indices(right["shard"]))
        t = {c: np.concatenate([_columns(x.as_py(), 4 if c[0] == "c" else 1) for x in right[c]]) for c in ANSWERED.names[2:]}
        m = Model([(keys[k], t[f"x{k + 1}"][:, 0]) for k in range(3)], [(keys[k], t[f"c{k + 1}"]) for k in range(2)], sums)
        total, count = np.zeros(left.num_rows), np.zeros(left.num_rows, np.int64)
        for i, j, words, at in T.hashed(left["text"]):
            u, v, w, bounds = _positions(words, at)
            total[i:j] = np.add.reduceat(m.log10(u, v, w), bounds[:-1])
            count[i:j] = np.diff(bounds)
        return pa.table({"doc_id": left["doc_id"], "lang": left["lang"], "n_tokens": pa.array(count), "log10_prob": pa.array(total), "perplexity": pa.array(10 ** np.minimum(-total / np.maximum(count, 1), 300))})

    done = []
    for r in range(rounds):
        own = rows.where(F.col("part") % rounds == r)
        asked = own.groupBy("part").applyInArrow(ask, _sql(ASKED))
        answered = asked.groupBy("shard").cogroup(counts.groupBy("home")).applyInArrow(answer, _sql(ANSWERED))
        found = own.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(finish, f"doc_id {kind}, lang string, n_tokens long, log10_prob double, perplexity double")
        with S.releasing(docs.sparkSession):
            done.append(S.kept(found))
    return functools.reduce(DataFrame.unionByName, done)


def thresholds(scores: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """``threshold`` of each group: the least step of perplexity up to which at least that share of its rows lies.

    Rows are counted by step first, so that no task holds more of a group than one number
    for each step, of which there are 300 / GRAIN, and equal rows are one number.
    """
    step = F.ceil(F.log10("perplexity") / GRAIN)
    counts = scores.where("perplexity is not null").groupBy(*by, step.alias("step")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    sums = counts.withColumns({"below": F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(group)})
    return sums.where(F.col("below") >= quantile * F.col("all")).groupBy(*by).agg(F.pow(F.lit(10.0), F.min("step") * GRAIN).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, learn: Column | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold and keep, for every document.

    ``learn`` says which trusted rows the model is learned from; the others set the thresholds.
    """
    learn = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if learn is None else learn
    trusted = trusted.select("doc_id").where("doc_id is not null").distinct()
    shards = max(S.partitions(docs.sparkSession), S.parts_for(docs) // 2)
    counts, sums = count(docs, trusted.where(learn), shards)
    scores = score(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text"), counts, sums, shards)
    held = scores.join(trusted.where(~learn), "doc_id")
    marks = thresholds(held, ["lang"], quantile)
    overall = thresholds(held, [], quantile).agg(F.max("threshold")).first()[0]  # one row at most
    default = F.lit(float("inf") if overall is None else overall)
    out = scores.join(marks, "lang", "left").withColumn("threshold", F.coalesce("threshold", default))
    return out.select("doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("keep"))
