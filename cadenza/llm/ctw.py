"""Context-tree weighting language model of tokens, learned from all training documents.

A token is coded as its bytes and an end mark; the context of a byte is the
``DEPTH`` bytes before it in the running text of its document, end marks and
previous tokens included.  Each byte is eight binary decisions, each with a context
tree of its own.  Every node of a tree, at every depth, has a Krichevsky-Trofimov
estimate, and the node's weighted probability is half that estimate plus half the
product of its children's (Willems, Shtarkov and Tjalkens, 1995; the decomposition
of bytes: Volf, 2002).  The predictive probability of a bit mixes the estimates
along its context path by the weights that follow.

How it runs: documents are dealt to parts.  A part sends the distinct contexts of
its texts, each with its symbol and how often training texts hold it, to context
groups, and its distinct tokens to token shards.  A group holds the whole subtrees
of some contexts of three bytes: all that begin with certain pairs of bytes, dealt
once more by the third, so that a frequent pair is split.  The sums at depth two
are added up by Spark and go to the groups below them; depths one and zero have at
most 255 * 257 nodes and go to all.  The groups answer each part with the
log-probabilities of its contexts, in its own order.  Contexts travel sorted, the
nearest byte first, in compressed byte planes.

Edge cases: null and empty texts hold the end token alone; a null doc_id counts
as training; repeated rows each count; with no training row all estimates are
the even ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards as S
from . import text as T

U64 = np.uint64
DEPTH = 7
#: Marks a token's end, and the place before a text; no token holds it.
MARK = 0x20
#: Context groups, at least; the third byte splits each pair of bytes over so many of them.
GROUPS, SPLITS = 256, 8
#: Places of texts whose contexts are sorted at a time.
PLACES = 1 << 20
LOG_HALF = np.log(0.5)

_HALVES = np.array([math.lgamma(k + 0.5) for k in range(1 << 12)])
_WHOLES = np.array([math.lgamma(k + 1) for k in range(1 << 12)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after shifting small arguments up."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1)), shift)
        y = np.where(small, y + 1, y)
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""

    def of(count: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
        out = table[np.minimum(count, len(table) - 1).astype(np.int64)]
        large = np.flatnonzero(count >= len(table))
        out[large] = log_gamma(count[large] + more)
        return out

    return of(zeros, _HALVES, 0.5) + of(ones, _HALVES, 0.5) - of(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


class Running:
    """Texts as tokens with their end marks and the end token, each after DEPTH marks."""

    def __init__(self, texts: pa.ChunkedArray):
        data, offsets = T.buffers(texts)
        streams, self.at = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        for i, j in T.slices(offsets):
            part = T.LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, at = T.spans(part, offsets[i : j + 1] - offsets[i])
            size = np.insert(ends - starts, at[1:], 0) + 1
            size[at[:-1] + np.arange(j - i)] += DEPTH
            stream = np.full(int(size.sum()), MARK, np.uint8)
            lengths = ends - starts
            last = np.cumsum(size) - 1  # end marks
            word = np.delete(last, at[1:] + np.arange(j - i))
            stream[T.ragged(word - lengths, lengths)] = part[~T.WHITE[part]]
            streams.append(stream)
            self.at.append(np.concatenate([[0], last + 1])[at + np.arange(j - i + 1)][1:] + self.at[-1][-1])
        self.stream, self.at = np.concatenate(streams), np.concatenate(self.at)

    def passes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The keys of some places at a time, and the texts' offsets among these; keys of a later pass are larger.

        A key has the context, the nearest byte first, and then the symbol.
        """
        if not len(self.stream):
            return
        inside = np.ones(len(self.stream), bool)
        inside[T.ragged(self.at[:-1], np.full(len(self.at) - 1, DEPTH))] = False
        nearest = np.concatenate([[np.uint8(MARK)], self.stream[:-1]])
        held = np.concatenate([[0], np.cumsum(np.bincount(nearest[inside], minlength=256))])
        eights = np.lib.stride_tricks.as_strided(self.stream, (len(self.stream) - DEPTH, 8), (1, 1))
        low = 0
        while low < 256:
            high = max(low + 1, int(np.searchsorted(held, held[low] + PLACES, "right")) - 1)
            if held[high] > held[low]:
                place = np.flatnonzero(inside & (nearest >= low) & (nearest < high))
                key = eights[place - DEPTH].view("<u8")[:, 0]
                yield key << U64(8) | key >> U64(56), np.searchsorted(place, self.at)
            low = high


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def distinct(texts: pa.ChunkedArray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all texts, and how often the learned ones hold them."""
    keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for key, at in Running(texts).passes():
        mine = np.repeat(learned, np.diff(at))
        names, count = _runs(key[mine])
        both, _ = _runs(np.concatenate([names, _runs(key[~mine])[0]]))
        total = np.zeros(len(both), np.int64)
        total[np.searchsorted(both, names)] = count
        keys.append(both)
        counts.append(total)
    return np.concatenate(keys), np.concatenate(counts)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """By the two nearest bytes, then by the third: subtrees from depth three on stay whole."""
    third = T.mix((keys >> U64(40)) & U64(0xFF)) % U64(SPLITS)
    return bucket_of(keys >> U64(48), groups) * SPLITS + third.astype(np.int64)


def bucket_of(pairs: np.ndarray, groups: int) -> np.ndarray:
    return (T.mix(pairs.astype(U64)) % U64(groups // SPLITS)).astype(np.int64)


def _share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _above(name: np.ndarray) -> np.ndarray:
    """The same decision in the context without its farthest byte; a node's name has its context, then its decision."""
    return (name >> U64(16)) << U64(8) | name & U64(255)


class Subtree:
    """All context nodes below some contexts of three bytes, at depths DEPTH to 3; keys are sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.seen = counts > 0
        self.keys, counts = keys, counts[self.seen].astype(np.float64)
        own = keys[self.seen]
        names, totals, ones, self.place = [], [], [], []
        for level in range(8):
            prefix = own >> U64(8 - level)
            first = np.ones(len(own), bool)
            first[1:] = prefix[1:] != prefix[:-1]
            at = np.cumsum(first) - 1
            self.place.append(at + sum(map(len, names)))
            prefix = prefix[first]
            names.append((prefix >> U64(level)) << U64(8) | U64(1 << level) | prefix & U64((1 << level) - 1))
            totals.append(np.bincount(at, counts, len(prefix)))
            ones.append(np.bincount(at, counts * ((own >> U64(7 - level)) & U64(1)), len(prefix)))
        name, one, total = np.concatenate(names), np.concatenate(ones), np.concatenate(totals)
        weighted = log_kt(total - one, one)
        #: By depth: names, estimates, weights of these, and each node's place among the nodes above.
        self.levels = {DEPTH: [name, (one + 0.5) / (total + 1), np.ones(len(name)), None]}
        for depth in range(DEPTH - 1, 1, -1):
            name, up = np.unique(_above(name), return_inverse=True)
            self.levels[depth + 1][3] = up
            one, total, below = (np.bincount(up, x, len(name)) for x in (one, total, weighted))
            if depth > 2:
                own = log_kt(total - one, one)
                self.levels[depth] = [name, (one + 0.5) / (total + 1), _share(own, below), None]
                weighted = LOG_HALF + np.logaddexp(own, below)
        #: What goes to the nodes of depth two.
        self.top = name, total - one, one, below

    def log10(self, pairs: Pairs, root: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each key's symbol in its context."""
        p, at = self.levels[DEPTH][1], self.levels[DEPTH][3]
        for depth in range(DEPTH - 1, 2, -1):
            _, one, share, up = self.levels[depth]
            p = share[at] * one[at] + (1 - share[at]) * p
            at = up[at]
        p = pairs.mixed(self.top[0], p, at, root)
        of_one, of_zero = np.log10(p), np.log10(1 - p)
        out = np.zeros(len(self.keys))
        seen = self.keys[self.seen]
        out[self.seen] = sum((np.where((seen >> U64(7 - level)) & U64(1), of_one[at], of_zero[at]) for level, at in enumerate(self.place)), np.zeros(len(seen)))
        rest = self.keys[~self.seen]
        for level in range(8 if len(rest) else 0):
            node = U64(1 << level) | (rest & U64(255)) >> U64(8 - level)
            p = np.full(len(rest), 0.5)
            for depth in range(DEPTH, 2, -1):
                name, one, share, _ = self.levels[depth]
                want = pa.array((rest >> U64(64 - 8 * depth)) << U64(8) | node)
                at = pc.fill_null(pc.index_in(want, value_set=pa.array(name)), -1).to_numpy()
                p = np.where(at >= 0, share[at] * one[at] + (1 - share[at]) * p, p) if len(name) else p
            p = pairs.mixed((rest >> U64(48)) << U64(8) | node, p, np.arange(len(rest)), root)
            out[~self.seen] += np.log10(np.where((rest >> U64(7 - level)) & U64(1), p, 1 - p))
        return out


class Pairs:
    """Nodes of contexts of two bytes: names, estimates and weights."""

    def __init__(self, name: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(name)
        self.name, zeros, ones, below = name[order].astype(U64), zeros[order], ones[order], below[order]
        own = log_kt(zeros, ones)
        self.zeros, self.ones = zeros, ones
        self.one, self.share, self.weighted = (ones + 0.5) / (zeros + ones + 1), _share(own, below), LOG_HALF + np.logaddexp(own, below)

    def mixed(self, names: np.ndarray, p: np.ndarray, at: np.ndarray, root: np.ndarray) -> np.ndarray:
        """``p`` mixed with the estimates at depths 2, 1 and 0; nodes never seen leave it as it is."""
        near = np.minimum(np.searchsorted(self.name, names), max(0, len(self.name) - 1))
        share = self.share[near] * (self.name[near] == names) if len(self.name) else np.zeros(len(names))
        one = self.one[near] if len(self.name) else share
        p = share[at] * one[at] + (1 - share[at]) * p
        for depth in (1, 0):
            names = _above(names)
            one, share = (root[depth, k][names.astype(np.int64)] for k in (0, 1))
            p = share[at] * one[at] + (1 - share[at]) * p
        return p


SUMS = pa.schema([("bucket", pa.int32()), ("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())])
SUMS_SQL = "bucket int, node long, zeros double, ones double, below double"


def _sums(buckets: np.ndarray, nodes: np.ndarray, *sums: np.ndarray) -> pa.Table:
    return S.table(SUMS, bucket=buckets, node=nodes.astype(np.int64), **dict(zip(SUMS.names[2:], sums, strict=True)))


def _pairs(rows: pa.Table) -> Pairs:
    return Pairs(*(rows[c].to_numpy() for c in SUMS.names[1:]))


def _nearest(group: pa.Table) -> pa.Table:
    """Sums by node and nearest byte, for depth one."""
    pairs = _pairs(group)
    name, at = np.unique(_above(pairs.name), return_inverse=True)
    return _sums(np.zeros(len(name), np.int32), name, *(np.bincount(at, x, len(name)) for x in (pairs.zeros, pairs.ones, pairs.weighted)))


def _root(rows: pa.Table) -> np.ndarray:
    """Estimates and weights at depths 1 and 0."""
    root = np.zeros((2, 2, 1 << 16))
    name, *sums = (rows[c].to_numpy() for c in SUMS.names[1:])
    for depth in (1, 0):
        name, at = np.unique(name if depth else name & 255, return_inverse=True)
        zeros, ones, below = (np.bincount(at, x, len(name)) for x in sums)
        own = log_kt(zeros, ones)
        root[depth, 0, name], root[depth, 1, name] = (ones + 0.5) / (zeros + ones + 1), _share(own, below)
        sums = zeros, ones, LOG_HALF + np.logaddexp(own, below)
    return root


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of every token among the sorted hashes of the distinct ones, these hashes, and the texts' offsets."""
    words, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    end = T.word_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    for _, _, hashes, at in T.hashed(texts, lower=True):
        words.append(np.insert(hashes, at[1:], end[0]))
        sizes.append(np.diff(at) + 1)
    coded = pa.array(np.concatenate(words)).dictionary_encode()
    names = coded.dictionary.to_numpy()
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], names[order], np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


ASKED = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "part int, grp int, keys binary, counts binary"
COUNTED = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("found", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
ANSWERED_SQL = "part int, grp int, found binary"


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all rows, their counts, and the places of each row's keys among them."""
    each = [np.cumsum(S.unpacked(x.as_py())) for x in group["keys"]]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.bincount(at, np.concatenate([S.unpacked(x.as_py()) for x in group["counts"]]), len(keys)).astype(np.int64)
    return keys, counts, np.split(at, np.cumsum([len(x) for x in each])[:-1])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds to each document the scores of the count-based unigram and of the context-tree model.

    Rows for which ``held_out`` holds are scored, and nothing is learned from them.
    """
    shards = S.partitions(docs.sparkSession)
    groups = -(-max(GROUPS, shards) // SPLITS) * SPLITS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    # Fewer and larger parts than elsewhere: they ask about fewer distinct contexts in all.
    rows = S.with_part(rows, max(shards, S.parts_for(docs) // 2), "doc_id", "text")

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Distinct contexts by group, and distinct tokens by shard: group -1 and below."""
        learned = ~group["held_out"].to_numpy().astype(bool)
        keys, counts = distinct(group["text"], learned)
        of = group_of(keys, groups)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(groups + 1))
        del of
        cut = lambda x, y: (S.packed(np.diff(x, prepend=U64(0))), S.packed(y))
        out = [(k, *cut(*(x[order[bounds[k] : bounds[k + 1]]] for x in (keys, counts)))) for k in np.flatnonzero(np.diff(bounds)).tolist()]
        del keys, order
        index, hashes, at = _tokens(group["text"])
        counts = np.bincount(index[np.repeat(learned, np.diff(at))], minlength=len(hashes))
        bounds = S.by_shard(hashes, shards)
        out += [(-1 - k, *cut(*(x[bounds[k] : bounds[k + 1]] for x in (hashes, counts)))) for k in np.flatnonzero(np.diff(bounds)).tolist()]
        S.give_back()
        return S.table(ASKED, part=[key[0].as_py()] * len(out), grp=[g for g, *_ in out], keys=[k for _, k, _ in out], counts=[c for *_, c in out])

    asked = S.kept(rows.groupBy("part").applyInArrow(ask, ASKED_SQL))

    def count_tokens(group: pa.Table) -> pa.Table:
        _, counts, each = _gathered(group)
        rest = [0] * (group.num_rows - 1)  # the sums once
        return S.table(COUNTED, part=group["part"].combine_chunks(), grp=group["grp"].combine_chunks(), found=[S.packed(counts[at]) for at in each], n=[int(counts.sum()), *rest], v=[int((counts > 0).sum()), *rest])

    tokens = S.kept(asked.where("grp < 0").groupBy("grp").applyInArrow(count_tokens, ANSWERED_SQL + ", n long, v long"))
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    train_tokens, train_distinct = sums["n"], sums["v"]
    wanted = asked.where("grp >= 0")

    def tops(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, counts, _ = _gathered(group)
        name, *sums = Subtree(keys, counts).top
        S.give_back()
        return _sums(np.full(len(name), key[0].as_py() // SPLITS, np.int32), name, *sums)

    top = wanted.groupBy("grp").applyInArrow(tops, SUMS_SQL)
    pairs = S.kept(top.groupBy("bucket", "node").agg(*(F.sum(c).alias(c) for c in SUMS.names[2:])))
    near = pairs.groupBy(F.shiftrightunsigned("node", 16).alias("nearest")).applyInArrow(_nearest, SUMS_SQL)
    root = _root(near.orderBy("node").toArrow())  # at most 255 nodes for each of 256 nearest bytes

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts, each = _gathered(left)
        found = Subtree(keys, counts).log10(_pairs(right), root).astype(np.float32)
        S.give_back()
        return pa.table({"part": left["part"], "grp": left["grp"], "found": pa.array([S.packed(found[at]) for at in each], pa.binary())})

    # A bucket's nodes of depth two go to each of the groups below it.
    below = pairs.select(F.explode(F.sequence(F.col("bucket") * SPLITS, (F.col("bucket") + 1) * SPLITS - 1)).alias("grp"), *SUMS.names[1:])
    own = wanted.select("grp").distinct()
    answered = wanted.groupBy("grp").cogroup(below.join(own, "grp", "left_semi").groupBy("grp")).applyInArrow(answer, ANSWERED_SQL)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["grp"]))
        of, found = right["grp"].to_numpy(), [S.unpacked(x.as_py()) for x in right["found"]]
        index, _, at = _tokens(left["text"])
        counts = np.concatenate([np.zeros(0, np.int64), *(found[k] for k in np.flatnonzero(of < 0)[::-1])]).astype(np.int64)
        base = np.log10((counts + 1) / (train_tokens + train_distinct + 1))
        base, known = (np.add.reduceat(x[index], at[:-1]) for x in (base, (counts > 0).astype(np.int64)))
        # Each group's answers are in order of its keys, and later passes have the larger keys.
        first = np.zeros(groups, np.int64)
        first[of[of >= 0]] = np.cumsum([0, *(len(found[k]) for k in np.flatnonzero(of >= 0))])[:-1]
        answers = np.concatenate([np.zeros(0, np.float32), *(found[k] for k in np.flatnonzero(of >= 0))])
        del right, found, index, counts
        total = np.zeros(left.num_rows)
        for key, bounds in Running(left["text"]).passes():
            coded = pa.array(key).dictionary_encode()
            names = coded.dictionary.to_numpy()
            order = np.argsort(names)
            own = group_of(names[order], groups)
            size = np.bincount(own, minlength=groups)
            value = np.empty(len(names))
            value[order[np.argsort(own, kind="stable")]] = answers[T.ragged(first, size)]
            first += size
            sums = np.concatenate([[0.0], np.cumsum(value[coded.indices.to_numpy()])])
            total += np.diff(sums[bounds])
        letters = T.buffers(left["text"])[1]
        n = left.num_rows
        S.give_back()
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(total), "bits_per_byte": pa.array(-total / np.log10(2) / np.maximum(1, np.diff(letters)))})

    kind = rows.schema["doc_id"].dataType.simpleString()
    answers = tokens.select("part", "grp", "found").unionByName(answered)
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
