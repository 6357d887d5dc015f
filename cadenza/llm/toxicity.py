"""Toxic spans by a linear-chain conditional random field.

Two labels, clean and toxic, tag the words of a text.  Labelled documents are
turned into labelled tokens: a word of a toxic document counts as toxic if it, or
its first letters, stand in toxic documents almost alone.  The field is fitted on
these by gradient ascent; its features are the word without outer punctuation and
its first three to six bytes, and the transitions.  For a text, the forward and
backward passes give each word's marginal, the marginals give the spans, and a
logistic curve over what they add up to, fitted on the labelled documents and
set to the share of toxic ones, gives the document's score.

Fitting uses a bounded sample of labelled documents (``SAMPLE`` of either label
and ``SAMPLE_BYTES`` of their texts, chosen by hash, those longer than ``LONGEST``
passed over), each whole, a few megabytes at a time; so the features of the model are
bounded too, and it may go to every task.  All texts are scored whole.

Edge cases: null and empty texts get the score of a text without toxic words;
unlabelled, null-labelled and null-id rows don't train; where one label is
missing altogether, all scores are the share of toxic labels (0 without labels);
repeated label rows count once, as toxic if any is; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards as S
from . import text as T

U64 = np.uint64
#: Labelled documents of either label that fit the model, at most, and their bytes; longer texts than the last are passed over.
SAMPLE = 2_000
SAMPLE_BYTES = 48 << 20
LONGEST = 1 << 20
PREFIXES = (3, 4, 5, 6)
STEPS = 30
#: Bytes of text tagged at a time, in the fit and after it.
SLICE_BYTES = 4 << 20
#: Share of a feature's documents that are toxic from which its words count as toxic.
PURE = 0.85
THRESHOLD = 0.3

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(words: pa.Array) -> np.ndarray:
    """Hashes of the features of each word, one row for each kind of feature."""
    data, offsets = T.buffers(words)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    padded = np.append(data, np.uint8(0))
    for _ in range(3):
        starts += PUNCTUATION[padded[starts]] & (ends - starts > 1)
        ends -= PUNCTUATION[padded[np.maximum(ends - 1, 0)]] & (ends - starts > 1)
    out = [T.word_hashes(data, starts, ends)]
    for k, n in enumerate(PREFIXES):
        out.append(T.mix(T.word_hashes(data, starts, np.minimum(starts + n, ends)) + U64(k + 1)))
    return np.array(out, U64).reshape(1 + len(PREFIXES), -1)


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray  # log-potentials [from, to]
    curve: np.ndarray
    prior: float

    def emissions(self, words: pa.Array) -> np.ndarray:
        out = np.full(len(words), self.bias)
        if len(self.hashes):
            for row in features(words):
                at = np.minimum(np.searchsorted(self.hashes, row), len(self.hashes) - 1)
                out += np.where(self.hashes[at] == row, self.weights[at], 0)
        return out


def _composed(e: np.ndarray, psi: np.ndarray, starts: list[np.ndarray], backward: bool) -> list[np.ndarray]:
    """For each column of words, the 2x2 matrix that takes a pair of weights over it; starts: by row, columns in which a chain begins."""
    q = [np.ones(e.shape[1]), np.zeros(e.shape[1]), np.zeros(e.shape[1]), np.ones(e.shape[1])]
    for k in range(len(e))[:: -1 if backward else 1]:
        x, at = e[k], starts[k]
        if backward:
            below = [x * q[2], x * q[3]]
            new = [psi[i, 0] * q[c] + psi[i, 1] * below[c] for i in (0, 1) for c in (0, 1)]
            if len(at):
                new[0][at] = new[2][at] = q[0][at] + below[0][at]
                new[1][at] = new[3][at] = q[1][at] + below[1][at]
        else:
            new = [(psi[0, i] * q[c] + psi[1, i] * q[2 + c]) * (x if i else 1.0) for i in (0, 1) for c in (0, 1)]
            if len(at):
                for c in (0, 1):
                    new[c][at] = q[c][at] + q[2 + c][at]
                    new[2 + c][at] = x[at] * new[c][at]
        if k % 8 == 0:
            scale = 1 / (new[0] + new[1] + new[2] + new[3])
            new = [m * scale for m in new]
        q = new
    return q


def marginals(emission: np.ndarray, at: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability of the toxic label for each word, by forward and backward ratios.

    emission holds log-ratios of the two labels; ``at`` the chains' n + 1 offsets;
    ``pairs`` gathers the expected transitions.  All words make one row in which a
    chain's first word forgets what comes before.  The row is cut into columns: the
    matrices of whole columns give the ratios at their borders, and then all columns
    go on side by side, so a chain of any length takes about as many steps as the
    square root of all words.
    """
    n = len(emission)
    if not n:
        return np.zeros(0)
    psi = np.exp(transitions)
    height = max(8, int(n**0.5 / 3))
    width = -(-n // height)
    e = np.ones(height * width)
    e[:n] = np.exp(np.clip(emission, -30, 30))
    first = np.zeros(height * width, bool)
    first[n:] = True
    first[at[:-1][at[:-1] < n]] = True
    e, inner = np.ascontiguousarray(e.reshape(width, height).T), ~first
    row, column = np.nonzero(first.reshape(width, height).T)
    starts = np.split(column, np.searchsorted(row, np.arange(1, height)))
    a, b, c, d = (m.tolist() for m in _composed(e, psi, starts, False))
    r, entry = 1.0, []
    for k in range(width):
        entry.append(r)
        r = (c[k] + d[k] * r) / (a[k] + b[k] * r)
    r, forward = np.array(entry), np.empty_like(e)
    for k in range(height):
        r = e[k] * (psi[0, 1] + psi[1, 1] * r) / (psi[0, 0] + psi[1, 0] * r)
        r[starts[k]] = e[k][starts[k]]
        forward[k] = r
    a, b, c, d = (m.tolist() for m in _composed(e, psi, starts, True))
    s, entry = 1.0, []
    for k in range(width - 1, -1, -1):
        entry.append(s)
        s = (c[k] + d[k] * s) / (a[k] + b[k] * s)
    s, back = np.array(entry[::-1]), np.empty_like(e)
    for k in range(height - 1, -1, -1):
        back[k] = s
        x = e[k] * s
        s = (psi[1, 0] + psi[1, 1] * x) / (psi[0, 0] + psi[0, 1] * x)
        s[starts[k]] = 1.0
    odds = forward * back
    if pairs is not None:
        along = lambda m: m.T.reshape(-1)
        both = np.flatnonzero(inner[1:])
        a, x = along(forward)[both], along(e * back)[both + 1]
        joint = np.array([[psi[0, 0] + 0 * a, psi[0, 1] * x], [psi[1, 0] * a, psi[1, 1] * a * x]])
        pairs += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    return (odds / (1 + odds)).T.reshape(-1)[:n]


def summary(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What a document's marginals add up to: log of the expected toxic words, and of the likeliest one's odds."""
    padded = np.append(p, 0.0)
    lengths = np.diff(at)
    total = np.where(lengths > 0, np.add.reduceat(padded, at[:-1]) if len(lengths) else 0, 0)
    best = np.where(lengths > 0, np.maximum.reduceat(padded, at[:-1]) if len(lengths) else 0, 0)
    return np.stack([np.ones(len(lengths)), np.log(total + 1e-3), np.log((best + 1e-3) / (1 - best + 1e-3))], axis=1)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.5 * w * np.array([0, 1, 1]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class _Slice:
    """Some of the labelled texts: words as indices into distinct ones, these words' features, the texts' labels."""

    index: np.ndarray
    at: np.ndarray
    features: np.ndarray
    toxic: np.ndarray
    label: np.ndarray | None = None  # of each word
    held: list[tuple[np.ndarray, np.ndarray]] | None = None  # by kind of feature: words that have a chosen one, and which


def _sliced(texts: pa.Array | pa.ChunkedArray, toxic: np.ndarray) -> list[_Slice]:
    data, offsets = T.buffers(texts)
    out = []
    for i, j in T.slices(offsets, SLICE_BYTES):
        index, words, at = T.encoded_bytes(T.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
        out.append(_Slice(index.astype(np.int32), at, features(words), toxic[i:j]))
    return out


def fit(texts: pa.Array | pa.ChunkedArray | list[str | None], toxic: list[int], prior: float) -> Model:
    """Fits the field and the curve on labelled documents; prior: the share of toxic ones among all labelled."""
    y = np.array(toxic, np.int64)
    none = Model(np.zeros(0, U64), np.zeros(0), -8.0, np.zeros((2, 2)), np.zeros(3), prior)
    if not len(y) or y.min() == y.max():
        return none
    slices = _sliced(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, y)
    if not any(len(s.index) for s in slices):
        return none
    names = np.unique(np.concatenate([np.unique(s.features) for s in slices]))
    tox_df, all_df = np.zeros(len(names)), np.zeros(len(names))
    for s in slices:
        s.features = np.searchsorted(names, s.features).astype(np.int32)
        doc = np.repeat(np.arange(len(s.toxic)), np.diff(s.at))
        for row in s.features:
            both = np.unique(row[s.index].astype(np.int64) * len(s.toxic) + doc)
            own = both // len(s.toxic)
            all_df += np.bincount(own, minlength=len(names))
            tox_df += np.bincount(own, s.toxic[both % len(s.toxic)], len(names))
    chosen = tox_df >= 3
    slot = np.cumsum(chosen) - 1
    # As in a sample with as many clean documents as toxic ones.
    clean = (all_df - tox_df) * (y.sum() / max(1, len(y) - y.sum()))
    pure = chosen & (tox_df / (tox_df + clean + 0.5) >= PURE) & (tox_df >= 5)
    n = int(chosen.sum())
    weights, bias, transitions = np.zeros(n), -4.0, np.zeros((2, 2))
    seen, seen_bias, seen_moves = np.full(n, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    held = np.zeros((2, 2))
    for s in slices:
        s.label = pure[s.features].any(axis=0)[s.index] & np.repeat(s.toxic == 1, np.diff(s.at))
        inner = np.ones(len(s.label), bool)
        inner[s.at[:-1][s.at[:-1] < len(inner)]] = False
        pair = s.label[:-1] * 2 + s.label[1:]
        held += np.bincount(pair[inner[1:]], minlength=4).reshape(2, 2)
        s.held = [(np.flatnonzero(chosen[row]), slot[row[chosen[row]]]) for row in s.features]
    scale = 1 / max(1.0, sum(s.label.sum() for s in slices))

    def emission(s: _Slice) -> np.ndarray:
        out = np.full(s.features.shape[1], bias)
        for have, where in s.held:
            out[have] += weights[where]
        return out[s.index]

    for _ in range(STEPS):
        expected, slope, bias_slope = np.zeros((2, 2)), -1e-4 * weights, 0.0
        for s in slices:
            p = marginals(emission(s), s.at, transitions, expected)
            rest = np.bincount(s.index, s.label - p, s.features.shape[1]) * scale
            bias_slope += rest.sum()
            for have, where in s.held:
                slope += np.bincount(where, rest[have], n)
        moves = (held - expected) * scale
        moves[0, 0] = 0.0  # fixed, as only differences matter
        seen += slope**2
        weights += 0.7 * slope / np.sqrt(seen)
        seen_bias += bias_slope**2
        bias += 0.7 * bias_slope / np.sqrt(seen_bias)
        seen_moves += moves**2
        transitions += 0.3 * moves / np.sqrt(seen_moves)
    curve = _curve(np.concatenate([summary(marginals(emission(s), s.at, transitions), s.at) for s in slices]), y.astype(float))
    share = y.mean()
    curve[0] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(share / (1 - share))
    return Model(names[chosen], weights, bias, transitions, curve, prior)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the rows of ``labels`` for which ``learn`` holds."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    labels = labels.where(learn) if learn is not None else labels
    labels = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    one = lambda toxic: labels.where((F.col("toxic") > 0) == toxic).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    sample = one(True).unionByName(one(False))  # at most 2 * SAMPLE rows, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    size = F.sum(F.octet_length(F.coalesce("_text", F.lit("")))).over(_by_hash())
    rows = rows.where(F.octet_length(F.coalesce("_text", F.lit(""))) <= LONGEST)
    rows = rows.withColumn("_sum", size).where(F.col("_sum") <= SAMPLE_BYTES).drop("_sum")
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_id", "ascending"), ("_text", "ascending")])
        model = fit(group["_text"], group["toxic"].to_pylist(), prior)
        S.give_back()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # The sample is bounded, and one task fits it.
    found = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [], prior)


def _by_hash():
    from pyspark.sql import Window

    # Over the bounded sample only.
    return Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id", "_text").rowsBetween(Window.unboundedPreceding, 0)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def score(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = False, score_col: str = "score") -> DataFrame:
    """Adds (or replaces) ``score_col`` and, if asked for, ``toxic_spans`` in code points, ends exclusive."""
    docs = docs.drop(score_col, *["toxic_spans"] * with_spans)
    columns = docs.columns

    def tag(batches):
        for batch in batches:
            texts, scores, spans = batch.column(columns.index(text_col)), [np.zeros(0)], [pa.array([], SPANS)]
            for i, j in T.slices(T.buffers(texts)[1], SLICE_BYTES):
                part = texts.slice(i, j - i)
                index, words, at = T.encoded(part, lower=True)
                p = marginals(model.emissions(words)[index], at, model.transitions)
                x = summary(p, at)
                scores.append(1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30))) if model.curve.any() else np.full(len(x), model.prior))
                if with_spans:
                    spans.append(_spans(part, p))
            out = [*batch.columns, pa.array(np.concatenate(scores))]
            if with_spans:
                out.append(pa.concat_arrays(spans))
            yield pa.RecordBatch.from_arrays(out, names=[*columns, score_col, "toxic_spans"][: len(out)])
            S.give_back()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{score_col}` double"]
    fields += ["toxic_spans array<struct<start: int, end: int, probability: double>>"] * with_spans
    return docs.mapInArrow(tag, ", ".join(fields))


def _spans(texts: pa.Array, p: np.ndarray) -> pa.Array:
    """Runs of words likelier toxic than not, with the mean of their marginals."""
    data, offsets = T.buffers(texts)
    starts, ends, at = T.spans(data, offsets)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for i in range(len(offsets) - 1):
        lo, hi = at[i], at[i + 1]
        hot = np.concatenate([[False], p[lo:hi] >= 0.5, [False]])
        edge = np.flatnonzero(hot[1:] != hot[:-1])
        base = letters[offsets[i]]
        out.append([{"start": int(letters[starts[lo + a]] - base), "end": int(letters[ends[lo + b - 1]] - base), "probability": float(p[lo + a : lo + b].mean())} for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return pa.array(out, SPANS)
