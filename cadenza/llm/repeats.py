"""Removal of repeated passages by difference-cover anchors.

A window is WINDOW consecutive words of one document.  A word goes if it lies in
a window whose word sequence also starts in a document with a smaller id.

Windows of ANCHOR words are hashed only at positions whose remainder modulo
PERIOD lies in a difference cover.  Any two positions i and j have an offset
k < PERIOD at which both i + k and j + k are such positions; so two equal windows
of WINDOW = ANCHOR + PERIOD - 1 words share an aligned anchor.  Anchors that one
document alone holds are dropped, and only windows around the rest are extended
to their full length and compared, by 64-bit hashes, with those of all documents.

Edge cases: null and empty texts have no words and keep the empty text; texts
shorter than a window keep all words; rows that share a doc_id don't remove each
other's words, and a null doc_id counts as larger than all others; an empty
table gives no rows; other columns pass through ``remove`` and are ignored by
``digest``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from . import text as T

U64 = np.uint64
WINDOW = 13
PERIOD = 7
#: Every residue modulo 7 is a difference of two of these.
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
LAST = np.iinfo(np.int64).max


def _windows(texts: pa.ChunkedArray, width: int):
    """For runs of texts: first row, hashes of all windows, their rows and their word positions in the row."""
    for i, _, words, at in T.hashed(texts):
        hashes = T.window_hashes(words, width)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(hashes)]
        place = np.arange(len(hashes)) - at[:-1][row]
        inside = place + width <= np.diff(at)[row]
        yield i, hashes[inside], row[inside], place[inside], words, at


def _anchored(place: np.ndarray) -> np.ndarray:
    return np.isin(place % PERIOD, COVER)


def _ids(group: pa.Table) -> np.ndarray:
    return pc.fill_null(group["doc_id"], LAST).to_numpy()


def _anchors(group: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of the part, and which of them two of its documents hold."""
    ids, keys, owners = _ids(group), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, hashes, row, place, _, _ in _windows(group["text"], ANCHOR):
        chosen = _anchored(place)
        keys.append(S.narrow(hashes[chosen], shards))
        owners.append(ids[i + row[chosen]])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)) if len(key) else (owner, owner)
    return key[first], low != high


def _extended(group: pa.Table, shards: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows around shared anchors: hashes, sorted, with the smallest and largest document of the part."""
    ids, keys, owners = _ids(group), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, hashes, row, place, words, at in _windows(group["text"], WINDOW):
        if not len(hashes):
            continue
        short = T.window_hashes(words, ANCHOR)
        where = np.arange(len(short)) - np.repeat(at[:-1], np.diff(at))[: len(short)]
        hit = np.zeros(len(short) + 1, np.int64)
        chosen = np.flatnonzero(_anchored(where))
        asked = S.narrow(short[chosen], shards)
        near = np.minimum(np.searchsorted(shared, asked), max(0, len(shared) - 1))
        if len(shared):
            hit[1:][chosen[shared[near] == asked]] = 1
        np.cumsum(hit, out=hit)
        start = at[:-1][row] + place
        held = hit[np.minimum(start + PERIOD, len(short))] > hit[start]
        keys.append(hashes[held])
        owners.append(ids[i + row[held]])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    if not len(key):
        return key, owner, owner
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)


def _split(part: int, keys: np.ndarray, shards: int, *more: np.ndarray, narrow: bool) -> pa.Table:
    """One row for each shard that the keys fall to."""
    of = (keys >> U64(32)) if narrow else S.shard_of(keys, shards)
    bounds = np.searchsorted(of, np.arange(shards + 1, dtype=U64))
    full = np.flatnonzero(np.diff(bounds))
    cut = lambda x: pa.array([S.blob(x[bounds[k] : bounds[k + 1]]) for k in full], pa.binary())
    names = ["keys", "more", "most"][: 1 + len(more)]
    return pa.table({"part": pa.array([part] * len(full), pa.int32()), "shard": pa.array(full, pa.int32())} | {n: cut(x) for n, x in zip(names, (keys.astype(np.uint32) if narrow else keys, *more), strict=True)})


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    """The packed values of all rows, in order of shard."""
    if not table.num_rows:
        return np.zeros(0, kind)
    table = table.take(pc.sort_indices(table["shard"]))
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[column]])


def _share(group: pa.Table) -> pa.Table:
    """Of each part's anchors, those that some other document holds."""
    each = [np.frombuffer(x.as_py(), np.uint32) for x in group["keys"]]
    twice = [np.frombuffer(x.as_py(), bool) for x in group["more"]]
    keys = np.concatenate(each)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.concatenate([ranked[1:] == ranked[:-1], [False]])
    shared = np.empty(len(keys), bool)
    shared[order] = same | np.concatenate([[False], same[:-1]])
    of = np.flatnonzero(np.concatenate(twice))
    shared[np.isin(keys, np.unique(keys[of]))] = True
    ends = np.cumsum([len(k) for k in each])
    found = [S.blob(k[shared[e - len(k) : e]]) for k, e in zip(each, ends, strict=True)]
    return pa.table({"part": group["part"], "shard": group["shard"], "keys": pa.array(found, pa.binary())})


def _smallest(group: pa.Table) -> pa.Table:
    """Of each part's windows, those that start in a document smaller than one of the part's, with the smallest."""
    each = [np.frombuffer(x.as_py(), U64) for x in group["keys"]]
    least = [np.frombuffer(x.as_py(), np.int64) for x in group["more"]]
    most = [np.frombuffer(x.as_py(), np.int64) for x in group["most"]]
    keys = np.concatenate(each)
    order = np.argsort(keys, kind="stable")
    ranked, ids = keys[order], np.concatenate(least)[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    low = np.empty(len(keys), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(keys))))
    ends, out = np.cumsum([len(k) for k in each]), []
    for k, m, e in zip(each, most, ends, strict=True):
        own = low[e - len(k) : e]
        out.append((S.blob(k[own < m]), S.blob(own[own < m])))
    return pa.table({"part": group["part"], "shard": group["shard"], "keys": pa.array([a for a, _ in out], pa.binary()), "low": pa.array([b for _, b in out], pa.binary())})


def _gone(group: pa.Table, keys: np.ndarray, low: np.ndarray):
    """For runs of texts: first row, word starts and ends, whether each word goes, word offsets, bytes."""
    ids = _ids(group)
    data, offsets = T.buffers(group["text"])
    for i, j in T.slices(offsets):
        raw, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, at = T.spans(raw, bounds)
        gone = np.zeros(len(starts), bool)
        if len(keys) and len(starts) >= WINDOW:
            hashes = T.window_hashes(T.word_hashes(raw, starts, ends), WINDOW)
            row = np.repeat(np.arange(j - i), np.diff(at))[: len(hashes)]
            inside = np.arange(len(hashes)) + WINDOW <= at[1:][row]
            near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            bad = inside & (keys[near] == hashes) & (low[near] < ids[i + row])
            depth = np.zeros(len(starts) + 1, np.int64)
            depth[: len(hashes)] += bad
            depth[WINDOW : WINDOW + len(hashes)] -= bad
            gone = np.cumsum(depth)[:-1] > 0
        yield i, raw, starts, ends, gone, at


def _kept_texts(group: pa.Table, keys: np.ndarray, low: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space, and how many words it had and lost."""
    texts, n, lost = [], np.zeros(group.num_rows, np.int64), np.zeros(group.num_rows, np.int64)
    for i, raw, starts, ends, gone, at in _gone(group, keys, low):
        starts, ends = starts[~gone], ends[~gone]
        removed = np.concatenate([[0], np.cumsum(gone)])[at]
        left = at - removed
        n[i : i + len(at) - 1], lost[i : i + len(at) - 1] = np.diff(at), np.diff(removed)
        spaced = np.append(raw, np.uint8(0x20))
        size = ends - starts + 1  # with the white space after it, or at a text's end any byte
        out = spaced[T.ragged(starts, size)]
        bounds = np.concatenate([[0], np.cumsum(size)])
        out[bounds[1:] - 1] = 0x20
        whole = out.tobytes()
        cut = bounds[left]
        texts += [whole[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return texts, n, lost


def _run(docs: DataFrame, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    shards = S.partitions(docs.sparkSession)
    rows = docs.withColumnsRenamed({id_col: "doc_id", text_col: "text"}).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    rows = S.with_part(rows, S.parts_for(docs), "doc_id", "text")
    held = rows.select("part", "doc_id", "text")
    rows = held if len(rows.columns) == 3 else rows  # so that all steps read one shuffle of the texts

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        anchors, twice = _anchors(group, shards)
        return _split(key[0].as_py(), anchors, shards, twice, narrow=True)

    def extend(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        shared = _joined_narrow(right)
        keys, least, most = _extended(left, shards, shared)
        return _split(key[0].as_py(), keys, shards, least, most, narrow=False)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(left, _joined(right, "keys", U64), _joined(right, "low", np.int64))

    anchors = held.groupBy("part").applyInArrow(ask, "part int, shard int, keys binary, more binary")
    shared = anchors.groupBy("shard").applyInArrow(_share, "part int, shard int, keys binary")
    windows = held.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(extend, "part int, shard int, keys binary, more binary, most binary")
    smallest = windows.groupBy("shard").applyInArrow(_smallest, "part int, shard int, keys binary, low binary")
    return rows.groupBy("part").cogroup(smallest.groupBy("part")).applyInArrow(end, schema)


def _joined_narrow(table: pa.Table) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, U64)
    table = table.take(pc.sort_indices(table["shard"]))
    return np.concatenate([(U64(s.as_py()) << U64(32)) | np.frombuffer(x.as_py(), np.uint32) for s, x in zip(table["shard"], table["keys"], strict=True)])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many words each document had and lost, and the fingerprint of what it kept."""

    def finish(group: pa.Table, keys: np.ndarray, low: np.ndarray) -> pa.Table:
        texts, n, lost = _kept_texts(group, keys, low)
        return pa.table({"doc_id": group["doc_id"], "n_words": pa.array(n), "n_removed": pa.array(lost), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())})

    return _run(docs.select(id_col, text_col), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", id_col, text_col)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with the words that remain, joined by one space, as their texts."""

    def finish(group: pa.Table, keys: np.ndarray, low: np.ndarray) -> pa.Table:
        texts = pa.array(_kept_texts(group, keys, low)[0], pa.binary()).cast(pa.string())
        group = group.drop_columns(["part"])
        return group.set_column(group.schema.get_field_index("text"), "text", texts)

    # Other columns go under names of their own, so that none clashes with those in use here.
    others = {c: f"_c{k}" for k, c in enumerate(c for c in docs.columns if c not in (id_col, text_col))}
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in others.items()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    back = {n: c for c, n in others.items()} | {"doc_id": id_col, "text": text_col}
    return _run(plain, finish, fields, "doc_id", "text").withColumnsRenamed(back).select(*(f"`{c}`" for c in docs.columns))
