"""Benchmark passages in documents, by SimHash of item-sized windows.

Every item has a 64-bit SimHash of its words.  A document that shares a shingle
of five words with an item is slid over in windows of as many words as the item
has, and each window gets a SimHash.  Four blocks of 16 bits are indexed with all
values within BLOCK_RADIUS bits, so every window within RADIUS bits of an item
is found (of 11 differing bits, some block has at most two).  Similar windows may
lie farther, so those about the shared shingles that the fingerprints leave out
are candidates too, where the shared shingles alone allow the similarity.  What is
found is verified exactly: the weighted Jaccard similarity of the shingles of window and
item, with weights by how few items hold a shingle, must reach SIMILARITY.

A window that shares no shingle with an item can't be similar to it, so leaving
such documents aside loses nothing.  Items are handled in blocks of at most
ITEMS, each small enough to go to every task; larger benchmarks take more blocks.

Edge cases: null and empty texts hold no item, and null or empty items are held
by nothing; items and documents shorter than a shingle are compared as whole
sequences; repeated rows are each reported; an empty table or benchmark gives no
rows (``drop`` then keeps all documents); a row of null id is searched like any
other; of windows that are equally similar the first is reported; other columns are
ignored by ``find`` and pass through ``drop``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as T

U64 = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items in a block, at most.
ITEMS = 4096


def _planes(words: np.ndarray) -> np.ndarray:
    """Running sums of each of the 64 bits over the words."""
    bits = np.unpackbits(T.mix(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def simhashes(planes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of ``width`` words."""
    more = 2 * (planes[width:] - planes[:-width]) > width
    return np.packbits(more, axis=1, bitorder="little").view(U64)[:, 0]


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    return T.window_hashes(words, width) if len(words) >= width else np.zeros(0, U64)


@dataclass
class Items:
    """Benchmark items, their shingles with weights, and the index of their fingerprints."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self):
        self.width = [min(SHINGLE, len(w)) for w in self.words]
        own = [_shingles(w, n) for w, n in zip(self.words, self.width, strict=True)]
        # Short items have shingles of their own width, told apart by their hashes.
        self.widths = sorted(set(self.width))
        pairs = np.unique(np.array([(s, i) for i, x in enumerate(own) for s in x.tolist()], U64).reshape(-1, 2), axis=0)
        self.shingle, first, held = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.holder, self.first, self.held = pairs[:, 1].astype(np.int64), first, held
        self.weight = 1 + np.log(max(1, len(self.ids)) / held)
        self.unknown = 1 + np.log(max(1, len(self.ids)))
        self.bag = [np.unique(x, return_counts=True) for x in own]
        self.mass = [float((self.weigh(s) * n).sum()) for s, n in self.bag]
        self.prints = np.array([simhashes(_planes(w), len(w))[0] for w in self.words], U64)
        flips = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in itertools.combinations(range(BLOCK_BITS), r)], np.int64)
        self.index = []
        for k in range(BLOCKS):
            block = ((self.prints >> U64(16 * k)) & U64(0xFFFF)).astype(np.int64)
            values = (block[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.index.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), np.repeat(np.arange(len(block)), len(flips))[order]))

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.full(len(shingles), self.unknown)
        at = np.minimum(np.searchsorted(self.shingle, shingles), len(self.shingle) - 1)
        return np.where(self.shingle[at] == shingles, self.weight[at], self.unknown)

    def sharing(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Texts that share a shingle with items, and those items."""
        out: dict[int, set[int]] = {}
        for width in self.widths:
            hashes = _shingles(words, width)
            near = np.minimum(np.searchsorted(self.shingle, hashes), len(self.shingle) - 1)
            hit = np.flatnonzero(self.shingle[near] == hashes)
            row = np.searchsorted(at, hit, "right") - 1
            inside = hit + width <= at[row + 1]
            for r, s in set(zip(row[inside].tolist(), near[hit[inside]].tolist(), strict=True)):
                out.setdefault(r, set()).update(self.holder[self.first[s] : self.first[s] + self.held[s]].tolist())
        return [(r, np.array(sorted(i), np.int64)) for r, i in sorted(out.items())]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs within RADIUS bits."""
        found = []
        for k, (bounds, items) in enumerate(self.index):
            block = ((prints >> U64(16 * k)) & U64(0xFFFF)).astype(np.int64)
            count = bounds[block + 1] - bounds[block]
            window, item = np.repeat(np.arange(len(prints)), count), items[T.ragged(bounds[block], count)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(window[close] * len(self.ids) + item[close])
        both = np.unique(np.concatenate(found))
        return both // len(self.ids), both % len(self.ids)

    def similarity(self, window: np.ndarray, item: int) -> float:
        names, count = np.unique(_shingles(window, self.width[item]), return_counts=True)
        own, times = self.bag[item]
        at = np.minimum(np.searchsorted(own, names), len(own) - 1)
        shared = np.where(own[at] == names, np.minimum(times[at], count), 0)
        weight = self.weigh(names)
        both = float((weight * shared).sum())
        return both / (self.mass[item] + float((weight * count).sum()) - both)

    def possible(self, words: np.ndarray, item: int, width: int) -> np.ndarray:
        """Windows whose shingles that the item holds, counted as often as they occur, allow SIMILARITY."""
        names = _shingles(words, self.width[item])
        inner = width - self.width[item] + 1
        if inner < 1 or len(names) < inner:
            return np.zeros(0, np.int64)
        own, _ = self.bag[item]
        at = np.minimum(np.searchsorted(own, names), len(own) - 1)
        shared = np.concatenate([[0.0], np.cumsum(np.where(own[at] == names, self.weigh(names), 0.0))])
        # Similarity is at most what is shared over the item's mass.
        return np.flatnonzero(shared[inner:] - shared[:-inner] >= SIMILARITY * self.mass[item] * (1 - 1e-9) - 1e-9)

    def search(self, words: np.ndarray, items: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Of these items, those that the text holds: item, first word, words, similarity of the best window."""
        planes, best = _planes(words), {}
        size = np.array([len(self.words[i]) for i in items])
        for n in np.unique(size).tolist():
            width = min(n, len(words))
            windows, found = self.near(simhashes(planes, width))
            mine = np.isin(found, items[size == n])
            near = set(zip(windows[mine].tolist(), found[mine].tolist(), strict=True))
            near |= {(w, i) for i in items[size == n].tolist() for w in self.possible(words, i, width).tolist()}
            for w, i in sorted(near):
                s = self.similarity(words[w : w + width], i)
                if s >= SIMILARITY and s > best.get(i, (0, 0, 0.0))[2]:
                    best[i] = (w, width, s)
        return [(i, w, n, s) for i, (w, n, s) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    blocks = -(-items.count() // (ITEMS // 2))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        hashed = {}
        texts = pa.array([r["t"] for r in rows], pa.large_string())
        for i, j, words, at in T.hashed(texts, lower=True):
            hashed |= {i + r: words[at[r] : at[r + 1]] for r in range(j - i)}
        chosen = [r for r in range(len(rows)) if len(hashed[r])]
        if chosen:
            yield Items([rows[r]["i"] for r in chosen], [hashed[r] for r in chosen])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each document and item it holds: where, and how similar the best window is."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, start_word long, n_words long, similarity double"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items in _blocks(benchmark, item_col, text_col):

        def scan(batches, items=items):
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, _, words, at in T.hashed(batch.column(1), lower=True):
                    for r, shared in items.sharing(words, at):
                        rows += [(i + r, items.ids[x], w, n, s) for x, w, n, s in items.search(words[at[r] : at[r + 1]], shared)]
                row, item, start, n, s = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(item, item_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        found = docs.select(id_col, text_col).mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no item, each row judged alone, whatever its id."""
    for items in _blocks(benchmark, item_col, text_col):

        def scan(batches, items=items, at_col=docs.columns.index(text_col)):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, words, at in T.hashed(batch.column(at_col), lower=True):
                    for r, shared in items.sharing(words, at):
                        clean[i + r] = not items.search(words[at[r] : at[r + 1]], shared)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
