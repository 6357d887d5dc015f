"""Lexical retrieval packing.

Documents are dealt to shards by likeness: by the least hash of their words, then
by another, so that copies and documents of rare words in common meet.  Shards are
even in bytes: a likeness that fills more than its share is split over several by a
hash of the row.  Each shard builds a BM25 inverted index of its documents and
lays them out in windows: a seed document asks the
index for its nearest documents not yet used, which fill the window greedily in
order of score.  A document that does not fit is cut; its rest opens the next
window and is that window's seed.  Where a seed has no more neighbours, the next
unused document becomes a further seed of the same window.

All windows of a shard but the last few are full.  The tail is split into
sequences whose lengths are powers of two, so no sequence needs padding.

Edge cases: null and empty texts are documents of the end id alone; repeated
rows are packed as often as they occur; a null doc_id is kept as null; an empty
table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as S
from . import text as T
from . import tokens as K

#: BM25's usual constants.
K1, B = 1.2, 0.75

#: Bits of a document's likeness from its least word under two orders of words.
LIKENESS = (12, 4)


class Terms:
    """The distinct terms of some texts by their hashes, in order, and the (text, term) pairs with their counts."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        words, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, hashes, at in T.hashed(texts, lower=True):
            words.append(hashes)
            lengths.append(np.diff(at))
        coded = pa.array(np.concatenate(words)).dictionary_encode()
        self.lengths = np.concatenate(lengths)
        self.n, names = len(self.lengths), coded.dictionary.to_numpy()
        order = np.argsort(names)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, size = names[order], max(1, len(names))
        pairs, self.tf = np.unique(np.repeat(np.arange(self.n), self.lengths) * size + rank[coded.indices.to_numpy()], return_counts=True)
        self.doc, self.term = pairs // size, pairs % size
        self.df = np.bincount(self.term, minlength=len(names))


class Bm25Index:
    """Inverted index of a shard: for each term, its documents and their weights.

    ``held`` says how many documents of all shards hold each term, ``number`` and
    ``mean`` how many documents these have and of what length; without them, the
    terms' own texts are all.
    """

    def __init__(self, terms: Terms, held: np.ndarray | None = None, number: int = 0, mean: float = 0.0):
        if held is None:
            held, number, mean = terms.df, terms.n, terms.lengths.mean() if terms.n else 1
        self.doc, self.term, self.df, self.n = terms.doc, terms.term, terms.df, terms.n
        idf = np.log1p((number - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * terms.lengths / max(1e-9, mean))
        weight = idf[self.term] * terms.tf * (K1 + 1) / (terms.tf + norm[self.doc])
        self.weight = weight
        self.doc_at = np.searchsorted(self.doc, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = self.doc[order], weight[order]
        self.term_at = np.concatenate([[0], np.cumsum(self.df)])

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        terms = self.term[self.doc_at[seed] : self.doc_at[seed + 1]]
        terms = terms[self.df[terms] > 1]
        if not len(terms):
            return terms
        at = T.ragged(self.term_at[terms], self.df[terms])
        score = np.bincount(self.post_doc[at], self.post_weight[at], self.n)
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


ASKED = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("held", pa.binary()), ("n", pa.int64()), ("length", pa.int64())])
ASKED_SQL = "part int, shard int, keys binary, held binary, n long, length long"


def _summed(group: pa.Table) -> pa.Table:
    """For each part's terms at a shard, how many documents hold them; numbers and lengths of all documents."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in group["keys"]]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group["held"]])).astype(np.int64)[place]
    cut = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
    sums = (pc.sum(group[c]).as_py() for c in ("n", "length"))
    return S.table(ASKED, part=group["part"].combine_chunks(), shard=group["shard"].combine_chunks(), keys=[b""] * len(cut), held=[S.blob(x) for x in cut], **{c: [x] * len(cut) for c, x in zip(("n", "length"), sums, strict=True)})


def likeness(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A number of 16 bits for each text, equal with a chance of about the share of words in common."""
    out = np.zeros(len(texts), np.int64)
    for i, j, words, at in T.hashed(texts, lower=True):
        some = at[1:] > at[:-1]
        for seed, bits in enumerate(LIKENESS, 1):
            least = np.zeros(j - i, np.uint64)
            if some.any():
                least[some] = np.minimum.reduceat(T.mix(words ^ T.mix(np.array([seed], np.uint64))), at[:-1][some])
            out[i:j] = out[i:j] << bits | (T.mix(least) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Adds ``part`` to rows of doc_id and text: like texts share one, equal rows always, and all are of about the same size.

    The driver sees the bytes of each likeness, 65,536 numbers at most.
    """
    alike = F.arrow_udf(lambda texts: pa.array(likeness(texts), pa.int32()), "int")
    size = np.zeros(1 << sum(LIKENESS), np.int64)
    for r in rows.select(alike("text").alias("kind"), (F.octet_length("text") + 1).alias("size")).groupBy("kind").agg(F.sum("size").alias("size")).toLocalIterator():
        size[r["kind"]] = r["size"]
    first, share = np.cumsum(size) - size, max(1, -(-int(size.sum()) // parts))

    def part(texts: pa.Array, row: pa.Array) -> pa.Array:
        kind = likeness(texts)
        along = (row.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)) / 2.0**53
        return pa.array((first[kind] + (along * size[kind]).astype(np.int64)) // share, pa.int32())

    return rows.withColumn("part", F.arrow_udf(part, "int")("text", F.xxhash64("doc_id", "text")))


def layout(index: Bm25Index, lengths: np.ndarray, window: int) -> np.ndarray:
    """The order in which a shard's documents fill its windows."""
    n = len(lengths)
    used, order, room, next_free = np.zeros(n, bool), [], window, 0
    size = lengths.tolist()
    while len(order) < n:
        while used[next_free]:
            next_free += 1
        seed = next_free
        used[seed] = True
        order.append(seed)
        rest = size[seed]
        while True:
            while rest >= room:  # the seed fills this window; its rest opens the next
                rest, room = rest - room, window
            room -= rest
            rest = 0
            cut = -1
            for d in index.neighbours(seed, used).tolist():
                used[d] = True
                order.append(d)
                if size[d] >= room:
                    cut = d
                    break
                room -= size[d]
            if cut < 0:
                break
            rest, room = size[cut] - room, window
            if not rest:
                break
            seed = cut
    return np.array(order, np.int64)


def sequence_starts(total: int, window: int) -> np.ndarray:
    """Full windows, then powers of two."""
    starts, at = list(range(0, total - total % window, window)), total - total % window
    while at < total:
        starts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return np.array(starts, np.int64)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence; ``with_ids`` adds the piece's token ids."""
    vocabulary = vocabulary or K.vocabulary_path()
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")

    shards = S.partitions(docs.sparkSession)

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        terms = Terms(group["text"])
        keys, held, length = terms.hashes, terms.df, int(terms.lengths.sum())
        at = S.by_shard(keys, shards)
        cut = lambda x: [S.blob(x[at[k] : at[k + 1]]) for k in range(shards)]
        return S.table(ASKED, part=[key[0].as_py()] * shards, shard=list(range(shards)), keys=cut(keys), held=cut(held.astype(np.int64)), n=[group.num_rows] * shards, length=[length] * shards)

    def pack_shard(key: tuple[pa.Scalar, ...], group: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.take(pc.sort_indices(answers["shard"]))
        held = np.frombuffer(b"".join(answers["held"].to_pylist()), np.int64)
        number, length = answers["n"][0].as_py(), answers["length"][0].as_py()
        group = group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        texts = group["text"]
        ids, at = K.encoder(vocabulary).encode(texts)
        ids = np.insert(ids, at[1:], end_id)
        lengths = np.diff(at) + 1
        order = layout(Bm25Index(Terms(texts), held, number, length / number), lengths, window)
        first = np.concatenate([[0], np.cumsum(lengths[order])])
        stream = ids[T.ragged((np.cumsum(lengths) - lengths)[order], lengths[order])].astype("<u4")
        sequences = sequence_starts(len(stream), window)
        cuts = np.union1d(first, sequences)
        cuts, ends = cuts[cuts < len(stream)], np.append(cuts, len(stream))[1:]
        ends = ends[: len(cuts)]
        place, seq = np.searchsorted(first, cuts, "right") - 1, np.searchsorted(sequences, cuts, "right") - 1
        view = memoryview(stream).cast("B")
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        out = {
            "doc_id": group["doc_id"].take(pa.array(order[place])),
            "start": pa.array(cuts - first[place]),
            "length": pa.array(ends - cuts),
            "ids_crc32": pa.array(sums, pa.int64()),
            "doc_tokens": pa.array(lengths[order[place]]),
            "sequence_id": pa.array((key[0].as_py() << 32) + seq),
            "offset": pa.array(cuts - sequences[seq]),
        }
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(stream)), pa.int32()), pa.array(stream.astype(np.int32)))
        S.give_back()
        return pa.table(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = dealt(rows, S.parts_for(docs))
    answered = rows.groupBy("part").applyInArrow(ask, ASKED_SQL).groupBy("shard").applyInArrow(_summed, ASKED_SQL)
    return rows.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(pack_shard, SCHEMA + ", ids array<int>" * with_ids)
