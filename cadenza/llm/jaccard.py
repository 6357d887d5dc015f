"""Exact n-gram Jaccard join with prefix filters under several global orders.

A text's set holds the distinct shingles of SHINGLE lower-cased words.  Two sets
link when 100 * intersection >= 85 * union.  Under any order of all shingles, two
linked sets share one of the first n - ceil(0.85 n) + 1 shingles of either.  There
are three orders: the rarest shingles first, the commonest first, and by a hash
alone; a pair is a candidate if it shares a prefix shingle under every one, and is
then verified on the whole sets.  Pairs are drawn under the first order, so a
passage that many texts share joins no texts that hold enough of their own; the
others drop pairs that share a few rare shingles and no more.  Sets
also carry the parities of their shingles in 512 buckets: two sets differ in as
many shingles at least as they have different parities, which rules out pairs of
large groups before anything is joined.

Equal sets are one node from the start.  Among the rest, each prefix shingle's
sets are first compared with one of them, in a few rounds, at first with the one
of fewest shingles of its own; a shingle whose sets
are by then of one component needs no more.  All pairs of different components
that share prefix shingles are then compared, so no link between components is
lost, while a large group of near copies costs a few comparisons for each.

Shingle counts move between parts and shards as packed hashes.  A link's shingles
are compared by 56 bits of their hashes.

Edge cases: null and empty texts, and texts of white space, have empty sets and
link with nothing; fewer words than a shingle count as one whole sequence; rows
that share a doc_id are rows of their own, and a null doc_id is larger than any
other; an empty table gives no rows; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards as S
from . import text as T
from .components import components

U64 = np.uint64
SHINGLE = 4
PERCENT = 85
ORDERS = 3
#: Rounds in which sets are compared with one of each prefix shingle's sets.
LEADER_ROUNDS = 2
#: Words of 64 parities of a set.
PARITIES = 8
#: Bytes of a shingle's hash by which sets are compared.
BODY = 7

ORDER_COLUMNS = [f"order{k}" for k in range(ORDERS)]
WORDS = [f"w{k}" for k in range(PARITIES)]


def shingle_sets(texts: pa.ChunkedArray, shingle: int = SHINGLE):
    """For runs of texts: first row, the sorted distinct shingles of all, and their n + 1 offsets."""
    for i, j, words, at in T.hashed(texts, lower=True):
        count = np.diff(at)
        hashes = T.window_hashes(words, shingle)
        row = np.repeat(np.arange(j - i), count)
        inside = np.arange(len(hashes)) + shingle <= at[1:][row[: len(hashes)]]
        few = np.flatnonzero((count > 0) & (count < shingle))
        # The whole of a short text: a sum over its words that tells their order and number.
        place = np.arange(len(words)) - at[:-1][row]
        whole = np.zeros(j - i, U64)
        short = np.isin(row, few)
        np.add.at(whole, row[short], T.mix(words[short] + place[short].astype(U64) * U64(0x9E3779B97F4A7C15)))
        keys = np.concatenate([hashes[inside], T.mix(whole[few] ^ U64(0xA5A5A5A5A5A5A5A5))])
        rows = np.concatenate([row[: len(hashes)][inside], few])
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[fresh], rows[fresh]
        yield i, keys, np.searchsorted(rows, np.arange(j - i + 1))


def _names(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set."""
    padded = np.append(T.mix(keys ^ U64(0x6A09E667F3BCC909)), U64(0))
    sums = np.add.reduceat(padded, at[:-1]) if len(at) > 1 else padded[:0]
    return T.mix(np.where(np.diff(at) > 0, sums, U64(0)) + np.diff(at).astype(U64)).view(np.int64)


def _sizes(group: pa.Table) -> pa.Table:
    names, n = np.zeros(group.num_rows, np.int64), np.zeros(group.num_rows, np.int64)
    for i, keys, at in shingle_sets(group["text"]):
        n[i : i + len(at) - 1], names[i : i + len(at) - 1] = np.diff(at), _names(keys, at)
    # An empty set is a node of its own.
    S.give_back()
    alone = T.mix(pc.fill_null(group["doc_id"], -1).to_numpy().astype(np.int64).view(U64) ^ U64(0x3C6EF372FE94F82B)).view(np.int64)
    return pa.table({"part": group["part"], "doc_id": group["doc_id"], "n": pa.array(n), "name": pa.array(np.where(n > 0, names, alone))})


def _chosen(group: pa.Table, wanted: np.ndarray):
    """The sets of the part that are its to handle, each once: names, shingles, offsets."""
    wanted, seen = np.sort(wanted), set()
    for _, keys, at in shingle_sets(group["text"]):
        names = _names(keys, at)
        near = np.minimum(np.searchsorted(wanted, names), max(0, len(wanted) - 1))
        mine = (np.diff(at) > 0) & (wanted[near] == names if len(wanted) else False)
        rows = [r for r in np.flatnonzero(mine).tolist() if names[r] not in seen and not seen.add(names[r])]
        rows = np.array(rows, np.int64)
        sizes = np.diff(at)[rows]
        yield names[rows], keys[T.ragged(at[rows], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _wanted(right: pa.Table) -> np.ndarray:
    own = right.filter(pc.equal(right["shard"], -1))
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in own["keys"])])


def _linked(o: Column, na: Column, nb: Column) -> Column:
    return (100 + PERCENT) * o >= PERCENT * (na + nb)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, the smallest id that its links reach."""
    spark = docs.sparkSession
    shards = S.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = S.with_part(rows, S.parts_for(docs), "doc_id", "text").select("part", "doc_id", "text")
    sizes = S.kept(rows.groupBy("part").applyInArrow(_sizes, "part int, doc_id long, n long, name long"))

    # One row of each set handles it.
    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([-1], pa.int32()), "keys": pa.array([S.blob(group["name"].to_numpy())], pa.binary()), "more": pa.array([b""], pa.binary())})

    packed = "part int, shard int, keys binary, more binary"
    first = sizes.where("n > 0").groupBy("name").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "part")).alias("f"))
    handlers = first.select("name", "f.part").groupBy("part").applyInArrow(pack, packed)

    def ask(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        S.give_back()
        keys = np.concatenate([np.zeros(0, U64), *(S.narrow(k, shards) for _, k, _ in _chosen(left, _wanted(right)))])
        keys, count = np.unique(keys, return_counts=True)
        bounds = np.searchsorted(keys >> U64(32), np.arange(shards + 1, dtype=U64))
        full = np.flatnonzero(np.diff(bounds))
        cut = lambda x, kind: pa.array([S.blob(x[bounds[k] : bounds[k + 1]].astype(kind)) for k in full], pa.binary())
        return pa.table({"part": pa.array([key[0].as_py()] * len(full), pa.int32()), "shard": pa.array(full, pa.int32()), "keys": cut(keys, np.uint32), "more": cut(np.minimum(count, 65535), np.uint16)})

    def count(group: pa.Table) -> pa.Table:
        """Of each part's shingles, those that two sets hold, and in how many."""
        each = [np.frombuffer(x.as_py(), np.uint32) for x in group["keys"]]
        own = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in group["more"]])
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        held = np.minimum(np.bincount(at, own), 65535).astype(np.uint16)[at]
        ends, out = np.cumsum([len(k) for k in each]), []
        for k, e in zip(each, ends, strict=True):
            h = held[e - len(k) : e]
            out.append((S.blob(k[h > 1]), S.blob(h[h > 1])))
        return pa.table({"part": group["part"], "shard": group["shard"], "keys": pa.array([a for a, _ in out], pa.binary()), "more": pa.array([b for _, b in out], pa.binary())})

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        S.give_back()
        wanted = _wanted(right)
        right = right.filter(pc.greater_equal(right["shard"], 0))
        right = right.take(pc.sort_indices(right["shard"]))
        known = np.concatenate([np.zeros(0, U64), *((U64(s.as_py()) << U64(32)) | np.frombuffer(x.as_py(), np.uint32) for s, x in zip(right["shard"], right["keys"], strict=True))])
        held = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x.as_py(), np.uint16) for x in right["more"])])
        cols: dict[str, list] = {c: [] for c in ("name", "n", "own", *ORDER_COLUMNS, "parity", "body")}
        for names, keys, at in _chosen(left, wanted):
            near = np.minimum(np.searchsorted(known, S.narrow(keys, shards)), max(0, len(known) - 1))
            df = np.where(known[near] == S.narrow(keys, shards), held[near].astype(np.int64), 1) if len(known) else np.ones(len(keys), np.int64)
            for name, a, b in zip(names.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                n, d, k = b - a, df[a:b], keys[a:b]
                own, need = int((d == 1).sum()), (PERCENT * n + 99) // 100
                if n - own < need:
                    continue  # too few shingles that any other set holds
                orders = np.lexsort((T.mix(k ^ U64(1)), d)), np.lexsort((T.mix(k ^ U64(2)), -d)), np.argsort(T.mix(k ^ U64(3)))
                for column, order in zip(ORDER_COLUMNS, orders, strict=True):
                    best = order[: n - need + 1]
                    cols[column].append(k[best][d[best] > 1].view(np.int64))
                parity = np.bincount((T.mix(k ^ U64(0x1F83D9ABFB41BD6B)) % U64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
                shared = np.sort(k[d > 1] >> U64(8)).astype("<u8")
                body = shared.view(np.uint8).reshape(-1, 8)[:, :BODY].tobytes()
                for c, v in (("name", name), ("n", n), ("own", own), ("parity", np.packbits(parity.astype(np.uint8)).view(np.int64)), ("body", body)):
                    cols[c].append(v)
        out = {c: pa.array(cols[c], t) for c, t in (("name", pa.int64()), ("n", pa.int32()), ("own", pa.int32()))}
        out[ORDER_COLUMNS[0]] = pa.array(cols[ORDER_COLUMNS[0]], pa.list_(pa.int64()))
        # The other orders only rule pairs out, for which 32 bits do.
        out |= {c: pa.array([x.astype(np.int32) for x in cols[c]], pa.list_(pa.int32())) for c in ORDER_COLUMNS[1:]}
        words = np.array(cols["parity"], np.int64).reshape(-1, PARITIES)
        out |= {f"w{i}": pa.array(np.ascontiguousarray(words[:, i])) for i in range(PARITIES)}
        return pa.table(out | {"body": pa.array(cols["body"], pa.binary())})

    asked = rows.groupBy("part").cogroup(handlers.groupBy("part")).applyInArrow(ask, packed)
    counted = asked.groupBy("shard").applyInArrow(count, packed)
    schema = "name long, n int, own int, " + f"{ORDER_COLUMNS[0]} array<long>, " + "".join(f"{c} array<int>, " for c in ORDER_COLUMNS[1:]) + "".join(f"{w} long, " for w in WORDS) + "body binary"
    emitted = S.kept(rows.groupBy("part").cogroup(counted.unionByName(handlers).groupBy("part")).applyInArrow(emit, schema))
    prefixes = emitted.select("name", "n", "own", *WORDS, F.explode(ORDER_COLUMNS[0]).alias("token"))

    links, roots = None, None
    for k in range(LEADER_ROUNDS):
        near = _rooted(prefixes, roots)
        rank = F.struct((F.col("own") / F.col("n") if k == 0 else F.lit(0.0)).alias("share"), F.xxhash64("name", F.lit(k)).alias("h"), "name", "n", "own", "root", *WORDS)
        lead = near.groupBy("token").agg(F.min(rank).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        lead = lead.where("lo <> hi").select("token", "lead")
        pairs = near.join(lead, "token").where(F.col("root") != F.col("lead.root"))
        pairs = pairs.where(_possible(lambda c: F.col(c), lambda c: F.col(f"lead.{c}")))
        pairs = pairs.select(F.least("name", "lead.name").alias("a"), F.greatest("name", "lead.name").alias("b")).distinct()
        found = S.kept(_verified(pairs, emitted))
        links = found if links is None else links.unionByName(found)
        roots = components(links)

    near = _rooted(prefixes, roots)
    open_ = near.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    near = S.kept(near.join(open_, "token"))
    left, right = (near.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "own", "root", *WORDS))) for s in "ab")
    apart = (F.col("name_a") < F.col("name_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = left.join(right, "token").where(apart & _possible(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
    pairs = pairs.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()
    found = S.kept(_verified(pairs, emitted))
    if found.take(1):
        roots = components(links.unionByName(found))

    named = first.select("name", F.col("f.col1").alias("low")).join(roots.withColumnsRenamed({"node": "name"}), "name", "left").withColumn("root", F.coalesce("root", "name"))
    lowest = named.groupBy("root").agg(F.min("low").alias("low"))
    reached = named.select("name", "root").join(lowest, "root").select("name", "low")
    out = sizes.join(reached, "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("low") == 2**63 - 1, F.col("doc_id")).otherwise(F.coalesce("low", "doc_id")).alias("component_id"))


def _rooted(prefixes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return prefixes.withColumn("root", F.col("name"))
    return prefixes.join(roots.withColumnsRenamed({"node": "name"}), "name", "left").withColumn("root", F.coalesce("root", "name"))


def _possible(a, b) -> Column:
    """Whether sizes, what each set alone holds, and parities allow a link; a and b give the columns of either set."""
    na, nb = a("n").cast("long"), b("n").cast("long")
    most = F.least(na - a("own"), nb - b("own"))
    differ = sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in WORDS[1:]), F.bit_count(a(WORDS[0]).bitwiseXOR(b(WORDS[0]))))
    return _linked(most, na, nb) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (na + nb))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs, those that share a prefix shingle under all orders and link on their whole sets."""
    others = ORDER_COLUMNS[1:]
    a, b = (sets.select(F.col("name").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "body", *others))) for s in "ab")
    both = pairs.join(a, "a").join(b, "b")
    for c in others:
        both = both.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    both = both.select("a", "b", "n_a", "n_b", "body_a", "body_b")

    def check(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            (x, x_at), (y, y_at) = (T.buffers(batch.column(c)) for c in (4, 5))
            hit = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                u, v = _body(x[x_at[r] : x_at[r + 1]]), _body(y[y_at[r] : y_at[r + 1]])
                o = len(u) + len(v) - len(np.union1d(u, v))
                hit[r] = (100 + PERCENT) * o >= PERCENT * (int(na[r]) + int(nb[r]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit))
            S.give_back()

    return both.mapInArrow(check, "a long, b long")


def _body(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // BODY, 8), np.uint8)
    out[:, :BODY] = raw.reshape(-1, BODY)
    return out.view("<u8")[:, 0]


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the one with the smallest id, and of that with the smallest text; null ids come last."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        keep = S.kept(join(docs)).where("component_id = doc_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    # Ids don't tell rows apart: numbers in their order do.
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
    number = S.free_name("_row", docs.columns)
    rows = S.kept(rows.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn(number, F.monotonically_increasing_id()))
    keep = S.kept(join(rows, number)).where("component_id = doc_id").select(F.col("doc_id").alias(number))
    return rows.join(keep, number, "left_semi").select(*docs.columns)
