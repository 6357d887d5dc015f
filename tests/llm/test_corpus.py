"""Corpus operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import components, ctw, decontaminate, jaccard, jpeg, media, packing, perplexity, pii, repeats, tokens, toxicity, wavelet
from cadenza.llm import shards as S
from cadenza.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def corpus(n=60, seed=5):
    """Invented prose with copies, near copies, passages that repeat, odd and empty texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(["th", "on", "er", "in", "an", "é", "ö", "Ti", "x-"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    prose = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    texts = [prose(rnd.randint(3, 120)) for _ in range(n)]
    texts[3] = texts[7] = texts[1]
    words = texts[2].split()
    for k in range(10, 20):
        changed = list(words)
        changed[rnd.randrange(len(words))] = f"edit{k % 4}"
        texts[k] = " ".join(changed)
    for k in range(20, 26):
        texts[k] = prose(20) + "\n" + passage + "\n" + prose(5)
    texts[30:40] = ["", None, " \n\t ", "one", "ONE", "one two", "one  two", " ", "<|endoftext|> it's 3.5% É", passage * 40]
    return [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (None, prose(30)), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those of the operators."""
    more = [(i, t, 1, "x", 2) for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, part int, name string, root int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def direct(texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- text and tokens -----------------------------------------------------------


def test_words_and_hashes(rows):
    texts = [t for _, t in rows]
    for i, j, hashes, at in T.hashed(pa.array(texts), lower=True):
        want = [WORD.findall(lower(t or "")) for t in texts[i:j]]
        assert np.diff(at).tolist() == [len(w) for w in want]
        flat = [w for x in want for w in x]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def alternating(n):
    """Two words of two letters whose sums of powers agree modulo 2 ** 64, whatever the base."""
    first = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_a_rule_are_told_apart(spark, n):
    a, b = alternating(n)
    data, offsets = T.buffers(pa.array([a, b]))
    assert len(set(T.word_hashes(data, offsets[:-1], offsets[1:]).tolist())) == 2
    ids, at = tokens.Encoder(tokens.vocabulary_path()).encode(pa.array([a, b, a]))
    assert [ids[x:y].tolist() for x, y in itertools.pairwise(at)] == [x[:-1] for x in direct([a, b, a], 0)]
    docs = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([a] * 13))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeats.digest(docs).collect()} == {1: 0, 2: 0, 3: 13}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_runs_are_hashed_in_order():
    rng = np.random.default_rng(2)
    words = [rng.integers(97, 123, n, np.uint8).tobytes() for n in (1, 7, 8, 9, 511, 512, 513, 4096, 4104, 40000) for _ in range(3)]
    swapped = [bytes(x) for w in words if len(w) > 8 for x in (w[8:16] + w[:8] + w[16:], w[:-8] + w[-8:][::-1], w + b"a", w[:-1])]
    words = list({*words, *swapped, *(b"a" * n for n in range(1, 700, 9))})
    data, offsets = T.buffers(pa.array(words, pa.binary()))
    hashes = T.word_hashes(data, offsets[:-1], offsets[1:])
    assert len(set(hashes.tolist())) == len(words)
    alone = [T.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert alone == hashes.tolist()  # whatever else is hashed along


def test_runs_that_add_up_are_told_apart():
    """Moving what one run of a word gains from the next one leaves a sum of runs as it was."""
    g, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    rnd = random.Random(1)
    for _ in range(200):
        a, b = rnd.getrandbits(64), rnd.getrandbits(64)
        pair = [x.to_bytes(8, "little") + y.to_bytes(8, "little") for x, y in ((a, b), ((b + g) & mask, (a - g) & mask))]
        assert len(set(T.word_hashes(np.frombuffer(b"".join(pair), np.uint8), np.array([0, 16]), np.array([16, 32])).tolist())) == 2


def test_windows_are_told_apart():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 5, 3000).astype(np.uint64)
    for width in (1, 2, 3, 4, 5, 7, 8, 13):
        names = {}
        for k, h in enumerate(T.window_hashes(words, width).tolist()):
            assert names.setdefault(h, tuple(words[k : k + width])) == tuple(words[k : k + width])
        assert len(names) == len({tuple(words[k : k + width]) for k in range(len(words) - width + 1)})


def test_words_are_known_by_their_bytes(monkeypatch):
    """Even where all hashes agree."""
    texts = ["one two three", "two Three's one", "four one"]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    monkeypatch.setattr(T, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[x:y].tolist() for x, y in itertools.pairwise(at)] == [x[:-1] for x in direct(texts, 0)]


def test_token_ids_are_the_library_s(rows):
    texts = [t for _, t in rows] + ["ΑΣ İ ﬁ 日本語", "don't 'S x1y2 a.b,c’s", "\x1c\x85z", "ÀÉ×÷ñ!"]
    ids, at = tokens.Encoder(tokens.vocabulary_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [x[:-1] for x in direct(texts, 0)]


# --- 1 and 5 -------------------------------------------------------------------


def test_packing(docs, rows):
    found = packing.pack(docs, window=64, with_ids=True).collect()
    want = collections.Counter((i, tuple(x)) for (i, _), x in zip(rows, direct([t for _, t in rows], 2), strict=True))
    pieces = collections.defaultdict(list)
    for r in found:
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        pieces[r["sequence_id"]].append(r)
    lengths = []
    for group in pieces.values():
        group.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in group] == list(itertools.accumulate([0] + [r["length"] for r in group[:-1]]))
        lengths.append(sum(r["length"] for r in group))
    assert all(n <= 64 and n & (n - 1) == 0 for n in lengths)
    assert sum(lengths) == sum(len(x) * n for (_, x), n in want.items())
    by_id = collections.defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append(r)
    for i, group in by_id.items():
        have = [(r["start"], r["ids"]) for r in group]
        for ids in (list(x) for (j, x), n in want.items() if j == i for _ in range(n)):
            at = 0
            while at < len(ids):  # one piece from each place on, that agrees
                part = next(p for p in have if p[0] == at and p[1] == ids[at : at + len(p[1])])
                have.remove(part)
                at += len(part[1])
        assert not have


def test_packing_puts_like_documents_together(spark):
    rnd = random.Random(1)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(8)]
    texts = [(i, " ".join(rnd.choice(topics[i % 8]) for _ in range(40))) for i in range(64)]
    index = packing.Bm25Index(packing.Terms(pa.array([t for _, t in texts])))
    order = packing.layout(index, np.full(64, 100), 800)
    same = sum(a % 8 == b % 8 for a, b in itertools.pairwise(order.tolist()))
    assert sorted(order.tolist()) == list(range(64)) and same > 40


def test_packing_weighs_terms_over_the_corpus_and_asks_with_all(spark):
    """A neighbour that shares only a seed's lightest terms is found; df, number and mean length are those of all texts."""
    seed = " ".join([f"r{k} " * 3 for k in range(16)] + ["light"])
    texts = pa.array([seed, "light other", "nothing", *(" ".join(f"r{k}" for k in range(16)) for _ in range(2))])
    index = packing.Bm25Index(packing.Terms(texts))
    assert set(index.neighbours(0, np.array([True, False, False, False, False])).tolist()) == {1, 3, 4}
    whole, halves = packing.Terms(texts), [packing.Terms(texts.slice(a, n)) for a, n in ((0, 2), (2, 3))]
    length = int(whole.lengths.sum())
    table = S.table(packing.ASKED, part=[0, 1], shard=[0, 0], keys=[S.blob(h.hashes) for h in halves], held=[S.blob(h.df.astype(np.int64)) for h in halves], n=[2, 3], length=[int(h.lengths.sum()) for h in halves])
    back = packing._summed(table).to_pylist()
    for h, r in zip(halves, back, strict=True):
        assert (r["n"], r["length"]) == (5, length)
        assert np.frombuffer(r["held"], np.int64).tolist() == whole.df[np.searchsorted(whole.hashes, h.hashes)].tolist()
    alone = packing.Bm25Index(halves[0], np.frombuffer(back[0]["held"], np.int64), 5, length / 5)
    assert alone.weight.tolist() == pytest.approx(index.weight[: len(alone.weight)].tolist())


def test_packing_deals_like_documents_to_one_part(spark):
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in random.integers(0, 5000, 120)) for _ in range(400)]
    near = [t + " changed" for t in texts]
    rows = [(k, t) for k, t in enumerate(texts + near)] + [(1000 + k, "one text that a third of all rows repeat " * 16) for k in range(400)] + [(2000, ""), (2001, " "), (2000, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.dealt(table, 20).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(rows)
    part = {r["doc_id"]: r["part"] for r in found}
    assert sum(part[k] == part[400 + k] for k in range(400)) > 340  # by chance: 20
    size = np.bincount([r["part"] for r in found], [len(r["text"]) + 1 for r in found], 20)
    assert len(size) == 20 and size.max() < 2 * size.mean()
    assert len({part[1000 + k] for k in range(400)}) > 4  # the hot text is split
    assert len({r["part"] for r in found if r["doc_id"] == 2000}) == 1


def test_packing_scores_are_bm25():
    """Against the formula, term by term; equal scores go by place."""
    rnd = random.Random(7)
    split = [[rnd.choice("abcdefghij") + rnd.choice("xyz") for _ in range(rnd.randint(0, 25))] for _ in range(40)]
    split[7] = list(split[5])
    index = packing.Bm25Index(packing.Terms(pa.array([" ".join(w) for w in split])))
    df = collections.Counter(t for w in split for t in set(w))
    mean = sum(map(len, split)) / len(split)

    def score(seed, d):
        tf = collections.Counter(split[d])
        idf = lambda t: math.log(1 + (len(split) - df[t] + 0.5) / (df[t] + 0.5))
        return sum(idf(t) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(split[d]) / mean)) for t in set(split[seed]) if tf[t])

    used = np.array([k % 9 == 0 for k in range(40)])
    for seed in range(40):
        want = sorted(((-round(score(seed, d), 9), d) for d in range(40) if not used[d] and score(seed, d) > 0))
        assert index.neighbours(seed, used).tolist() == [d for _, d in want]


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "tokens")
    wavelet.write_tokens(docs, path, tokens.vocabulary_path())
    found = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in wavelet.read_tokens(spark, path, with_ids=True).collect()), key=lambda r: r[0])
    order = sorted(zip(rows, direct([t for _, t in rows], 1), strict=True), key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[0][1] is not None, r[0][1] or ""))
    assert [(i, ids) for _, i, _, _, ids in found] == [(i, ids) for (i, _), ids in order]
    assert [s for s, *_ in found] == list(itertools.accumulate([0] + [r[2] for r in found[:-1]]))
    assert all(crc(ids) == c and len(ids) == n for _, _, n, c, ids in found)
    assert {(r["n_ends"]) for r in wavelet.read_tokens(spark, path, with_ids=True).collect() if r["ids"].count(1) == 1} == {1}


@pytest.mark.parametrize("chunk", [wavelet.CHUNK, 64])
def test_wavelet_matrix(monkeypatch, chunk):
    monkeypatch.setattr(wavelet, "CHUNK", chunk)
    x = np.random.default_rng(3).integers(0, 49408, 3000) % 97
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x).to_bytes())
    assert np.array_equal(m.symbols(), x)
    assert [m.access(i) for i in range(0, 3000, 37)] == x[::37].tolist()
    for s in (0, 5, 96, 400):
        where = np.flatnonzero(x == s).tolist()
        assert (m.count(s), m.positions(s), m.rank(s, 1500)) == (len(where), where, sum(i < 1500 for i in where))
        ends = np.array([0, 1, 511, 512, 513, 1500, 3000, 3000])
        assert m.ranks(s, ends).tolist() == [sum(i < e for i in where) for e in ends.tolist()]
    assert wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x[:0]).to_bytes()).symbols().tolist() == []
    with pytest.raises(IndexError):
        m.access(3000)
    with pytest.raises(ValueError, match="under 65536"):
        wavelet.WaveletMatrix.build(np.array([3, 65_536]))
    one = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x).to_bytes())
    assert one.access(7) == x[7] and len(one.inflated) <= wavelet.PLANES


# --- 2 -------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def groups(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    return [top(x) for x in range(n)]


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    top = groups(len(rows), links)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[top[k]].append(math.inf if i is None else i)
    return sorted(((i, len(sets[k]), None if min(low[top[k]]) == math.inf else min(low[top[k]])) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard(docs, rows):
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()), key=str) == brute_components(rows)


def test_jaccard_near_copies_about_the_bound(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            w[rnd.randrange(120)] = f"e{rnd.randrange(6)}"
        rows.append((i, " ".join(w)))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str) == brute_components(rows)


def test_one_of_each(docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*(str(i) for i in want if i is not None), "None", "None"])


def test_one_of_each_with_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    rows = [(1, a), (1, b), (2, b), (3, c), (None, c), (None, d), (None, d), (4, a)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", a), ("1", b), ("3", c), ("None", d)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert len({found[k] for k in range(41)}) == 1 and found[100] == found[101] != found[0] and len(found) == 43


# --- 3 -------------------------------------------------------------------------


def test_decontamination(spark):
    rnd = random.Random(2)
    prose = lambda k: [f"v{rnd.randrange(400)}" for _ in range(k)]
    items = [(k, " ".join(prose(rnd.randint(20, 50)))) for k in range(12)] + [(12, "tiny item"), (13, ""), (14, None)]
    texts = []
    for i in range(40):
        w = prose(80)
        if i % 3 == 0:
            leak = items[i % 12][1].split()
            if i % 2:
                leak[len(leak) // 2] = "changed"
            w[30:30] = leak
        texts.append((i, " ".join(w).upper() if i == 3 else " ".join(w)))
    texts += [(50, "a TINY item"), (51, None), (52, ""), (None, items[0][1])]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, item_id string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    bag = lambda w, n: collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    split = {i: WORD.findall(lower(t)) for i, t in items if t}
    holders = collections.Counter(s for w in split.values() for s in set(bag(w, min(5, len(w)))))
    weight = lambda s: 1 + math.log(len(split) / holders[s]) if s in holders else 1 + math.log(len(split))
    want = {}
    for i, t in texts:
        w = WORD.findall(lower(t or ""))
        for j, item in split.items():
            n, size = min(5, len(item)), min(len(item), len(w))
            own, best = bag(item, n), 0
            for k in range(len(w) - size + 1):
                b = bag(w[k : k + size], n)
                both = sum(weight(s) * min(c, own[s]) for s, c in b.items())
                best = max(best, both / (sum(weight(s) * c for s, c in b.items()) + sum(weight(s) * c for s, c in own.items()) - both) if b else 0)
            if best >= 0.8:
                want[i, j] = best
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    kept = decontaminate.drop(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in want}  # without the null id, whose text is an item
    named = spark.createDataFrame([(f"item {k}", t) for k, t in items], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, named).collect()} == {(i, f"item {j}") for i, j in want}
    again = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 1"))
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop(again, named).collect()) == sorted([*(str(r["doc_id"]) for r in kept.collect()), "1"])
    none = decontaminate.find(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "item_id", "start_word", "n_words", "similarity"]


def test_decontamination_at_the_bound():
    """Items with words replaced at both ends, similarity 0.8 to 0.85, against brute force over all windows."""
    rnd = np.random.default_rng(4)
    words = [rnd.integers(0, 1 << 62, n).astype(np.uint64) for n in (13, 24, 33, 42, 50) for _ in range(40)]
    items, far, bound = decontaminate.Items(list(range(len(words))), words), 0, 0
    for k, own in enumerate(words):
        for changed in range(1, 7):
            leak = own.copy()
            leak[: changed // 2], leak[len(own) - changed + changed // 2 :] = (rnd.integers(0, 1 << 62, m).astype(np.uint64) for m in (changed // 2, changed - changed // 2))
            text = np.concatenate([rnd.integers(0, 1 << 62, 30).astype(np.uint64), leak, rnd.integers(0, 1 << 62, 30).astype(np.uint64)])
            best = max(items.similarity(text[w : w + len(own)], k) for w in range(len(text) - len(own) + 1))
            found = {i: s for i, _, _, s in items.search(text, np.array([k]))}
            assert found == ({k: best} if best >= decontaminate.SIMILARITY else {})
            bound += 0.8 <= best <= 0.85
            far += best >= 0.8 and np.bitwise_count(items.prints[k] ^ decontaminate.simhashes(decontaminate._planes(leak), len(own))[0]) > decontaminate.RADIUS
    assert bound > 50 and far > 5


def test_every_fingerprint_within_the_radius_is_found():
    rnd = np.random.default_rng(0)
    words = [rnd.integers(0, 1 << 62, 30).astype(np.uint64) for _ in range(20)]
    items = decontaminate.Items(list(range(20)), words)
    for r in range(decontaminate.RADIUS + 1):
        flips = np.array([sum(1 << int(b) for b in rnd.choice(64, r, replace=False)) for _ in range(20)], np.uint64)
        window, item = items.near(items.prints ^ flips)
        assert {(k, k) for k in range(20)} <= set(zip(window.tolist(), item.tolist(), strict=True))


# --- 4 -------------------------------------------------------------------------


def test_marginals_are_those_of_all_labellings():
    rnd = np.random.default_rng(4)
    emission, moves = rnd.normal(size=9), rnd.normal(size=(2, 2))
    at, pairs = np.array([0, 4, 4, 5, 9]), np.zeros((2, 2))
    p = toxicity.marginals(emission, at, moves, pairs)
    expected = np.zeros((2, 2))
    for a, b in itertools.pairwise(at.tolist()):
        total, ones = 0.0, np.zeros(b - a)
        both = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(e for e, v in zip(emission[a:b], y, strict=True) if v) + sum(moves[i, j] for i, j in itertools.pairwise(y)))
            total += w
            ones += w * np.array(y)
            for i, j in itertools.pairwise(y):
                both[i, j] += w
        assert p[a:b] == pytest.approx(ones / total) if b > a else True
        expected += both / max(total, 1e-300)
    assert pairs == pytest.approx(expected)


def test_marginals_of_a_very_long_chain():
    rnd = np.random.default_rng(5)
    emission, moves, at = rnd.normal(-2, 3, 30_000), rnd.normal(size=(2, 2)), np.array([0, 1, 1, 17, 29_000, 30_000])
    p, psi = toxicity.marginals(emission, at, moves), np.exp(moves)
    for a, b in itertools.pairwise(at.tolist()):
        forward, back = np.ones((b - a, 2)), np.ones((b - a, 2))
        weight = np.stack([np.ones(b - a), np.exp(emission[a:b])], axis=1)
        for t in range(b - a):
            forward[t] = (forward[t - 1] @ psi if t else 1) * weight[t]
            forward[t] /= forward[t].sum()
        for t in range(b - a - 2, -1, -1):
            back[t] = psi @ (back[t + 1] * weight[t + 1])
            back[t] /= back[t].sum()
        both = forward * back
        assert p[a:b] == pytest.approx(both[:, 1] / both.sum(axis=1), abs=1e-9) if b > a else True


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(6)
    texts, toxic = [], []
    for i in range(400):
        w = [f"word{rnd.randrange(150)}" for _ in range(rnd.randint(5, 60))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "scum,", "vilest" + rnd.choice("abcdefgh")]))
        texts.append((i, " ".join(w)))
        toxic.append(int(bad))
    docs = spark.createDataFrame([*texts, (400, None), (401, ""), (402, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, toxic[0]), (401, None), (None, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.train(docs, labels, F.col("doc_id") % 2 == 0)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model, with_spans=True).collect()}
    assert all((found[i]["score"] >= toxicity.THRESHOLD) == bool(t) for i, t in enumerate(toxic) if i % 2)
    i = next(i for i in range(1, 400, 2) if toxic[i])
    spans = [texts[i][1][s["start"] : s["end"]] for s in found[i]["toxic_spans"]]
    assert spans and all(re.search("idiot|scum|vilest", s) for s in spans)
    assert found[400]["score"] == found[401]["score"] < toxicity.THRESHOLD
    nothing = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


# --- 6 -------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, x):
    g = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(g))))
        return 13 <= len(g) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(g) <= 15


PII = [
    "mail a@b.c-d@e.f or x.y+z@host.example.org, a@b a@@b.c é@b.c a@b.c_d@e.f", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 001.002.003.004 10.0.0.255x 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0000000000000000 1 2", "call +1 (555) 123-4567 or +33.1.23.45.67.89 +12 +1------2 ++4912345678901234567",
    "é😀 a@b.co 日本 4111111111111111 +49 30 1234567", "", None, "9" * 30000, "1 " * 20000, "a" * 50000 + "@", "a." * 20000 + "@b.c", "1." * 20000, "+1" + " " * 30000, "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, DE89370400440532013001",
]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PII)] + [(0, PII[0])], "doc_id long, text string")
    found = pii.digest(docs).collect()
    assert len(found) == len(PII) + 1
    for r in found:
        text, spans, counts = PII[r["doc_id"]] or "", [], {}
        for kind, pattern in BASE.items():
            hits = [m.span() for m in re.finditer(pattern, text) if right(kind, m.group())]
            counts[kind] = len(hits)
            spans += [f"{kind}:{a}:{b}" for a, b in hits]
        assert {k: r[f"n_{k}"] for k in BASE} == counts, r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert r["spans"].startswith(",".join(spans))
    assert {r["doc_id"]: r["n_iban"] for r in found}[len(PII) - 1] == 2
    top = {r["doc_id"]: r["top_score"] for r in found}
    assert top[2] == 0.95 and top[5] == 0.0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "write to a@b.co or +1 555 123 4567 now", 7), (2, None, 8), (3, "nothing", 9)], "doc_id long, text string, spans int")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "write to [EMAIL] or [PHONE] now", 7), (2, None, 8), (3, "nothing", 9)]


def test_personal_data_runs_no_python(spark):
    plan = pii.digest(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 7 -------------------------------------------------------------------------


def test_kneser_ney_is_a_distribution(spark):
    texts = ["a b a b c", "b c d", "a b c d e", "a a a", "c d"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = perplexity.train(docs, docs.select("doc_id"))
    words = {w: T.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([1]))[0] for w in "abcdexyz"}
    every = np.array([*(words[w] for w in "abcde"), perplexity.END], np.uint64)
    for u, v in (("a", "b"), ("x", "y"), ("b", "c"), ("x", "d")):
        p = 10 ** model.log10(np.full(6, words[u]), np.full(6, words[v]), every)
        unseen = 10 ** model.log10(*(np.array([words[w]]) for w in (u, v, "z")))[0]
        assert p.sum() + unseen == pytest.approx(1)
        assert (p > 0).all()


def test_quality_classifier(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the cat sat", "on the mat", "and then", "it ran home"]) for _ in range(20))
    junk = lambda: " ".join("q" + str(rnd.randrange(10**6)) for _ in range(40))
    rows = [(i, good() if i < 200 else junk(), "en" if i % 2 else None) for i in range(240)] + [(300, None, "fr"), (301, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(120)] + [(None,)], "doc_id long")
    found = {r["doc_id"]: r for r in perplexity.classify(docs, trusted).collect()}
    assert len(found) == len(rows)
    assert not any(found[i]["keep"] for i in range(200, 240))
    assert sum(found[i]["keep"] for i in range(120, 200)) >= 70
    untrained = perplexity.classify(docs, trusted.where("doc_id < 0"))
    assert all(r["keep"] for r in untrained.collect())


def test_quality_thresholds_against_sorted_rows(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["de", "en", None]), 10 ** rnd.choice([rnd.uniform(0, 5), 1.25, 300.0])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "lang string, perplexity double")
    for quantile in (0.02, 0.5, 0.98):
        found = {r["lang"]: r["threshold"] for r in perplexity.thresholds(df, ["lang"], quantile).collect()}
        assert set(found) == {"de", "en", None, "one"}
        for lang, mark in found.items():
            own = sorted(p for at, p in rows if at == lang and p is not None)
            exact = own[math.ceil(quantile * len(own)) - 1]
            assert exact * (1 - 1e-9) <= mark <= exact * 10**0.0010001
    assert perplexity.thresholds(df.limit(0), ["lang"], 0.5).count() == 0 and perplexity.thresholds(df.limit(0), [], 0.5).first()[0] is None


def test_quality_in_turns_is_the_same_and_gives_disk_back(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{int(rnd.random() ** 2 * 500)}" for _ in range(rnd.randint(0, 900))), "en") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: sum(p.stat().st_size for p in local.rglob("shuffle_*.data"))
    before = held()
    counts, sums = perplexity.count(docs, docs.where("doc_id < 120").select("doc_id"), 5)
    one, four = ({r["doc_id"]: r for r in perplexity.score(docs, counts, sums, 5, rounds=k).collect()} for k in (1, 4))
    assert one == four and len(one) == len(rows)
    assert held() - before < sum(len(t) for _, t, _ in rows) // 4  # the texts alone take more while they are shuffled
    plan = counts.groupBy("home").applyInArrow(lambda group: group, counts.schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_quality_model_learns_from_all_trusted_texts(spark):
    rnd = random.Random(8)
    prose = lambda k: " ".join(f"w{int(rnd.random() ** 2 * 60)}" for _ in range(k))
    rows = [(i, prose(rnd.randint(0, 6)), "en") for i in range(1_700)] + [(1_700, prose(9_000), "en"), (1_701, "w1 w2 unseen", "en"), (1_702, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(1_701)], "doc_id long")
    found = {r["doc_id"]: r for r in perplexity.classify(docs, trusted, learn=F.col("doc_id") % 20 != 1).collect()}
    padded = {i: ["<s>", "<s>", *(t or "").split(), "</s>"] for i, t, _ in rows}
    three = collections.Counter(tuple(w[k - 2 : k + 1]) for i, w in padded.items() if i <= 1_700 and i % 20 != 1 for k in range(2, len(w)))
    two = collections.Counter(g[1:] for g in three)
    counts = [collections.Counter(g[1:] for g in two), two, three]
    of, cuts = [], []
    for table in counts:
        n = collections.Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / max(1, n[3])] if y else [0.5] * 3
        cuts.append([0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])
        of.append(collections.defaultdict(list))
        for g, c in table.items():
            of[-1][g[:-1]].append(c)

    def probability(g, order):
        own, d = of[order].get(g[:-1]), cuts[order]
        shorter = probability(g[1:], order - 1) if order else 1 / (len(counts[0]) + 1)
        if not own:
            return shorter
        c = counts[order][g]
        return (c - d[min(c, 3)]) / sum(own) + sum(d[min(x, 3)] for x in own) / sum(own) * shorter

    for i in (*range(0, 1_700, 50), 1_700, 1_701, 1_702):
        w = padded[i]
        assert found[i]["n_tokens"] == len(w) - 2
        assert found[i]["log10_prob"] == pytest.approx(sum(math.log10(probability(tuple(w[k - 2 : k + 1]), 2)) for k in range(2, len(w)))), i


# --- 8 -------------------------------------------------------------------------


def test_media_round_trip(spark, docs, rows):
    found = media.load(media.store(docs)).collect()
    assert len(found) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == want
    by = collections.defaultdict(set)
    for r in found:
        by[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())


def test_media_are_colour_files():
    """Payloads lie in luma and in subsampled chroma, and the feature is that of the RGB tensor, whatever the batch."""
    raw = [b"", b"x", bytes(range(32, 127)) * 9, b"ab" * 5000, "größe 数".encode() * 70]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    images = jpeg.decode(media.store_bytes(data, offsets))
    for image, r, (n, payload), found in zip(images, raw, media.load_bytes(images), media.features(images), strict=True):
        assert n == len(r) and payload == (r + bytes(-len(r) % 64) if r else bytes(64))
        assert [(c.h, c.v) for c in image.components] == [(2, 1), (1, 1), (1, 1)]
        pixels = jpeg.rgb(image).astype(int)
        assert pixels.shape == (image.height, image.width, 3)
        want = [image.width, image.height, *pixels.sum((0, 1)), *(pixels**2).sum((0, 1)), *abs(np.diff(pixels, axis=1)).sum((0, 1)), *abs(np.diff(pixels, axis=0)).sum((0, 1))]
        assert found == ":".join(map(str, want)) == media.features([image])[0]
    chroma = images[2].blocks[images[2].components[1].base - images[2].components[0].base :]
    assert chroma.any() and len(np.unique(jpeg.rgb(images[2])[:, :, 0] != jpeg.rgb(images[2])[:, :, 1])) == 2


def test_transform_and_zigzag():
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(jpeg.ZIGZAG) == list(range(64))
    assert jpeg.INVERSE @ jpeg.INVERSE.T == pytest.approx(np.eye(64))


def test_refined_coefficients_of_all_sizes():
    rnd = np.random.default_rng(8)
    blocks = np.where(rnd.random((40, 64)) < 0.3, rnd.integers(-200, 200, (40, 64)), rnd.integers(-1, 2, (40, 64))).astype(np.int32)
    blocks[3], blocks[4, 1:] = 0, 0
    images = np.array([0, 1, 13, 40])
    files = jpeg.encode_gray(blocks, images, [(8, 8), (8 * 3, 8 * 4), (8 * 9, 8 * 3)], [b"a", b"b", b"c"])
    for image, a, b in zip(jpeg.decode(files), images, images[1:], strict=False):
        assert np.array_equal(image.blocks, blocks[a:b])
    assert [i.comment for i in jpeg.decode(files)] == [b"a", b"b", b"c"]


def colour_file():
    """A 4:2:0 file by hand: one 16x16 MCU with flat planes, DC scans interleaved, in two approximations."""
    dc = jpeg.TABLES["dc"]
    values = [40, 40, 40, 40, -30, 50]  # luma blocks, then both chroma blocks

    def bits(pairs):
        text = "".join(format(v, f"0{n}b") for v, n in pairs if n)
        data = int(text + "1" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8, "big")
        return data.replace(b"\xff", b"\xff\0")

    def coded(v):
        size = abs(v).bit_length()
        return [(int(dc.code[size]), int(dc.length[size])), (v if v > 0 else v + (1 << size) - 1, size)]

    diffs, before = [], {}
    for k, v in enumerate(values):
        slot = max(0, k - 3)
        diffs += coded((v >> 1) - before.get(slot, 0))
        before[slot] = v >> 1
    frame = b"\x08" + (16).to_bytes(2, "big") * 2 + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = lambda ah_al: jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, ah_al]))
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [8] * 64)) + jpeg._code_table(0, 0, dc) + jpeg._segment(0xC2, frame)
    return head + scan(0x01) + bits(diffs) + scan(0x10) + bits([(v & 1, 1) for v in values]) + b"\xff\xd9"


def test_colour_with_subsampled_chroma(spark):
    pixels = jpeg.rgb(jpeg.decode([colour_file()])[0])
    y, cb, cr = 128 + 40, -30, 50
    want = [round(y + 1.402 * cr), round(y - 0.344136 * cb - 0.714136 * cr), round(y + 1.772 * cb)]
    assert pixels.shape == (16, 16, 3) and (pixels == np.clip(want, 0, 255)).all()
    df = spark.createDataFrame([(1, bytearray(colour_file())), (2, None), (3, bytearray(b"junk"))], "id int, media binary")
    rows = {r["id"]: r for r in media.tensors(df).collect()}
    assert (rows[1]["height"], rows[1]["width"], bytes(rows[1]["rgb"])) == (16, 16, pixels.tobytes())
    assert rows[2]["rgb"] is None and rows[3]["rgb"] is None


# --- 9 -------------------------------------------------------------------------


def brute_repeats(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [math.inf if i is None else i for i, _ in rows]
    low = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            low[key] = min(low.get(key, math.inf), i)
    out = []
    for (name, _), i, w in zip(rows, ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if low[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((name, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_repeats(docs, rows):
    want = brute_repeats(rows)
    found = repeats.digest(docs).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found))) == sorted(str((i, n, k, digest(t))) for i, n, k, t in want)
    assert sum(k for *_, k, _ in want) > 200
    left = repeats.remove(docs.select("part", "doc_id", "name", "text"))
    assert left.columns == ["part", "doc_id", "name", "text"] and {(r["part"], r["name"]) for r in left.collect()} == {(1, "x")}
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(str((i, t)) for i, _, _, t in want)


def test_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


# --- 10 ------------------------------------------------------------------------


def brute_running_ctw(train, test):
    """Log10 probability of documents by the recursion over whole context trees, in plain Python."""
    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(tokens):
        data = b"".join(t + b" " for t in tokens)
        for k, symbol in enumerate(data):
            past = (b" " * ctw.DEPTH + data[:k])[-ctw.DEPTH :][::-1]
            for level in range(8):
                yield past, (1 << level) | symbol >> (8 - level), symbol >> (7 - level) & 1

    for past, node, bit in itertools.chain.from_iterable(map(steps, train)):
        for d in range(ctw.DEPTH + 1):
            counts[node, past[:d]][bit] += 1
            children[node, past[: d - 1] if d else None].add(past[:d])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node, c):
        if (node, c) not in memo:
            own = kt(*counts[node, c])
            below = sum(weighted(node, x)[0] for x in children[node, c]) if len(c) < ctw.DEPTH else None
            memo[node, c] = (own, 1.0) if below is None else (math.log(0.5) + np.logaddexp(own, below), 1 / (1 + math.exp(min(700, below - own))))
        return memo[node, c]

    total = 0.0
    for past, node, bit in steps(test):
        p = 0.5
        for d in range(ctw.DEPTH, -1, -1):
            if (node, past[:d]) in counts:
                a, b = counts[node, past[:d]]
                share = weighted(node, past[:d])[1]
                p = share * (b + 0.5) / (a + b + 1) + (1 - share) * p
        total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree(docs, rows):
    found = ctw.score(docs, F.col("doc_id") % 5 == 2).collect()
    held = lambda i: i is not None and i % 5 == 2
    token_lists = [(i, [w.encode() for w in WORD.findall(lower(t or ""))] + [b""]) for i, t in rows]
    train = [ws for i, ws in token_lists if not held(i)]
    c = collections.Counter(w for ws in train for w in ws)
    n = c.total()
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws), 6), held(i)) for i, ws in token_lists)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["held_out"]) for r in found) == want
    assert {r["train_tokens"] for r in found} == {n}
    by = {r["doc_id"]: r["score"] for r in found if r["doc_id"] is not None}
    for i, ws in token_lists:
        if i in (2, 7, 30, 37, 52):
            assert by[i] == pytest.approx(brute_running_ctw(train, ws), rel=1e-6)


def test_contexts_in_passes(rows, monkeypatch):
    """In many passes as in one, and as counted one by one."""
    texts = pa.chunked_array([[t for _, t in rows]])
    learned = np.arange(len(rows)) % 3 > 0
    want = collections.Counter()
    for (_, t), keep in zip(rows, learned.tolist(), strict=True):
        data = b" " * 7 + b"".join(w.encode() + b" " for w in WORD.findall(lower(t or ""))) + b" "
        for k in range(7, len(data)):
            want[int.from_bytes(data[k - 7 : k][::-1] + data[k : k + 1], "big")] += keep
    for places in (ctw.PLACES, 50):
        monkeypatch.setattr(ctw, "PLACES", places)
        keys, counts = ctw.distinct(texts, learned)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys.astype(float)) > 0).sum() >= 0 and keys.tolist() == sorted(want)


def test_packed_arrays():
    for x in (np.zeros(0, np.int64), np.array([3, 200, 70_000]), np.array([-1, 5]), np.array([1.5, -2], np.float32), np.array([1, 1 << 63], np.uint64)):
        assert S.unpacked(S.packed(x)).tolist() == x.tolist()


def test_a_word_costs_less_after_the_one_it_follows(spark, tmp_path):
    from cadenza.llm import queries

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, ("xa b", "xc d")[k % 2]) for k, i in enumerate(i for i in range(90) if zlib.crc32(str(i).encode()) % 7 != 2)] + list(zip(held, ("xa b", "xa d"), strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by = {r["doc_id"]: r["score"] for r in queries.op10_context_tree(spark, str(tmp_path)).collect()}
    assert by[held[0]] > by[held[1]] + 0.5


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 1000.5, 1e9])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


# --- all -----------------------------------------------------------------------


def test_empty_tables(spark, empty):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, item_id long, text string")
    made = [
        packing.pack(empty), jaccard.join(empty), decontaminate.find(empty, none), toxicity.score(empty, toxicity.train(empty, none)), pii.digest(empty), perplexity.classify(empty, none.select("doc_id")),
        media.load(media.store(empty)), repeats.digest(empty), ctw.score(empty, F.lit(False)), wavelet.token_files(empty), jaccard.one_of_each(empty), repeats.remove(empty), pii.redact(empty),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_very_long_texts(spark):
    """One text of 150,000 words and one of a word of 300,000 letters, through every operator."""
    rnd = random.Random(11)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(150_000))
    rows = [(1, long, "en"), (2, "x" * 300_000, "en"), (3, long[:-3] + "end", "en"), (4, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.digest(docs).collect()}
    assert gone[1] == (150_000, 0) and gone[3][1] == 149_999 and gone[2] == (1, 0)
    tokens_of = {r["doc_id"]: r["n_tokens"] for r in wavelet.token_files(docs).collect()}
    packed = collections.Counter()
    for r in packing.pack(docs).collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == tokens_of
    items = spark.createDataFrame([(0, " ".join(long.split()[70_000:70_040]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find(docs, items).collect()} == {1, 3}
    model = toxicity.fit([f"vile scum {k}" for k in range(9)] + [f"fine day {k}" for k in range(9)], [1] * 9 + [0] * 9, 0.5)
    assert toxicity.score(docs, model).count() == 4
    assert {r["doc_id"]: r["n_tokens"] for r in perplexity.classify(docs, docs.where("doc_id = 4").select("doc_id")).collect()} == {1: 150_001, 2: 2, 3: 150_001, 4: 2}
    assert {r["doc_id"]: r["n_tokens"] for r in ctw.score(docs, F.col("doc_id") == 3).collect()} == {1: 150_001, 2: 2, 3: 150_001, 4: 2}
    assert {r["doc_id"]: r["n_bytes"] for r in media.load(media.store(docs)).collect()} == {i: len(t) for i, t, _ in rows}


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three", "x", "y")], "doc_id long, text string, a string, b string")
    clash = docs.select("doc_id", "text", F.col("a").alias("score"), F.col("b").alias("media"), F.lit(1).alias("height"), F.lit(2).alias("_spans"), F.lit(3).alias("keep"))
    model = toxicity.fit([], [], 0.0)
    assert toxicity.score(clash, model).first()["score"] == 0.0
    assert media.load(media.store(clash)).first()["n_bytes"] == 13
    assert media.tensors(media.store(clash)).first()["height"] == 8
    assert tuple(pii.redact(clash).first()) == tuple(clash.first()) and pii.digest(clash).count() == 1
    assert jaccard.one_of_each(clash).columns == clash.columns
    more = docs.select("*", *(F.lit(1).alias(c) for c in ("lang", "n_tokens", "log10_prob", "perplexity", "threshold", "keep", "item_id", "start_word", "similarity", "part", "score")))
    assert perplexity.classify(more, docs.select("doc_id")).columns[-2:] == ["threshold", "keep"]
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.find(more, items).count() == 1 and decontaminate.drop(more, items).columns == more.columns
    assert packing.pack(more).count() > 0 and repeats.digest(more).count() == 1 and ctw.score(more, F.lit(False)).count() == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    prose = lambda k: " ".join(f"w{rnd.randrange(900)}" for _ in range(k))
    item = prose(30)
    clean = [prose(rnd.randint(20, 80)) for _ in range(80)]
    texts = [*clean, *(prose(20) + " vile scum idiot " + prose(5) for _ in range(30)), clean[0], clean[1] + " end", prose(10) + " " + item, "mail me@here.org"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(80 <= i < 110)) for i in range(105)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == {*range(80), 113}
    want = dict(zip([*range(80), 113], direct([*clean, "mail [EMAIL]"], 2), strict=True))
    assert all(r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in found)
    assert sum(r["length"] for r in found) == sum(len(x) for x in want.values())


def test_a_long_labelled_text_switches_nothing_off(spark):
    rnd = random.Random(9)
    prose = lambda k: " ".join(f"w{rnd.randrange(300)}" for _ in range(k))
    rows = [(i, prose(30) + (" vile scum idiot" if i % 2 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, toxic int")
    scores = []
    for more in ("", "w1 scum " * 7_000_000):
        docs = spark.createDataFrame([*rows, (60, prose(30) + more), (61, prose(30) + more)], "doc_id long, text string")
        model = toxicity.train(docs, labels)
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id < 60"), model).collect()})
    assert all((s[i] > 0.5) == bool(i % 2) for s in scores for i in s)
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 0.2


def test_pipeline_keeps_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _row string"
    rows = [(1, "one two three four five six", "en", "s", 27, 0.5, "u"), (1, "one two three four five six", "en", "s", 27, 0.5, "u"), (None, "seven eight nine ten eleven", None, None, None, None, "v"), (None, None, None, None, None, None, None), (2, None, "en", "s", 0, 1.0, "w"), (3, "", "en", "s", 0, 2.0, "x")]
    for name, given in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(given, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if given else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(0, "an item of the benchmark that no text holds")] if given else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept = docs.collect()
        assert {(r["doc_id"], r["score"], r["_row"]) for r in kept} == {(r[0], r[5], r[6]) for r in given}
        assert len(kept) == (5 if given else 0)
        packed = corpus_pipeline.run(spark, folder).collect()
        assert (len(packed) > 0) == bool(given)
