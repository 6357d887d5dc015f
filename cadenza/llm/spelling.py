"""Groups of spelling variants: words one edit apart, and the commoner form of each.

The vocabulary is counted with DataFrame functions.  Letters are dealt to ``CLASSES``
classes of about equal use, and words with equal letter counts by class (hence of equal
length) are a block.  An edit moves a word to its own block, to one where a letter has
changed class, or to one of an adjacent length, so only such blocks are compared.  A
comparison is one product of two matrices of letter counts: with the norms it gives the
squared distances of all pairs, which is 2 for a replaced letter and 1 for an inserted
or deleted one; the pairs that are left are compared letter by letter.

How it runs: a block is cut into chunks of some hundred words by hash, so a block that
holds a third of all words is many rows.  A chunk visits the chunks of the blocks it may
have near words in, half of them, as the relation is mutual; these rows are sorted by
the chunk visited, and a task holds one such chunk and a few thousand words of visitors.
It returns one row for each word and group of visitors, which Spark sums up: how many
near words, and the commonest.  No pair leaves a task.

Edge cases: null texts have no words, a null id is written as the empty text; the range
of letters includes the two signs between them (multiplication and division); words may
be of any length; repeated rows count each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards as S

CLASSES = 6
#: Words of a chunk, and their letters in all; words whose products are made at once.
CHUNK, CHUNK_LETTERS, VISITORS = 512, 1 << 16, 4096
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: All letters are of the 8-bit Latin alphabet: one byte each, in the order of code points.
LATIN = "ISO-8859-1"
_PLACE = np.full(256, -1, np.int64)
_PLACE[list(LETTERS.encode("latin-1"))] = np.arange(len(LETTERS))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """word: the runs of letters of at least ``least`` code points, those that a checksum names with one letter less."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    found = found.where(F.length("run") >= least).select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substr(F.col("run"), at + 2))
    return found.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word (8-bit Latin, binary) and n of the words that are long and common enough."""
    words = runs(docs, id_col, text_col, least_length).where(F.length("word") >= least_length)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return counted.select(F.encode("word", LATIN).alias("word"), "n")


def classes(words: DataFrame, n: int = CLASSES) -> list[str]:
    """The letters dealt to n classes of about equal use in the vocabulary; the driver sees one count for each letter."""

    def use(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(word, np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"letter": pa.array(np.arange(256), pa.int32()), "uses": pa.array(total)})

    uses = dict(words.select("word").mapInArrow(use, "letter int, uses long").groupBy("letter").agg(F.sum("uses")).collect())
    out, load = [""] * n, [0] * n
    for letter in sorted(LETTERS, key=lambda c: (-uses.get(ord(c), 0), c)):
        k = load.index(min(load))
        out[k] += letter
        load[k] += uses.get(ord(letter), 0)
    return out


def _name(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def _reached(counts: list[Column]) -> Column:
    """Blocks that a block's chunks visit: itself, one letter in a later class, and one letter more."""
    n, out = len(counts), [_name(counts)]
    for j in range(n):
        out += [_name([c + ((k == j) - (k == i)) for k, c in enumerate(counts)]) for i in range(j)]
        out.append(_name([c + int(k == j) for k, c in enumerate(counts)]))
    return F.array(*out)


def chunks(words: DataFrame, letters: list[str]) -> tuple[DataFrame, DataFrame]:
    """(block, chunk, words, counts) and (block, n_chunks, reached)."""
    plain = F.decode("word", LATIN)
    sizes = [F.length(plain) - F.length(F.translate(plain, c, "")) for c in letters]
    named = words.select("word", "n", *(c.alias(f"c{k}") for k, c in enumerate(sizes)))
    counts = [F.col(f"c{k}") for k in range(len(letters))]
    per = F.greatest(F.lit(1), F.least(F.lit(CHUNK), (F.lit(CHUNK_LETTERS) / F.greatest(F.lit(1), sum(counts, F.lit(0)))).cast("int")))
    blocks = named.groupBy(*counts).agg(F.count("*").alias("size")).select(_name(counts).alias("block"), F.ceil(F.col("size") / per).cast("int").alias("n_chunks"), _reached(counts).alias("reached"))
    placed = named.select(_name(counts).alias("block"), "word", "n").join(blocks.select("block", "n_chunks"), "block")
    chunk = F.pmod(F.xxhash64("word"), F.col("n_chunks")).cast("int")
    packed = placed.groupBy("block", chunk.alias("chunk")).agg(F.collect_list(F.struct("word", "n")).alias("rows"))
    return packed.select("block", "chunk", F.col("rows.word").alias("words"), F.col("rows.n").alias("counts")), blocks


class _Words:
    """Words of one length: letters, letter counts, norms, and how often each is used."""

    def __init__(self, letters: np.ndarray, uses: np.ndarray):
        self.letters, self.uses = letters, uses
        kind = np.float32 if letters.shape[1] < 2048 else np.float64  # exact below 2**24
        self.counts = np.zeros((len(letters), len(LETTERS)), kind)
        rows = np.arange(len(letters))
        for column in letters.T:
            self.counts[rows, _PLACE[column]] += 1
        self.norms = (self.counts * self.counts).sum(1)

    @staticmethod
    def of(words: pa.Array, uses: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(words.to_pylist())
        return np.frombuffer(raw, np.uint8).reshape(len(words), -1), uses.to_numpy(zero_copy_only=False)


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; those of b are as long, or shorter by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = b.shape[1]
    same = np.concatenate([a[:, :n] == b, np.zeros((len(a), 1), bool)], 1)
    back = np.concatenate([(a[:, 1:] == b)[:, ::-1], np.zeros((len(a), 1), bool)], 1)
    return (~same).argmax(1) + (~back).argmax(1) >= n


def near(a: _Words, b: _Words, itself: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b that are one edit apart; with ``itself``, b is a and each pair comes once."""
    distance = a.norms[:, None] + b.norms[None, :] - 2 * (a.counts @ b.counts.T)
    wanted = 2 if a.letters.shape[1] == b.letters.shape[1] else 1
    i, j = np.nonzero(distance == wanted)
    if itself:
        i, j = i[i < j], j[i < j]
    step = max(1, (1 << 24) // max(1, a.letters.shape[1]))
    kept = [_edits(a.letters[i[k : k + step]], b.letters[j[k : k + step]]) for k in range(0, len(i), step)]
    kept = np.concatenate(kept) if kept else np.zeros(0, bool)
    return i[kept], j[kept]


FOUND = pa.schema([("word", pa.binary()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.binary())])


def _summed(i: np.ndarray, j: np.ndarray, own: _Words, other: _Words) -> pa.RecordBatch | None:
    """For each word of ``own`` in i: how many words of ``other`` it has in j, and the commonest, least one."""
    if not len(i):
        return None
    other_words = [r.tobytes() for r in other.letters[np.unique(j)]]
    rank = np.zeros(len(other.letters), np.int64)
    rank[np.unique(j)] = np.argsort(np.argsort(np.array(other_words, object)))
    order = np.lexsort((rank[j], -other.uses[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    many = np.diff(np.concatenate([first, [len(i)]]))
    words = lambda x, rows: pa.array([r.tobytes() for r in x.letters[rows]], pa.binary())
    return pa.RecordBatch.from_arrays([words(own, i[first]), pa.array(many), pa.array(other.uses[j[first]]), words(other, j[first])], schema=FOUND)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the chunk visited, which comes first: products of each with its visitors."""
    at, own, waiting = None, None, {}

    def both(a: _Words, b: _Words, itself: bool = False) -> Iterator[pa.RecordBatch]:
        i, j = near(a, b, itself)
        if itself:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        for found in (_summed(i, j, a, b), None if itself else _summed(j, i, b, a)):
            if found is not None:
                yield found

    def flush(length: int) -> Iterator[pa.RecordBatch]:
        rows = waiting.pop(length)
        yield from both(own, _Words(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])))

    for batch in batches:
        for r in range(batch.num_rows):
            key = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            letters, uses = _Words.of(batch.column(3)[r].values, batch.column(4)[r].values)
            if key != at:
                for length in list(waiting):
                    yield from flush(length)
                at, own = key, None
            if not batch.column(2)[r].as_py():
                own = _Words(letters, uses)
                yield from both(own, own, True)
            elif own is not None:  # a chunk that hashing left empty has no row of its own
                rows = waiting.setdefault(letters.shape[1], [])
                rows.append((letters, uses))
                if sum(len(x[1]) for x in rows) >= min(VISITORS, max(1, (1 << 24) // letters.shape[1])):
                    yield from flush(letters.shape[1])
    for length in list(waiting):
        yield from flush(length)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, form_n and form: for words with near words, their number and the commonest (least, if several)."""
    packed, blocks = chunks(words, classes(words))
    packed, blocks = S.kept(packed), S.kept(blocks)
    ends = blocks.select(F.col("block").alias("to"), F.col("n_chunks").alias("to_chunks"))
    reached = blocks.select("block", F.explode("reached").alias("to")).join(ends, "to").groupBy("block").agg(F.collect_list(F.struct("to", "to_chunks")).alias("ends"))
    visits = packed.join(reached, "block").withColumn("end", F.explode("ends"))
    visits = visits.withColumn("to_chunk", F.explode(F.sequence(F.lit(0), F.col("end.to_chunks") - 1)))
    visits = visits.where((F.col("end.to") != F.col("block")) | (F.col("to_chunk") > F.col("chunk"))).select(F.col("end.to").alias("block"), F.col("to_chunk").alias("chunk"), F.lit(True).alias("visits"), "words", "counts")
    rows = packed.select("block", "chunk", F.lit(False).alias("visits"), "words", "counts").unionByName(visits)
    rows = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "visits")
    found = rows.mapInArrow(_compare, "word binary, n_near long, form_n long, form binary")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of its forms, of (word, form): by doubling, as each form is commoner than its word."""
    now = S.kept(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = S.kept(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").take(1):
            return now


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n for a vocabulary of (word, n); a form is at least ``factor`` times as common."""
    words = S.kept(words)
    found = words.join(neighbours(words), "word", "left")
    form = F.when(F.col("form_n") >= factor * F.col("n"), F.col("form"))
    found = S.kept(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("form_n")).alias("form_n")))
    out = found.join(roots(found.where("form is not null")), "word", "left")
    plain = lambda c: F.decode(c, LATIN)
    return out.select(plain("word").alias("word"), plain("form").alias("form"), plain(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
