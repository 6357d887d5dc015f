"""Token-ID output as one wavelet matrix per shard.

A shard file holds the token ids of consecutive documents as 16 succinct
bit-planes, compressed chunk by chunk, with their rank directories, and the ids
and lengths of its documents.  From the file alone one can read any token, count a
token in a prefix, find its k-th occurrence, or restore all ids; the first three
inflate a chunk of each plane.  Ids of 65,536 and more are an error.

Files are written through Spark's Parquet writer (column ``file``, one row for
each shard file), so any store that Spark reaches can hold them.

Edge cases: null and empty texts give documents of the end id alone; rows that
share a doc_id stay apart, ordered by text; a null doc_id sorts first; an empty
table gives no shard files and no rows; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards as S
from . import tokens as K

MAGIC = b"WVM1"
PLANES = 16
#: Bits between two entries of a rank directory, and bytes of a plane that are compressed together.
BLOCK, CHUNK = 512, 1 << 15


class WaveletMatrix:
    """Succinct sequence of 16-bit symbols: rank directories, and planes in compressed chunks, inflated as they are asked for."""

    def __init__(self, n: int, zeros: list[int], blocks: list[np.ndarray], chunks: list[list[bytes]]):
        self.n, self.zeros, self.blocks, self.chunks = n, zeros, blocks, chunks
        self.directory = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in blocks]
        self.inflated: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, symbols: np.ndarray) -> WaveletMatrix:
        """Symbols of 65,536 and more don't fit and are an error."""
        if len(symbols) and not 0 <= int(symbols.min()) <= int(symbols.max()) < 1 << PLANES:
            raise ValueError(f"token ids must be under {1 << PLANES}")
        x, zeros, blocks, chunks = symbols.astype(np.uint16), [], [], []
        packer = zstandard.ZstdCompressor(level=1)
        for k in range(PLANES - 1, -1, -1):
            bit = (x & np.uint16(1 << k)).astype(bool)
            plane = np.zeros(-(-len(x) // BLOCK) * (BLOCK // 8), np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            blocks.append(np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint16))
            chunks.append([packer.compress(plane[a : a + CHUNK].tobytes()) for a in range(0, len(plane), CHUNK)])
            low = x[~bit]
            zeros.append(len(low))
            x = np.concatenate([low, x[bit]])
        return cls(len(symbols), zeros, blocks, chunks)

    def to_bytes(self) -> bytes:
        """For each plane its zeros, the directory's steps, the sizes of its chunks, and these."""
        packer = zstandard.ZstdCompressor(level=1)
        out = [struct.pack("<Q", self.n)]
        for zeros, blocks, chunks in zip(self.zeros, self.blocks, self.chunks, strict=True):
            steps = packer.compress(blocks.astype("<u2").tobytes())
            out += [struct.pack("<QIII", zeros, len(blocks), len(steps), len(chunks)), struct.pack(f"<{len(chunks)}I", *map(len, chunks)), steps, *chunks]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        (n,), at, zeros, blocks, chunks = struct.unpack_from("<Q", raw), 8, [], [], []
        for _ in range(PLANES):
            z, size, steps, count = struct.unpack_from("<QIII", raw, at)
            sizes = struct.unpack_from(f"<{count}I", raw, at + 20)
            at += 20 + 4 * count
            zeros.append(z)
            blocks.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + steps], max_output_size=2 * size), "<u2"))
            ends = at + steps + np.cumsum((0, *sizes))
            chunks.append([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            at = int(ends[-1])
        return cls(n, zeros, blocks, chunks)

    def _chunk(self, level: int, c: int) -> np.ndarray:
        if (level, c) not in self.inflated:
            self.inflated[level, c] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[level][c], max_output_size=CHUNK), np.uint8)
        return self.inflated[level, c]

    def plane(self, level: int) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(unpack(c, max_output_size=CHUNK) for c in self.chunks[level]), np.uint8)

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane: the directory, then a count within one block."""
        block, rest = divmod(i, BLOCK)
        if not rest:
            return int(self.directory[level][block])
        first = block * (BLOCK // 8)
        part = self._chunk(level, first // CHUNK)[first % CHUNK : first % CHUNK + (rest + 7) // 8]
        return int(self.directory[level][block] + np.unpackbits(part, bitorder="little")[:rest].sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self._chunk(level, (i >> 3) // CHUNK)[(i >> 3) % CHUNK] >> (i & 7) & 1)

    def ranks(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each of many ends."""
        lo, hi = np.zeros(1, np.int64), np.asarray(ends, np.int64)
        for level in range(PLANES):
            rows = np.concatenate([self.plane(level), np.zeros(BLOCK // 8, np.uint8)]).reshape(-1, BLOCK // 8)

            def ones(at, level=level, rows=rows):
                block, rest = at // BLOCK, at % BLOCK
                out = self.directory[level][block]
                for a in range(0, len(at), 4096):  # some rows of bits at a time
                    bits = np.unpackbits(rows[block[a : a + 4096]], axis=1, bitorder="little")
                    out[a : a + 4096] += (bits * (np.arange(BLOCK) < rest[a : a + 4096, None])).sum(axis=1, dtype=np.int64)
                return out

            up = symbol >> (PLANES - 1 - level) & 1
            lo, hi = (self.zeros[level] + ones(x) if up else x - ones(x) for x in (lo, hi))
        return hi - lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for level in range(PLANES):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return symbol

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(PLANES):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (PLANES - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, end: int) -> int:
        """How often the symbol stands before ``end``."""
        lo, hi = self._range(symbol, end)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        lo, hi = 0, self.n  # the k-th such bit is at the last position with k of them before it
        while hi - lo > 1:
            mid = (lo + hi) // 2
            before = self._ones(level, mid)
            lo, hi = (mid, hi) if (before if bit else mid - before) <= k else (lo, mid)
        return lo

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(PLANES - 1, -1, -1):
            bit = symbol >> (PLANES - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def positions(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def symbols(self) -> np.ndarray:
        """All symbols, by undoing the stable partitions from the last plane up."""
        x = np.zeros(self.n, np.uint16)
        for level in range(PLANES - 1, -1, -1):
            bit = np.unpackbits(self.plane(level), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[~bit] = x[: self.zeros[level]]
            y[bit] = x[self.zeros[level] :] | np.uint16(1 << (PLANES - 1 - level))
            x = y
        return x


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<Q", len(doc_ids)) + known.tobytes() + numbers.tobytes() + lengths.astype("<i8").tobytes() + WaveletMatrix.build(ids).to_bytes()


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths in tokens, and the matrix of their tokens."""
    if raw[:4] != MAGIC:
        raise ValueError("not a wavelet token file")
    (n,) = struct.unpack_from("<Q", raw, 4)
    known = np.frombuffer(raw, np.uint8, n, 12)
    numbers = np.frombuffer(raw, "<i8", n, 12 + n)
    lengths = np.frombuffer(raw, "<i8", n, 12 + 9 * n)
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], lengths, WaveletMatrix.from_bytes(raw[12 + 17 * n :])


FILES = pa.schema([("deal", pa.int32()), ("base", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.large_binary())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each with ``end_id`` after it, in ascending order of ``id_col``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, base, encoder = TaskContext.get().partitionId(), 0, K.encoder(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = encoder.encode(batch.column(1))
            ids = np.insert(ids, at[1:], end_id)
            lengths = np.diff(at) + 1
            raw = write_file(batch.column(0).to_pylist(), lengths, ids)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((deal, base, len(ids), raw), FILES, strict=True)], schema=FILES)
            base += len(ids)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(S.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "deal int, base long, n_tokens long, file binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, end_id: int = 1) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, how often it holds ``end_id`` and, if asked for, ids."""
    files = spark.read.parquet(path)
    # One number for each range of the writer: as many as it had partitions.
    sizes = sorted((r["deal"], r["n"]) for r in files.groupBy("deal").agg(F.sum("n_tokens").alias("n")).collect())
    first, total = {}, 0
    for deal, n in sizes:
        first[deal], total = total, total + n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, n_ends long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for deal, base, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, lengths, matrix = read_file(raw)
                ids = matrix.symbols().astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + (first[deal] + base)), pa.array(lengths), pa.array(sums, pa.int64()), pa.array(np.diff(matrix.ranks(end_id, ends), prepend=0))]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "n_ends", "ids"][: len(out)])

    return files.select("deal", "base", "file").mapInArrow(decode, schema)


def token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the files and reads them back; without a path, to the session's shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary or K.vocabulary_path(), end_id)
    return read_tokens(spark, path, end_id=end_id)


def shared_folder(spark: SparkSession) -> str:
    S.checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()
