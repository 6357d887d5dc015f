"""Shared machinery of the sharded operators.

Documents are dealt into parts by a hash of their row; a part's keys (hashes of
shingles, windows, words) are asked about at key shards, which see the keys of
all parts.  Keys travel sorted, packed in binary, one row for each (part, shard)
pair, and answers come back aligned to them: a hot key costs one entry for each
part, however many documents hold it, and no task sees an unbounded group.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

#: Bytes of stored input for each part, where that gives more parts than the session's setting.
PART_BYTES = 32 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_bytes(df: DataFrame) -> int:
    """Of the input, as Spark estimates them; 0 if it can't."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no statistics, for instance on a remote session
        size = 0
    return size if size < 1 << 52 else 0


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Number of parts: twice the shuffle partitions, more if the input is large for that."""
    return max(2 * partitions(df.sparkSession), min(stored_bytes(df) // part_bytes, 1 << 22))


def with_part(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """Adds ``part``; equal rows share one, whatever the order rows arrive in."""
    return df.withColumn("part", F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int"))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(shards)) >> U64(32)


def by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted keys (the shard grows with the key)."""
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=U64))


def narrow(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard and low 32 bits: for uses in which a collision costs work and no result."""
    return (shard_of(keys, shards) << U64(32)) | (keys & U64(0xFFFFFFFF))


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def packed(x: np.ndarray) -> bytes:
    """Compressed by byte planes, which sorted keys and small numbers make cheap; integers in the fewest bytes."""
    x = np.ascontiguousarray(x)
    if x.dtype.kind == "i":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) if not len(x) or x.min() >= 0 else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return x.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    kind, body = np.dtype(raw[:3].decode()), zstandard.ZstdDecompressor().decompress(raw[3:])
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def table(schema: pa.Schema, **cols) -> pa.Table:
    return pa.table({f.name: pa.array(cols[f.name], f.type) for f in schema}, schema=schema)


def free_name(start: str, columns: list[str]) -> str:
    """A name that no column has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while start.lower() in taken:
        start += "_"
    return start


def checkpoint_dir(spark: SparkSession) -> None:
    """Takes the shared folder that the session names; a temporary one only on one machine, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_written: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """A new path in the shared folder of the session, which goes when the driver ends."""
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder of the session, which goes when the driver ends."""
    spark, path = df.sparkSession, _folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Buckets:
    """A table in the shared folder, in folders by one column and buckets by another: its groups by that need no shuffle."""

    def __init__(self, spark: SparkSession, folders: str, col: str, n: int):
        self.spark, self.folders, self.col, self.n = spark, folders, col, n
        self.path, self.name = _folder(spark), f"kept_{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        df.write.format("parquet").mode("append").partitionBy(self.folders).bucketBy(self.n, self.col).option("path", self.path).saveAsTable(self.name)

    def read(self, folder: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col(self.folders) == folder)

    def drop(self, folder: str) -> None:
        _delete(self.spark, f"{self.path}/{self.folders}={folder}")


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here give the disk of their shuffles back as they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return
