"""Shared helpers: document selection, scratch tables, word hashing, packed arrays.

Rules that hold for every document operator of this subpackage:

* only ``doc_id`` and ``text`` are read, so further columns never clash;
* a null text counts as the empty text;
* a row whose ``doc_id`` is null cannot be named in a result and takes no part;
* rows that share a ``doc_id`` are independent documents unless stated otherwise;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
END = b" "  # no word holds a space, so this never equals one
BEGIN = b"\t"
BLOCK_BYTES = 4 << 20
_CACHE_WORDS = 400_000
_SHORT = 128


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; in local mode below the warehouse where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/matchlake-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; results that have not been written by then are lost."""
    _delete(spark, scratch_dir(spark))


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the scratch folder and read again: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """XXH64 of a word, remembered; the memory is bounded by forgetting everything when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_KEEP = 250_000


class Recent(dict):
    """Values by string, computed on a miss. The last keep to 2 keep strings used stay, so memory is bounded."""

    def __init__(self, make, keep: int = _KEEP):
        super().__init__()
        self.make, self.keep, self.older = make, keep, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


_memory: dict = {}


def remembered(name, make):
    """What an operator remembers in this process, made at first. Workers outlive stages: what another one remembered goes."""
    if name not in _memory:
        forget()
        _memory[name] = make()
    return _memory[name]


def forget() -> None:
    """Gives back all that is remembered; for tasks that need nothing of it."""
    if _memory:
        _memory.clear()
        gc.collect()  # remembered values may hold those who made them
        pa.default_memory_pool().release_unused()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(remembered("hashes", WordHashes).__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the top bits deal evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m, out = np.uint64(multiplier), np.zeros(n, np.uint64)
    for j in range(k):
        out *= m
        out += h[j : j + n]
    return mix(out)


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """An unsigned array as zstd over byte planes, or as it is where it is short; delta suits ascending values."""
    a = np.ascontiguousarray(a)
    if a.nbytes < _SHORT:
        return b"0" + a.dtype.char.encode() + a.tobytes()
    if delta:
        a = np.concatenate([a[:1], np.diff(a)])
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return b"1" + a.dtype.char.encode() + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, delta: bool = False) -> np.ndarray:
    dtype = np.dtype(b[1:2].decode())
    if b[:1] == b"0":
        return np.frombuffer(b, dtype, offset=2)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2:]), np.uint8)
    a = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(a, dtype=dtype) if delta else a


def bucket_cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the buckets (equal ranges of the hash) begins and ends in ascending h."""
    width = (1 << 64) // buckets
    return np.searchsorted(h, np.array([min(i * width, (1 << 64) - 1) for i in range(1, buckets)], np.uint64))


def slices(h: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *bucket_cuts(h, buckets).tolist(), len(h)]
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, cuts[b], cuts[b + 1]


def block_ids() -> Iterator[int]:
    n = TaskContext.get().partitionId() << 24
    while True:
        yield n
        n += 1


def crc32_text(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def arrow_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)
