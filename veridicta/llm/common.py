"""What the operators of this subpackage share: reading, cutting lineage, words and hashes.

Texts are handled as UTF-8 bytes in chunks of bounded size, with numpy doing the per-byte work.  A word is a
maximal run of bytes other than space and 0x09-0x0D; ``bytes.split()`` gives exactly these.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridicta.plans.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
FIRST = np.iinfo(np.int64).max  # stands for a null id in orderings: after all others

_is_word = np.ones(256, np.int8)
_is_word[[0x20, *range(0x09, 0x0E)]] = 0
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veridicta-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _file_system(spark, path)
    return system.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = _file_system(spark, path)
    system.delete(p, True)


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.  ``free``: after a large exchange, have the
    driver collect its garbage, since shuffle files stay on disk until it does."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    out = df.checkpoint()
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def dealt(df: DataFrame, partitions: int, column: str) -> DataFrame:
    """``df`` cut, partitioned and sorted by ``column``, so that joins and groups by it leave it where it is.  Spark keeps
    the partitioning of a checkpoint only if the plan isn't adaptive."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return cut(df.repartition(partitions, column).sortWithinPartitions(column), free=True)
    finally:
        spark.conf.set(key, was)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of our own that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def crc_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = max(n, 2 * len(_power["up"]))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _power[name] = np.cumprod(p)
    return _power["up"], _power["down"]


class SpanHash:
    """64-bit fingerprints of any span of a sequence of 64-bit units, from one prefix sum."""

    def __init__(self, units: np.ndarray):
        up, self.down = _powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Fingerprint of the k units from each place on."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_column(column) -> list[bytes]:
    """A text column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def slices(sizes: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows that hold about ``limit`` bytes; a larger row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += int(n) + 64
    if begin < len(sizes):
        yield begin, len(sizes)


def chunks(batch, column: str = "text", limit: int = CHUNK_BYTES):
    """Parts of an Arrow batch with the texts' bytes, each of about ``limit`` bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    for i, j in slices(sizes, limit):
        yield batch.slice(i, j - i), byte_column(col.slice(i, j - i))


class Words:
    """The words of some texts: hash, length, and where each text's words begin (``first`` has one entry more)."""

    def __init__(self, texts: list[bytes], lower: bool = False, second: bool = False):
        whole = b" ".join(texts) + b" "
        joined = np.frombuffer(whole.lower() if lower else whole, np.uint8)  # of bytes, A-Z only
        edge = np.diff(_is_word[joined], prepend=np.int8(0))
        self.data = joined
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(self.start, begins)
        self.count = np.diff(self.first)
        self.hash = SpanHash(BYTE_CODE[joined]).of(self.start, self.end)
        if second:  # a fingerprint that is independent of the first
            self.second = SpanHash(_SECOND_CODE[joined]).of(self.start, self.end)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def trim() -> None:
    """Give freed memory back to the system; workers are used again, by other stages too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def ids_of(batch, column: str = "doc_id") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(col.cast(pa.int64()), FIRST).to_numpy(zero_copy_only=False)


def binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def numbers(column, dtype) -> np.ndarray:
    """All numbers held by the binary values of a column, in order."""
    return np.frombuffer(b"".join(byte_column(column)), dtype)
