"""Shared low-level text access: Arrow batches as byte blocks, and words as numpy arrays.

A word is a maximal run of characters other than the ASCII blanks ``\\x20 \\x09-\\x0D``.  In UTF-8 those
characters are single bytes that occur in no other character, so words are found on bytes.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; it bounds a Python worker's memory (about 60 times this).
BLOCK_BYTES = 2_000_000

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = True

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base, and of its inverse, modulo 2**64."""
    steps = np.ones((2, n), np.uint64)
    steps[0, 1:], steps[1, 1:] = _BASE, np.uint64(pow(int(_BASE), -1, 2**64))
    return tuple(np.multiply.accumulate(steps, axis=1))


class Block:
    """Some whole texts as one byte array; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        return cls.from_arrow(pa.array(texts, pa.string()))

    @classmethod
    def from_arrow(cls, column: pa.Array) -> Block:
        """Null counts as the empty text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        return cls(raw, bounds - bounds[0])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, outside: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end byte of each word, and for each text (and the end) the number of words before it. outside: the bytes
        that are in no word."""
        solid = ~outside[self.data]
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        firsts = self.bounds[:-1][np.diff(self.bounds) > 0]
        before[firsts] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        after[firsts[1:] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each span; lower: A-Z count as a-z."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        p, inverse = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _TABLE)[self.data] * p[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def code_points(self) -> np.ndarray:
        """For each byte position and the end, the number of characters that begin before it."""
        count = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=count[1:])
        return count


def windows(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that lies in one text, and the index of its first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + n] * np.uint64(2 * i + 1))
    inside = np.ones(n, bool)
    ends = ptr[1:-1]
    for i in range(1, k):
        at = ends - i
        inside[at[(at >= 0) & (at < n)]] = False
    # a text that is shorter than k, between two ends, is covered by the ends on either side
    first = np.flatnonzero(inside)
    return out[first], first


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cuts Arrow batches into runs of whole rows with at most limit bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            part = batch.slice(at, stop - at)
            yield part, Block.from_arrow(part.column(column))
            at = stop


def fold(column: str, modulus: int):
    """The remainder that decides a row's fold: crc32 of the key as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names. Only a local session without that setting, as in
    tests, uses its warehouse folder; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


#: The setting by which Spark removes the shuffle files of a statement when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared scratch folder and reads it back: its lineage ends there and survives lost
    executors. tidy: what was shuffled for it goes at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(TIDY)
        elif tidy:
            spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the folders of tables from materialize that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact name: other columns, also such as differ in case only or repeat a name, do no harm."""
    first = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{first[n]}").alias(n) for n in names])
