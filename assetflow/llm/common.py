"""What several operators of this subpackage need: scratch tables, row keys, batches of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.session import scratch_path, ship_package

KEY = "_key"
CHUNK_BYTES = 4 << 20  # of text handled at once inside a task; a longer text is a chunk of its own


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the cluster's shared folder: lineage is cut, and every
    later read sees the same rows, also after executors are lost."""
    path = _fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_passing: list[list[str]] = []  # the paths written inside each open call of ``settled``


def _fresh(spark: SparkSession, label: str) -> str:
    path = scratch_path(spark, label)
    if _passing:
        _passing[-1].append(path)
    return path


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` gives, as a written table; the tables it wrote on the way are deleted."""
    _passing.append([])
    try:
        out = make()
        path = scratch_path(spark, label)
        out.write.parquet(path)
    finally:
        paths = _passing.pop()
        for p in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(p)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def bitmap(df: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed, that hold the values of the long column ``value``: it thins out what is read, whatever
    the number of values.  At most one number for 64 bits reaches the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _spread(batch.column("value").to_numpy(), bits)
            value = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(value)], names=["w", "v"])

    got = python_ready(df.select("value")).mapInArrow(read, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return words.view(np.uint64)


def _spread(values: np.ndarray, bits: int) -> np.ndarray:
    return mix(values.astype(np.int64, copy=False).view(np.uint64)) >> np.uint64(64 - bits)


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the bitmap may hold."""
    at = _spread(values, int(len(words)).bit_length() + 5)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


class Steps:
    """Tables of one schema that a loop writes one after the other, read back together in one scan."""

    def __init__(self, df: DataFrame, label: str):
        self.reader, self.base, self.paths = df.sparkSession.read, _fresh(df.sparkSession, label), []

    def add(self, df: DataFrame) -> DataFrame:
        """Write a step's rows; returns them."""
        self.paths.append(f"{self.base}/{len(self.paths)}")
        self.schema = df.schema
        df.write.parquet(self.paths[-1])
        return self.reader.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.reader.schema(self.schema).parquet(*self.paths)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def python_ready(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with a unique, non-null long ``_key`` whose order is the order of the ids.

    Where ids are unique, not null and integral the id itself is the key.  Otherwise rows are put
    in order of the id (nulls last) and of all other sortable columns, numbered and written, so
    that repeated rows count as separate rows in a defined order."""
    kind = dict(df.dtypes)[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        odd = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1))
        if odd.isEmpty():
            return df.withColumn(KEY, F.col(id_col).cast("bigint"))
    rest = [c for c, t in df.dtypes if c != id_col and "map<" not in t and "variant" not in t]
    ordered = df.orderBy(F.col(id_col).asc_nulls_last(), *rest)
    return written(ordered.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


# ---------------------------------------------------------------- words of many texts at once
WHITE = np.ones(256, dtype=bool)  # words are runs of bytes other than ASCII white space
WHITE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # words are runs of digits, lower-case letters and non-ASCII characters
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), _BASE)]), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of a run of texts: ``hashes`` in order, text i's words at ``first[i]:first[i + 1]``.
    ``starts`` are byte positions in ``data``, the lower-cased UTF-8 of the texts; text i's bytes are at
    ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offs, data = texts.buffers()
        off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        self.raw = raw
        self.data = data = LOWER[raw]
        word = table[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(data)]
        begins[heads] = word[heads]
        self.starts = starts = np.flatnonzero(begins)
        self.first = np.searchsorted(starts, self.offsets)
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        lengths = np.diff(np.append(starts, len(data)))
        at = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        values = np.where(table, _BYTE, np.uint64(0))[data[starts[0] :]]
        values *= _pow(int(at.max()) + 1)[at]
        self.hashes = mix(np.add.reduceat(values, starts - starts[0]))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, also across texts; the caller keeps those inside one."""
        h = self.hashes
        if len(h) < n:
            return np.zeros(0, np.uint64)
        total = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
        return mix(total)


def chunks(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each, or one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
