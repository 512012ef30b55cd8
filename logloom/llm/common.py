"""Helpers shared by the corpus operators: staging, row keys, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a Python task; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes whose powers are kept by the rolling hash.
_BLOCK = 1 << 20
#: Queries leave no shuffle files once they have ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- staging


class Staging:
    """Parquet tables in the folder that the cluster names in ``spark.checkpoint.dir``.

    They cut lineage: a stage that has been written isn't computed again when an
    executor is lost. They go when the application ends. Without the setting a local
    master (tests) gets a temporary folder; a cluster gets an error, since its executors
    share no local folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        self.spark, self.root, self.paths = spark, f"{base}/{label}-{uuid.uuid4().hex}", {}

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, codec: str = "lz4_raw", keep: bool = True) -> DataFrame:
        """Write ``df`` and return it as read back; its shuffle files go once it is written."""
        path = f"{self.root}/{name}"
        with settings(self.spark, {_CLEANUP: "true"}):
            # the query that wrote a table is the one that reads it: no marker files
            df.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        if not self.paths:
            at, files = self._path(self.root)
            files.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def discard(self, name: str) -> None:
        """Delete a staged table that no later step reads."""
        at, files = self._path(self.paths[name])
        files.delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the queries run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_schema(docs: DataFrame, key: str, rest: str, name: str = "key") -> T.StructType:
    """A schema of ``key`` as it is in ``docs``, then the columns of the DDL text ``rest``."""
    return T.StructType([T.StructField(name, docs.schema[key].dataType), *T.StructType.fromDDL(rest).fields])


def whole_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns as one struct, so that an operator can carry them whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without])


# ---------------------------------------------------------------- keys and prefix sums


def keys_unique(df: DataFrame, key: str) -> bool:
    n, present, distinct = df.select(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
    return n == present == distinct


def with_row_key(df: DataFrame, key: str, text: str, name: str = "_rid") -> DataFrame:
    return row_keys(df, key, text, name)[0]


def row_keys(df: DataFrame, key: str, text: str, name: str = "_rid") -> tuple[DataFrame, bool]:
    """Add a long that identifies each distinct (key, text) and orders by key, then by the text's hash.

    Where keys are whole numbers, present and unique it is the key itself. Otherwise (other
    types, nulls, or one key for several texts) the distinct pairs are numbered in order,
    null keys first; rows repeated whole share a number. Also tells whether no rows share one.
    """
    if isinstance(df.schema[key].dataType, T.IntegralType) and keys_unique(df, key):
        return df.withColumn(name, F.col(key).cast("long")), True
    spark, hashed = df.sparkSession, F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    ids = df.select(F.col(key).alias("_k"), hashed.alias("_h")).distinct()
    ids = Staging(spark, "rowkeys").write(ids.repartitionByRange("_k", "_h").withColumn("_p", F.spark_partition_id()), "ids")
    numbered = running_rank(ids, "_p", ["_k", "_h"], name).select("_k", "_h", name)
    keyed = df.withColumn("_kh", hashed)
    return keyed.join(numbered, keyed[key].eqNullSafe(numbered["_k"]) & (keyed["_kh"] == numbered["_h"])).drop("_k", "_h", "_kh"), False


def running_rank(df: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """A gapless global number by (part, order): ranks inside parts plus the parts' summed sizes."""
    offsets = prefix_sums(df.groupBy(part).agg(F.count(F.lit(1)).alias("_n")), part, "_n", "_before")
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long") - 1
    return df.withColumn("_rank", rank).join(offsets.select(part, "_before"), part).withColumn(name, F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def prefix_sums(sums: DataFrame, part: str, value: str, name: str, fan: int = 1024) -> DataFrame:
    """Exclusive running sum of ``value`` over integer ``part`` in two levels, so that no window takes all rows."""
    sums = sums.withColumn("_sup", F.floor(F.col(part) / fan).cast("long"))
    inner = F.sum(value).over(Window.partitionBy("_sup").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    tops = sums.groupBy("_sup").agg(F.sum(value).alias("_all"))
    tops = tops.withColumn("_top", F.coalesce(F.sum("_all").over(Window.orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sums.withColumn("_in", F.coalesce(inner, F.lit(0))).join(tops.select("_sup", "_top"), "_sup").withColumn(name, (F.col("_in") + F.col("_top")).cast("long")).drop("_sup", "_in", "_top")


def held_out(key: str | Column) -> Column:
    """crc32 of the key's text is a multiple of 5; false for a null key."""
    return F.coalesce(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- Arrow text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_table(outside: bytes | range | list[int]) -> np.ndarray:
    """256 booleans: whether a byte is part of a word; ``outside`` lists those that are not."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


# ---------------------------------------------------------------- hashing

_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        ones = np.full(_BLOCK, _BASE, np.uint64)
        ones[0] = 1
        back = np.full(_BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _POWERS.extend([np.cumprod(ones, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)])
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(data)], out=out[1:])
    return out


def _hash_long(data: np.ndarray) -> int:
    total = 0
    for at in range(0, len(data), _BLOCK):
        total += int(_prefix(data[at : at + _BLOCK])[-1]) * pow(_BASE, at, 1 << 64)
    return total & _MASK


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for sorted spans; equal strings have equal hashes at any place."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if j <= i:
            out[i] = _hash_long(data[base : int(ends[i])])
            i += 1
            continue
        s, e = starts[i:j] - base, ends[i:j] - base
        sums = _prefix(data[base : base + int(e.max())])
        out[i:j] = (sums[e] - sums[s]) * _powers()[1][np.minimum(s, _BLOCK - 1)]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def hash_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes of at most _BLOCK bytes of data."""
    sums = _prefix(data)
    return mix((sums[width:] - sums[:-width]) * _powers()[1][: len(data) - width + 1])


def shingles(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words inside each row, and each row's first one (one more at the end).

    A row of fewer words, but not none, has one for its whole sequence.
    """
    counts = np.diff(firsts)
    full = np.maximum(counts - width + 1, 0)
    n = len(words)
    if n >= width:
        acc = words[: n - width + 1] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, width):
            acc = mix(acc) + words[k : n - width + 1 + k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        acc = mix(acc)
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = owner[: n - width + 1] == owner[width - 1 :]
        windows = acc[keep]
    else:
        windows = np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    sizes = full.copy()
    sizes[short] = 1
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not len(short):
        return windows, bounds
    out = np.empty(bounds[-1], np.uint64)
    place = np.ones(bounds[-1], bool)
    place[bounds[short]] = False
    out[place] = windows
    for r in short:
        acc = np.uint64(counts[r])
        with np.errstate(over="ignore"):
            for w in words[firsts[r] : firsts[r + 1]]:
                acc = mix(np.array([acc], np.uint64))[0] + w * np.uint64(0xD6E8FEB86659FD93)
        out[bounds[r]] = mix(np.array([acc], np.uint64))[0]
    return out, bounds


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)
