"""Text sources as lines: plain, gzip and bzip2 by Spark's reader, xz by ranges of blocks, other packed files by a streaming decoder."""

from __future__ import annotations

import io
import lzma
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import strip
from . import xz

SUFFIXES = (".log", ".txt", ".csv", ".json", ".gz", ".bz2", ".xz", ".lzma")


def _text(spark: SparkSession, paths: list[str]) -> DataFrame:
    clean = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), clean.alias("raw_line"))


def path_of(source_file: str) -> str:
    """The path to read a file by that ``source_file`` names; characters that patterns of paths use are plain ones."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(source_file))


def _kinds(paths: tuple[str, ...]) -> tuple[list[str], list[str]]:
    packed = [p for p in paths if p.lower().endswith((".xz", ".lzma"))]
    return [p for p in paths if p not in packed], packed


def read_lines(spark: SparkSession, *paths: str, blanks: bool = False) -> DataFrame:
    """``source_file``, ``line_number`` (from 1, blank lines counted), ``raw_line``; bytes that aren't UTF-8 are dropped.

    A line's number is its place in its split plus the lines of the file's splits before,
    so text isn't moved to be numbered and a large file stays spread over its splits. With
    ``blanks`` also ``_chunk`` (the split) and ``_blanks_before`` (blank lines of the file's
    splits before), from the same count.
    """
    plain, packed = _kinds(paths)
    texts = ([_text(spark, plain)] if plain else []) + ([_packed_text(spark, packed)] if packed else [])
    text = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    counts = [F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")] + ([F.count_if(strip(F.col("raw_line")) == "").alias("_empty")] if blanks else [])
    splits = text.groupBy("source_file", "_block").agg(*counts)
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    shifts = [(before("_n") - F.col("_first") + 1).alias("_shift")] + ([before("_empty").alias("_blanks_before")] if blanks else [])
    numbered = text.join(splits.select("source_file", "_block", *shifts), ["source_file", "_block"])
    return numbered.select("source_file", (F.col("_id") + F.col("_shift")).alias("line_number"), "raw_line", *([F.col("_block").alias("_chunk"), "_blanks_before"] if blanks else []))


def read_heads(spark: SparkSession, *paths: str, most: int = 1000) -> DataFrame:
    """The first lines of every file, from the first split of each."""
    plain, packed = _kinds(paths)
    out = None
    if plain:
        number = F.row_number().over(Window.partitionBy("source_file").orderBy("_id")).cast("long")
        # Spark keeps the first rows of a file in every task before it sorts them
        out = _text(spark, plain).filter("_block = 0").withColumn("line_number", number).filter(F.col("line_number") <= most).select("source_file", "line_number", "raw_line")
    if packed:
        more = _packed(spark, packed, most)
        out = more if out is None else out.unionByName(more)
    return out


def _files(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """Files that a path or pattern means: the name that Spark has for each in a row, its path, its size."""
    path_type = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path_type(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [(path_type(x.getPath().toString()).toUri().toString(), x.getPath().toString(), x.getLen()) for x in found or [] if x.isFile()]


def _blocked(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[str, str, int, int]], list[str]]:
    """Ranges of blocks of xz files that tasks can open themselves, and the paths of the other files."""
    rows, rest = [], []
    for path in paths:
        for name, full, _ in _files(spark, path):
            local = full.removeprefix("file:")
            try:
                if full == local or not path.lower().endswith(".xz"):
                    raise lzma.LZMAError("not a file of blocks")
                with open(local, "rb") as f:
                    rows += [(name, local, a, b) for a, b in xz.ranges(xz.blocks(f))]
            except lzma.LZMAError:
                rest.append(path_of(name))
    return rows, rest


def _packed_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``_text``: xz files of many blocks by ranges of blocks, other packed files whole, as streams."""
    rows, rest = _blocked(spark, paths)
    schema = "source_file string, _block bigint, raw_line string"

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, path, first, last in batch.itertuples(index=False):
                found = iter(xz.lines(path, int(first), int(last)))
                while part := list(islice(found, 50_000)):
                    yield pd.DataFrame({"source_file": name, "_block": first, "raw_line": [x.decode("utf-8", "ignore") for x in part]})

    parts = []
    if rows:
        table = spark.createDataFrame(rows, "source_file string, path string, first int, last int").repartition(len(rows), "source_file", "first")
        parts.append(table.mapInPandas(of_blocks, schema))
    if rest:
        parts.append(_packed(spark, rest).select("source_file", F.lit(0).cast("bigint").alias("_block"), "raw_line"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("source_file", "_block", F.monotonically_increasing_id().alias("_id"), "raw_line")


def _packed(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                # decoded as it is read; lines end at \n, \r\n or \r
                text = io.TextIOWrapper(lzma.LZMAFile(io.BytesIO(content)), encoding="utf-8", errors="ignore", newline=None)
                lines = enumerate(islice(text, most), 1)
                while part := list(islice(lines, 50_000)):
                    yield pd.DataFrame({"source_file": path, "line_number": [k for k, _ in part], "raw_line": [x.rstrip("\n") for _, x in part]})

    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
    return files.mapInPandas(unpack, "source_file string, line_number bigint, raw_line string")


def file_sizes(spark: SparkSession, *paths: str) -> DataFrame:
    """``source_file`` and ``file_size_bytes`` of files, empty ones too; their contents aren't read."""
    rows = [(name, size) for path in paths for name, _, size in _files(spark, path)]
    return spark.createDataFrame(rows, "source_file string, file_size_bytes bigint")


def lines_of(df: DataFrame, text: str, source: str = "memory", order: str | None = None) -> DataFrame:
    """A DataFrame's text column as lines, numbered by ``order`` within the source."""
    number = F.col(order).cast("long") if order else F.monotonically_increasing_id() + 1
    return df.select(F.lit(source).alias("source_file"), number.alias("line_number"), F.col(text).alias("raw_line"))


def head(lines: DataFrame, most: int = 1000) -> DataFrame:
    """The first lines of every source."""
    return lines.filter(F.col("line_number") <= most)


def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Folders, then files that look like logs with their sizes, each sorted by path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)  # one folder's entries
    rows = [(x.getPath().toString(), x.isDirectory(), None if x.isDirectory() else x.getLen()) for x in found if x.isDirectory() or x.getPath().getName().lower().endswith(SUFFIXES)]
    return spark.createDataFrame(rows, "path string, is_folder boolean, length bigint").orderBy(F.desc("is_folder"), "path")
