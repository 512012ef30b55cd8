"""URL filters: a Bloom filter cascade over the corpus's complete universe of keys.

A rule is a host and the beginning of a path; its key is both joined. A url's candidate
keys are its host's suffixes at dots joined with the path's beginnings. Level 1 of a
cascade encodes the listed keys, level 2 the keys of the universe that level 1 takes in
wrongly, level 3 the listed keys that level 2 takes in, and so on until nothing is left:
from then on every key of the universe is judged exactly, without a join. A list too long
for one broadcast is cut by ranges of key hashes, each with a cascade and a pass of its own.

Keys are known by 64-bit hashes. Two of n keys have one hash with a probability of about
n * n / 2^65 (under 0.03 for a thousand million keys); then both count as listed if one is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, mix

#: Bits for each encoded key, and hash functions.
BITS, HASHES = 8, 5
#: Bytes of the levels of one cascade, about; it is broadcast, so a longer list is judged in several passes.
MOST_BYTES = 64 << 20
_CHUNK = 1 << 19  # bits of a filter that one row brings to the driver
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a rule for this host and path can have, the longest first; equal lengths by text."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.array_compact(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    keyed = F.transform(F.array_distinct(keys), lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda x: x["k"])


class Level:
    """One Bloom filter: bits as 64-bit words, and the seed that sets it apart from other levels."""

    def __init__(self, words: np.ndarray, seed: int):
        self.words, self.seed = words, seed

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return bit_places(hashes, self.seed, len(self.words) * 64)

    def takes(self, hashes: np.ndarray) -> np.ndarray:
        p = self.places(hashes)
        return ((self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(1)


def bit_places(hashes: np.ndarray, seed: int, bits: int) -> np.ndarray:
    base = mix(hashes ^ mix(np.array([seed], np.uint64)))
    step = mix(base + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return ((base[:, None] + k * step[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """A key is listed if the first level that refuses it is an even one, or none does and their count is odd."""
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        live = np.arange(len(hashes))
        for k, level in enumerate(self.levels):
            ok = level.takes(hashes[live])
            out[live[~ok]] = k % 2 == 1
            live = live[ok]
        return out


def _level(keys: DataFrame, n: int, seed: int) -> Level:
    """The filter of ``n`` keys; its bits are set by executors, a chunk of the filter in each group."""
    words = max(1, -(-n * BITS // 64))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.unique(bit_places(b["h"].to_numpy().view(np.uint64), seed, words * 64))
            yield pd.DataFrame({"chunk": p // _CHUNK, "at": (p % _CHUNK).astype(np.int32)})

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_CHUNK, np.uint8)
        bits[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    chunks = keys.mapInPandas(places, "chunk bigint, at int").distinct().groupBy("chunk").applyInPandas(packed, "chunk bigint, bits binary")
    out = np.zeros(-(-words * 64 // _CHUNK) * _CHUNK // 8, np.uint8)
    for r in chunks.collect():  # MOST_BYTES, about
        out[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Level(out.view(np.uint64)[:words].copy(), seed)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 1) -> Cascade:
    """From tables of 64-bit key hashes ``h``: the listed ones and all that will ever be asked.

    An empty list gives no level, which lists nothing.
    """
    stage = Staging(universe.sparkSession, "cascade")
    inside, outside = stage.write(listed.select("h").distinct(), "in0"), stage.write(universe.select("h").distinct().join(listed, "h", "left_anti"), "out0")
    levels, k = [], 0
    while n := inside.count():
        level = _level(inside, n, seed + k)
        levels.append(level)
        shared = universe.sparkSession.sparkContext.broadcast(level)

        def taken(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[shared.value.takes(b["h"].to_numpy().view(np.uint64))]

        k += 1
        # the next level encodes the wrongly taken, and is asked about those that this one encoded
        inside, outside = stage.write(outside.mapInPandas(taken, "h bigint"), f"in{k}"), inside
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame | tuple[tuple[str, str], ...] = RULES, url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The input's columns inside ``row``, with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are pairs of a rule and ``allow`` or ``block``, or a table with the columns
    ``rule`` and ``verdict`` of any number of rows; null rules and other verdicts are left
    out. The longest fitting rule decides (of equally long ones the first by text); a rule
    that is on both lists blocks. A url that none fits is on no list and is allowed. Null
    urls and urls without ``://`` have an empty host and path. Rows don't look at each
    other, so repeated rows and null keys are judged like any; an empty table stays empty.
    """
    spark = pages.sparkSession
    stage = Staging(spark, "urls")
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "rule string, verdict string")
    table = stage.write(table.select("rule", "verdict").filter(F.contains("rule", F.lit("/")) & F.col("verdict").isin("allow", "block")).distinct(), "rules")
    lengths = sorted(r["n"] for r in table.select((F.char_length("rule") - F.locate("/", "rule") + 1).alias("n")).distinct().collect())  # a row for each length of path
    counts = {r["verdict"]: r["n"] for r in table.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    passes = max(1, *(-(-n * BITS // 8 * 3 // (2 * most_bytes)) for n in counts.values())) if counts else 1
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    host, path = host_and_path(F.col(url).cast("string"))
    split = pages.select(row, host.alias("host"), path.alias("path"))
    keys = split.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = stage.write(keys.select(F.explode("keys").alias("k")).select(F.xxhash64("k").alias("h")).distinct(), "universe")
    out = keys.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    verdicts = sorted(counts)
    for v in verdicts:
        out = out.withColumn(f"_{v}", F.lit(None).cast("array<boolean>"))
    for turn in range(passes):
        own = lambda df: df.filter(F.pmod("h", F.lit(passes)) == turn)
        cascades = {v: build_cascade(own(table.filter(F.col("verdict") == v).select(F.xxhash64("rule").alias("h"))), own(universe)) for v in verdicts}
        shared = spark.sparkContext.broadcast(cascades)  # most_bytes each, about
        for v in verdicts:
            out = out.withColumn(f"_{v}", _on_list(shared, v, turn, passes)("hashes", f"_{v}"))
        if passes > 1:  # one pass's filters are in memory at a time
            out = stage.write(out, f"pass{turn}", codec="zstd")
            shared.unpersist()
            if turn:
                stage.discard(f"pass{turn - 1}")
    said = lambda i: reduce(lambda a, v: F.when(F.get(F.col(f"_{v}"), i), F.lit(v)).otherwise(a), verdicts, F.lit(None).cast("string"))
    fits = F.filter(F.transform("keys", lambda k, i: F.struct(k.alias("k"), said(i).alias("v"))), lambda x: x["v"].isNotNull())
    return out.withColumn("fit", F.get(fits, F.lit(0))).select("row", "host", "path", F.col("fit.k").alias("rule"), F.coalesce("fit.v", F.lit("allow")).alias("verdict"))


def _on_list(shared, verdict: str, turn: int, passes: int):
    """Whether each key is listed, as found by this pass for its range of hashes and by earlier ones for the rest."""

    @F.pandas_udf("array<boolean>")
    def on_list(hashes: pd.Series, before: pd.Series) -> pd.Series:
        lists = [np.asarray(x, np.int64) for x in hashes]
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        out = np.zeros(len(flat), bool)
        mine = flat % passes == turn  # as pmod: never negative
        out[mine] = shared.value[verdict].listed(flat[mine].view(np.uint64))
        if turn:
            out |= np.concatenate([np.asarray(x, bool) for x in before]) if len(flat) else out
        cut = np.cumsum([0, *map(len, lists)])
        return pd.Series([out[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)])

    return on_list


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLE = r"""
with a as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as r from pages),
b as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from b)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from c
"""
