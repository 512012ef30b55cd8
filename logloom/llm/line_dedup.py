"""Lines that earlier documents have, found by sorting hashes, with DataFrame functions only.

Every long enough line becomes a row of its key's 128-bit hash, its document and its place;
texts stay where they are. The rows are range-partitioned by hash and sorted by document and
place inside each hash, so that a running first value names the document that holds a line
first, as the rows stream by. A hash of very many rows would be one task's work: a sketch of
frequent items finds those, their first documents are aggregated before any shuffle (at most
``HOT_KEYS`` rows) and sent to the rows instead.

The result isn't text but a compressed bitmap for each document: the runs of lines to keep.
``kept_text`` applies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, row_keys

#: What is stripped at both ends of a line.
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most hashes that are taken out as frequent, and the share of all rows (one in so many) that makes one frequent.
HOT_KEYS, HOT_SHARE = 512, 1024


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    key = F.btrim(line, F.lit(_BLANKS))
    plain = F.octet_length(key) == F.char_length(key)
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def pack_runs(runs: Column) -> Column:
    """Runs of kept lines (structs of ``at`` and ``n``) as bytes: two 32-bit numbers each."""
    word = lambda x: F.lpad(F.hex(x), 8, "0")
    return F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(word(r["at"]), word(r["n"]))), ""))


def unpack_runs(packed: Column) -> Column:
    number = lambda at: F.conv(F.hex(F.substring(packed, at, 4)), 16, 10).cast("int")
    places = F.when(F.octet_length(packed) > 0, F.sequence(F.lit(0), (F.octet_length(packed) / 8).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(number(k * 8 + 1).alias("at"), number(k * 8 + 5).alias("n")))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined by \\n."""
    lines = _lines(text)
    return F.array_join(F.flatten(F.transform(unpack_runs(keep), lambda r: F.slice(lines, r["at"] + 1, r["n"]))), "\n")


def _frequent(lines: DataFrame) -> list[int]:
    """First halves of hashes that may hold more than one in ``HOT_SHARE`` rows."""
    n, top = lines.select(F.count(F.lit(1)), F.expr(f"approx_top_k(h1, {HOT_KEYS}, {8 * HOT_SHARE})")).first()
    return [x["item"] for x in top or [] if x["count"] * HOT_SHARE > n]


def _repeats(lines: DataFrame) -> DataFrame:
    """(_rid, pos) of lines whose hash a smaller document has."""
    hot = _frequent(lines)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    first = F.first("_rid").over(Window.partitionBy("h1", "h2").orderBy("_rid", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = lines.filter(~is_hot).repartitionByRange("h1", "h2").withColumn("_first", first).filter("_rid <> _first").select("_rid", "pos")
    if hot:
        rows = lines.filter(is_hot)
        firsts = rows.groupBy("h1", "h2").agg(F.min("_rid").alias("_first"))  # HOT_KEYS rows, but for collisions of half a hash
        out = out.unionByName(rows.join(F.broadcast(firsts), ["h1", "h2"]).filter("_rid <> _first").select("_rid", "pos"))
    return out


def line_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """All rows of ``docs`` in ``row`` (a struct), with ``n_lines``, ``n_dropped`` and ``keep``.

    Lines of a null or empty text: one, empty. A line whose key has ``least`` code points or
    more goes if a document with a smaller ``key`` holds that key as well; all lines of the
    first document stay, repeated ones too. Rows that share a key but not their text are
    documents of their own, in the order of the texts' hashes, null keys first; rows repeated
    whole are one document and share their fate. An empty table gives no rows. Other columns
    live inside ``row``, so none can clash. Equal hashes of 128 bits count as equal keys.
    """
    stage = Staging(docs.sparkSession, "linededup")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    held, _ = row_keys(held, "_key", "_text")
    each = held.select("_rid", F.posexplode(_lines(F.col("_text"))).alias("pos", "line")).select("_rid", "pos", line_key(F.col("line")).alias("k"))
    lines = each.filter(F.char_length("k") >= least).select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), "_rid", "pos")
    lines = stage.write(lines, "lines")
    sizes = held.select("_rid", F.lit(None).cast("int").alias("pos"), F.size(_lines(F.col("_text"))).alias("_n"))
    dropped = _repeats(lines).select("_rid", "pos", F.lit(None).cast("int").alias("_n"))
    found = sizes.unionByName(dropped).groupBy("_rid").agg(F.max("_n").alias("_n"), F.sort_array(F.collect_set("pos")).alias("_gone"))
    # what lies between dropped lines stays
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.col("_n")))
    between = F.transform(F.col("_gone"), lambda p, i: F.struct((F.get(edges, i) + 1).alias("at"), (p - F.get(edges, i) - 1).alias("n")))
    last = F.struct((F.get(edges, F.size("_gone")) + 1).alias("at"), (F.col("_n") - F.get(edges, F.size("_gone")) - 1).alias("n"))
    runs = F.filter(F.concat(between, F.array(last)), lambda r: r["n"] > 0)
    maps = found.select("_rid", F.col("_n").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"), pack_runs(runs).alias("keep"))
    maps = stage.write(maps, "bitmaps")
    return held.select("_rid", "row").join(maps, "_rid").drop("_rid")


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``docs`` with the texts that remain; a null text without dropped lines stays null."""
    out = line_bitmaps(docs, key, text, least)
    left = F.when(F.col("n_dropped") > 0, kept_text(F.col(f"row.`{text}`"), F.col("keep"))).otherwise(F.col(f"row.`{text}`"))
    return out.select(*[(left if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_bitmaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.sha2(kept_text(F.col("row.text"), F.col("keep")).cast("binary"), 256)
    return out.select("row.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


ORACLE = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM each),
firsts AS (SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT keyed.*, coalesce(keyed.doc_id <> holder, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
