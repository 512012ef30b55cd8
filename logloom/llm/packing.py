"""Packing by non-negative least squares over a histogram of lengths.

Whole windows of a document stand alone. The rests' lengths are counted in classes; all
combinations of at most four classes that fill a window are enumerated, and non-negative
least squares finds how often each should repeat to use up the histogram. Rounded down,
the repeats take their documents by rank; the residual documents are then laid, cut where
needed, into the gaps that the combinations leave and after that into new sequences.
Only the histogram and at most one combination for each class reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, prefix_sums, running_rank
from .tokens import tokenize

#: Classes of lengths in a window, and the most documents in a combination.
CLASSES, DEPTH = 64, 4
#: Rows that share one running sum inside a window function, about.
_PART_ROWS = 20_000
_BLOCK = 1024  # tokens of the line on which residual documents and gaps meet


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` class sizes that add up to ``classes``."""
    out: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for size in range(min(left, most), 0, -1):
                extend((*parts, size), left - size, size)

    extend((), classes, classes)
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 500) -> np.ndarray:
    """min |ax - b| over x >= 0 by active sets: at most as many positive entries as ``a`` has rows."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(most):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[k] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 1e-12)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and whole repeats that never use more of a class than there is."""
    sets = combinations(len(histogram), depth)
    a = np.zeros((len(histogram), len(sets)))
    for k, parts in enumerate(sets):
        for size in parts:
            a[size - 1, k] += 1
    x = np.floor(nnls(a, histogram.astype(float)) + 1e-6)
    order = np.argsort(-x)
    left, out = histogram.astype(np.int64).copy(), []
    for k in order:
        use = a[:, k] > 0
        n = int(min(x[k], *(left[use] // a[use, k].astype(np.int64))))
        if n > 0:
            left -= (n * a[:, k]).astype(np.int64)
            out.append((sets[k], n))
    return out


def _running(rows: DataFrame, value: str, name: str, parts: int) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows, in parts by a hash of ``row``."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    before = prefix_sums(rows.groupBy("_part").agg(F.sum(value).alias("_s")), "_part", "_s", "_before").select("_part", "_before")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inner", inner).join(before, "_part").withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_inner", "_before")


def pack(lengths: DataFrame, window: int = 4096, classes: int = CLASSES, depth: int = DEPTH, stage: Staging | None = None) -> DataFrame:
    """Pieces (``row``, ``start``, ``length``, ``sequence_id``, ``offset``) of rows with ``row`` and ``n`` > 0 tokens."""
    stage = stage or Staging(lengths.sparkSession, "pack")
    spark, step = lengths.sparkSession, window // classes
    rows = lengths.select("row", "n", F.floor(F.col("n") / window).cast("long").alias("full"), (F.col("n") % window).alias("rest"))
    rows = rows.withColumn("class", F.ceil(F.col("rest") / step).cast("int"))
    counts = {r["class"]: r for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("k"), F.sum("full").alias("f")).collect()}
    histogram = np.array([counts[c]["k"] if c in counts else 0 for c in range(1, classes + 1)], np.int64)
    total, n_full = sum(r["k"] for r in counts.values()), sum(r["f"] for r in counts.values())
    chosen = plan(histogram, depth)
    parts = max(1, total // _PART_ROWS)

    # whole windows: sequences 0 .. n_full - 1
    full = _running(rows.filter("full > 0"), "full", "base", parts)
    whole = full.select("row", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k", "_"), "base").select(
        "row", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    # slots of each class, in ranks: (class, from, to, first sequence, times in the combination, place there)
    slots, used, base = [], np.zeros(classes + 1, np.int64), n_full
    for combo, n in chosen:
        place = 0
        for size in dict.fromkeys(combo):
            times = combo.count(size)
            slots.append((size, int(used[size]), int(used[size] + n * times), int(base), times, place))
            used[size] += n * times
            place += times
        base += n
    n_combined = base - n_full
    spread = max(1, int(histogram.max(initial=0)) // _PART_ROWS)
    starts = np.concatenate([[0], np.cumsum(histogram)])
    first_rank = spark.createDataFrame([(c, int(starts[c - 1]), int(used[c])) for c in range(1, classes + 1)], "class int, first long, used long")
    rest = rows.filter("rest > 0").withColumn("_part", F.col("class").cast("long") * spread + F.pmod(F.xxhash64("row"), F.lit(spread)))
    ranked = running_rank(rest, "_part", ["row"], "_global").join(F.broadcast(first_rank), "class").withColumn("rank", F.col("_global") - F.col("first"))  # one row for each class
    ranked = stage.write(ranked.select("row", "full", "rest", "class", "rank", "used"), "ranked")

    table = spark.createDataFrame(slots, "class int, lo long, hi long, base long, times int, place int")
    r, t = ranked.filter("rank < used").alias("r"), F.broadcast(table).alias("t")  # four rows for each class at most
    placed = r.join(t, (F.col("r.class") == F.col("t.class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("times"))).withColumn("at", F.col("place") + (F.col("rank") - F.col("lo")) % F.col("times"))
    by = Window.partitionBy("sequence_id").orderBy("at", "row")
    placed = placed.withColumn("offset", F.coalesce(F.sum("rest").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    combined = stage.write(placed.select("row", (F.col("full") * window).alias("start"), F.col("rest").alias("length"), "sequence_id", "offset"), "combined")

    # residual documents and gaps are intervals of one line
    left = _running(ranked.filter("rank >= used"), "rest", "x", parts).select("row", (F.col("full") * window).alias("start"), "rest", "x")
    left = stage.write(left, "left")
    gaps = combined.groupBy(F.col("sequence_id").alias("row")).agg((F.lit(window) - F.sum("length")).alias("gap")).filter("gap > 0")
    gaps = stage.write(_running(gaps, "gap", "g", max(1, n_combined // _PART_ROWS)).select(F.col("row").alias("sequence_id"), "gap", "g"), "gaps")
    room = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    blocks = lambda a, n: F.explode(F.sequence(F.floor(a / _BLOCK).cast("long"), F.floor((a + n - 1) / _BLOCK).cast("long"))).alias("block")
    d = left.filter(F.col("x") < room).select("*", blocks(F.col("x"), F.col("rest")))
    g = gaps.select("*", blocks(F.col("g"), F.col("gap")))
    lo, hi = F.greatest("x", "g"), F.least(F.col("x") + F.col("rest"), F.col("g") + F.col("gap"))
    filled = (
        d.join(g, "block")
        .withColumn("lo", lo)
        .withColumn("hi", hi)
        .filter((F.col("hi") > F.col("lo")) & (F.col("block") == F.floor(F.col("lo") / _BLOCK)))
        .select("row", (F.col("start") + F.col("lo") - F.col("x")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"), "sequence_id", (F.lit(window) - F.col("gap") + F.col("lo") - F.col("g")).alias("offset"))
    )
    # what lies beyond the gaps goes on in new sequences
    begin = F.greatest(F.col("x"), F.lit(room)) - room
    over = left.filter(F.col("x") + F.col("rest") > room).withColumn("b", begin).withColumn("e", F.col("x") + F.col("rest") - room)
    over = over.withColumn("w", F.explode(F.sequence(F.floor(F.col("b") / window).cast("long"), F.floor((F.col("e") - 1) / window).cast("long"))))
    lo, hi = F.greatest(F.col("b"), F.col("w") * window), F.least(F.col("e"), (F.col("w") + 1) * window)
    fresh = over.select("row", (F.col("start") + lo + room - F.col("x")).alias("start"), (hi - lo).alias("length"), (F.col("w") + base).alias("sequence_id"), (lo - F.col("w") * window).alias("offset"))
    columns = [F.col(c).cast("long").alias(c) for c in ("row", "start", "length", "sequence_id", "offset")]
    return whole.select(*columns).unionByName(combined.select(*columns)).unionByName(filled.select(*columns)).unionByName(fresh.select(*columns))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, tokenizer: str = "word_bpe_49k.json", end: int = 2) -> DataFrame:
    """Every piece with its token ids: ``key``, ``start``, ``length``, ``sequence_id``, ``offset``, ``doc_tokens``, ``ids``.

    Null and empty texts are one end token. Rows that repeat a key or a whole row are
    packed each for itself. An empty table gives no pieces.
    """
    stage = Staging(docs.sparkSession, "packing")
    tokens = stage.write(tokenize(docs, key, text, tokenizer, end), "tokens", codec="zstd")
    pieces = pack(tokens.select("row", "n"), window, stage=stage)
    cuts = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))
    joined = tokens.hint("merge").join(cuts.hint("merge"), "row").select("key", "n", "ids", F.explode("cuts").alias("c"))
    part = F.expr("substring(ids, cast(2 * c.start + 1 as int), cast(2 * c.length as int))")
    return joined.select(F.col("key").alias(key), "c.*", F.col("n").alias("doc_tokens"), part.alias("ids"))


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, of the ids as little-endian 32-bit numbers."""
    rest = [c for c in pieces.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes()) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(rest))], pa.array(crc, pa.int64())], [*rest, "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids")
    return pieces.select(*rest, "ids").mapInArrow(run, f"{schema}, ids_crc32 bigint")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    out = with_crc(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
