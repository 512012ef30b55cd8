"""A z-fast trie of conversations, kept as tables.

Conversations are strings of turns. A prefix is known by a 128-bit hash; texts stay where
they are. The trie is built in batches of ascending conversation ids, each several times as
large as all before. For a batch, the trie so far is a dictionary of compacted nodes: each
under its handle, the prefix of its extent whose length is the two-fattest number of the
node's interval of depths, and under its first prefix. Every conversation finds its exit
node by fat binary search, one join with the dictionary for each halving, and only what
lies below its exit is new. New prefixes belong to the smallest conversation of the batch
that has them. As ids ascend, a node stays with the conversation that brought it, so each
conversation *owns* one run of depths, from where it leaves earlier ones to its end, and its
*path* lists the owners above with the depths where it leaves them.

All figures of a node follow from sums over (owner, depth) of what leaves or ends there;
at last each owner's edges are expanded into one row for each depth. Sums are aggregated
before they are shuffled, so a prefix that many share isn't one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, mix

#: Share of all distinct conversations that is in the trie before each batch.
BATCHES = (1 / 64, 1 / 8)
#: Bytes of joined ids that go into a digest at once.
_CHUNK = 1 << 16
_EVENT = "array<struct<o:bigint,d:int>>"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def turn_arrays(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv`` and ``turns``: two hashes and the UTF-8 bytes of every turn, by turn (null first), then role, then text.

    Null roles and texts count as empty. Rows without a key belong to no conversation.
    Repeated rows are turns of their own. Other columns aren't read.
    """
    r, x = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("_t"), r.alias("_r"), x.alias("_x"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("_t"), "_r", "_x"))
    hashed = rows.withColumn("k", place).select("conv", F.struct("k", F.xxhash64("_r", "_x").alias("h1"), F.xxhash64(F.lit(1), "_r", "_x").alias("h2"), F.octet_length("_x").cast("long").alias("n")).alias("t"))
    return hashed.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["h1"], t["h2"], t["n"])).alias("turns"))


def _prefixes(convs: DataFrame) -> DataFrame:
    """``c``, ``len``, ``h`` (16 bytes for every prefix from depth 1) and ``n`` (bytes of every turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            bounds = np.asarray(turns.offsets, np.int64)
            flat = turns.values
            bounds0, sizes = bounds - bounds[0], np.diff(bounds)
            part = flat.slice(bounds[0], bounds[-1] - bounds[0])
            place = np.arange(bounds0[-1]) - np.repeat(bounds0[:-1], sizes)
            out = np.empty((len(place), 2), np.uint64)
            for k in (0, 1):
                powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _ODD[k], np.uint64), dtype=np.uint64)
                terms = mix(np.asarray(part.field(k)).astype(np.int64).view(np.uint64)) * powers[place]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
                out[:, k] = mix(sums[1:] - np.repeat(sums[bounds0[:-1]], sizes))
            ends = (16 * np.arange(len(place) + 1)).astype(np.int32)
            hashes = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])
            lists = [pa.ListArray.from_arrays(pa.array(bounds0, pa.int32()), x) for x in (hashes, part.field(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["c", "len", "h", "n"])

    return convs.select("conv", "turns").mapInArrow(run, "c bigint, len int, h array<binary>, n array<bigint>")


def _fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    low = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, low), low)


def _dictionary(owners: DataFrame, splits: DataFrame) -> DataFrame:
    """Compacted nodes under their handles (``kind`` 0) and first prefixes (1): ``depth``, ``hash``, ``o``, ``s``, ``e``, ``edge``, ``path``.

    A node's interval of depths is (s, e]; ``edge`` has the hashes of its prefixes.
    """
    cuts = splits.select("o", "d").distinct().groupBy("o").agg(F.array_sort(F.collect_list("d")).alias("cuts"))
    owned = owners.join(cuts, owners["c"] == cuts["o"]).withColumn("ends", F.filter("cuts", lambda d: d > F.greatest(F.col("a"), F.lit(0))))
    from_ = lambda x, i: F.coalesce(F.get(F.col("ends"), i - 1), F.greatest(F.col("a"), F.lit(0)))
    pieces = owned.select("o", "h", "path", F.explode(F.transform("ends", lambda e, i: F.struct(from_(e, i).alias("s"), e.alias("e")))).alias("p")).select("o", "p.s", "p.e", "path", F.expr("slice(h, p.s + 1, p.e - p.s)").alias("edge"))
    keys = F.array(F.struct(F.lit(0).alias("kind"), _fattest(F.col("s"), F.col("e")).alias("depth")), F.struct(F.lit(1).alias("kind"), (F.col("s") + 1).alias("depth")))
    return pieces.withColumn("k", F.explode(keys)).select("k.kind", "k.depth", F.expr("edge[k.depth - s - 1]").alias("hash"), "o", "s", "e", "edge", "path")


def _matched(hit: Column) -> Column:
    """Depth to which a conversation and a node's extent agree: prefix hashes are equal up to there and differ beyond."""
    own = F.slice(F.col("h"), hit["s"] + 1, F.size(hit["edge"]))
    return hit["s"] + F.size(F.filter(F.transform(own, lambda x, i: x == F.get(hit["edge"], i)), lambda ok: ok))


def _exits(batch: DataFrame, nodes: DataFrame, root: int, rounds: int) -> DataFrame:
    """For each conversation the depth ``l`` where it leaves the trie, with the path to there (``up``).

    Fat binary search over (_a, _b]: a hit on a handle at the two-fattest depth moves on to the
    end of that node or ends inside of it; a miss ends above the handle. If the last node that
    matched has a child by the next prefix, the exit is inside of that.
    """
    at_root = F.lit([]).cast(_EVENT)
    state = batch.withColumns({"_a": F.lit(0), "_b": F.col("len"), "_o": F.lit(root).cast("long"), "_p": at_root, "_in": F.lit(False)})
    found = nodes.select("kind", "depth", "hash", F.struct("o", "s", "e", "edge", "path").alias("hit"))
    for k in range(rounds + 1):
        last = k == rounds
        probe = F.col("_a") + 1 if last else F.when(F.col("_a") < F.col("_b"), _fattest(F.col("_a"), F.col("_b")))
        probe = F.when(~F.col("_in") & (probe <= F.col("len")), probe)
        state = state.withColumn("_f", probe)
        # a conversation that is done asks for nothing: its own id keeps those rows apart
        state = state.withColumn("_q", F.coalesce(F.expr("h[_f - 1]"), F.col("c").cast("string").cast("binary"))).withColumn("_f", F.coalesce("_f", F.lit(-1)))
        side = found.filter(F.col("kind") == int(last)).select(F.col("depth").alias("_f"), F.col("hash").alias("_q"), "hit")
        state = state.join(side, ["_f", "_q"], "left").withColumn("_m", F.when(F.col("hit").isNotNull(), _matched(F.col("hit"))))
        hit, whole = F.col("hit").isNotNull(), F.col("_m") == F.col("hit.e")
        state = state.select(
            "c", "len", "h", "n", "copies",
            F.when(hit, F.col("_m")).otherwise(F.col("_a")).alias("_a"),
            F.when(~hit & (F.col("_f") > 0), F.col("_f") - 1).otherwise(F.col("_b")).alias("_b"),
            F.when(hit, F.col("hit.o")).otherwise(F.col("_o")).alias("_o"),
            F.when(hit, F.col("hit.path")).otherwise(F.col("_p")).alias("_p"),
            (F.col("_in") | (hit & ~F.coalesce(whole, F.lit(False)))).alias("_in"),
        )
    return state.select("c", "len", "h", "n", "copies", F.col("_a").alias("l"), F.concat("_p", F.array(F.struct(F.col("_o").alias("o"), F.col("_a").alias("d")))).alias("up"))


def _insert(left: DataFrame, stage: Staging, root: int, k: int) -> DataFrame:
    """Strings of a batch with ``a`` (the depth above their own nodes, ``len`` if they own none) and ``path``.

    Prefixes below the exits go to the smallest conversation of the batch that has them.
    """
    each = left.filter("l < len").select("c", F.explode(F.expr("transform(slice(h, l + 1, len - l), (x, i) -> struct(l + 1 + i as d, x as q))")).alias("x")).select("c", "x.d", "x.q")
    each = stage.write(each, f"new{k}")
    first = each.groupBy("d", "q").agg(F.min("c").alias("o"))
    chain = each.join(first, ["d", "q"]).groupBy("c", "o").agg(F.max("d").alias("d"), F.min("d").alias("f"))
    chain = chain.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "o", "f"))).alias("chain"))
    out = left.join(chain, "c", "left").withColumn("chain", F.coalesce("chain", F.lit([]).cast("array<struct<d:int,o:bigint,f:int>>")))
    own = F.filter("chain", lambda x: x["o"] == F.col("c"))
    above = F.transform(F.filter("chain", lambda x: x["o"] != F.col("c")), lambda x: F.struct(x["o"].alias("o"), x["d"].alias("d")))
    path = F.concat(F.filter("up", lambda x: ~F.exists(above, lambda y: y["o"] == x["o"])), above)  # an owner counts where it is left at last
    first_one = F.col("c") == root
    a = F.when(first_one, -1).when(F.size(own) > 0, F.get(own, F.lit(0))["f"] - 1).otherwise(F.col("len"))
    return out.select("c", "len", "h", "n", "copies", a.alias("a"), F.when(first_one, F.lit([]).cast(_EVENT)).otherwise(path).alias("path"))


def _suffix(depths: list[int], values: list[int], lo: int, hi: int) -> np.ndarray:
    """Sums over all depths from each of lo .. hi on."""
    at = np.zeros(hi - lo + 1, np.int64)
    np.add.at(at, np.asarray(depths, np.int64) - lo, np.asarray(values, np.int64))
    return np.cumsum(at[::-1])[::-1]


def _edge_bytes(n: list[int], a: int) -> np.ndarray:
    """Bytes of the last turns of an owner's nodes; the root has none."""
    return np.asarray(([0] + n) if a < 0 else n[a:], np.int64)


def _own_sums(owners: DataFrame) -> DataFrame:
    """``o``, ``saved`` by an owner's own nodes, and whether its end is a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, a, length, n, at = (b.column(i).to_pylist() for i in range(5))
            saved, leaf = [], []
            for i in range(len(c)):
                here = at[i] or []
                counts = _suffix([x["d"] for x in here], [x["convs"] for x in here], a[i] + 1, length[i])
                saved.append(int(((counts - 1) * _edge_bytes(n[i], a[i])).sum()))
                leaf.append(int(not any(x["d"] == length[i] and x["kids"] for x in here)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(saved, pa.int64()), pa.array(leaf, pa.int64())], ["o", "saved", "leaf"])

    return owners.select("c", "a", "len", "n", "at").mapInArrow(run, "o bigint, saved bigint, leaf bigint")


def _expand(owners: DataFrame) -> DataFrame:
    """One row for each depth that an owner owns."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = hashlib.sha256(b"").hexdigest()

    def rows(c, a, length, n, up, at):
        d = np.arange(a + 1, length + 1)
        sums = {k: _suffix([x["d"] for x in at], [x[k] or 0 for x in at], a + 1, length) for k in ("convs", "leaves", "saved")}
        kids = np.zeros(len(d), np.int64)
        ends = [none] * len(d)
        for x in at:
            kids[x["d"] - a - 1] += x["kids"] or 0
            ends[x["d"] - a - 1] = x["ends"] or none
        leaf = int(kids[-1] == 0)
        kids[:-1] += 1
        own = (sums["convs"] - 1) * _edge_bytes(n, a)
        saved = sums["saved"] + np.cumsum(own[::-1])[::-1]
        return [[c] * len(d), d, [up, *[c] * (len(d) - 1)], sums["convs"], kids, sums["leaves"] + leaf, saved, ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for c, a, length, n, up, at in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for out, x in zip(cols, rows(c, a, length, n, up, at or []), strict=True):
                    out.extend(x)
                if len(cols[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 7 else pa.int64()) for k, x in enumerate(cols)], names)
                    cols = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 7 else pa.int64()) for k, x in enumerate(cols)], names)

    schema = ", ".join(f"{x} {'string' if x == 'ends_sha256' else 'bigint'}" for x in names)
    return owners.select("c", "a", "len", "n", "up", "at").mapInArrow(run, schema)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids (``c``) of each (``o``, ``d``), ascending and joined by commas.

    Ids are joined where they have been sorted, whatever node they are of; a digest then
    streams over few long pieces, in constant memory.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, parts, size = None, 0, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int32()), pa.array([first], pa.int64()), pa.array([",".join(parts)])], ["o", "d", "first", "ids"])

        done: list = []
        for b in batches:
            for o, d, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (o, d) != node or size >= _CHUNK:
                    if node:
                        done.append(piece())
                    node, first, parts, size = (o, d), c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if node:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], ["o", "d", "ends"])

        for b in batches:
            for o, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if (o, d) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (o, d), hashlib.sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            yield made()
            out = []
        if node:
            out.append((*node, state.hexdigest()))
            yield made()

    pieces = ends.repartitionByRange("o", "d", "c").sortWithinPartitions("o", "d", "c").mapInArrow(join, "o bigint, d int, first bigint, ids string")
    return pieces.repartition("o", "d").sortWithinPartitions("o", "d", "first").mapInArrow(digest, "o bigint, d int, ends string")


def conversation_trie(convs: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """Nodes of the trie of ``convs`` (``conv``: a unique long; ``turns`` as ``turn_arrays`` makes them).

    One row for each distinct sequence of first turns, the empty one (the root) included:
    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. A
    conversation without turns is a member of the root alone and ends there. Equal
    conversations are inserted once and counted. No conversations give no rows. A
    conversation's hashes (32 bytes a turn) must fit a task's memory; equal hashes of 128
    bits count as equal prefixes.
    """
    spark = convs.sparkSession
    stage = Staging(spark, "trie")
    all_ = stage.write(_prefixes(convs), "prefixes", codec="zstd")
    end = F.coalesce(F.get(F.col("h"), F.col("len") - 1), F.lit(b""))
    ids = all_.select("c", "len", end.alias("q"))
    root, longest = all_.agg(F.min("c"), F.max("len")).first()
    if root is None:
        return _expand(spark.createDataFrame([], "c bigint, a int, len int, n array<bigint>, up bigint, at array<struct<d:int,convs:bigint,kids:bigint,leaves:bigint,saved:bigint,ends:string>>"))
    same = ids.groupBy("len", "q").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("copies"))
    strings = stage.write(all_.join(same.select("c", "copies"), "c"), "strings", codec="zstd")
    cuts = [float("-inf"), *strings.approxQuantile("c", list(batches), 0.001), float("inf")]
    rounds = max(1, int(longest).bit_length())
    done: DataFrame | None = None
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        batch = strings.filter((F.col("c") > lo) & (F.col("c") <= hi)).select("c", "len", "h", "n", "copies")
        if done is None:
            left = batch.select("*", F.lit(0).alias("l"), F.array(F.struct(F.lit(root).cast("long").alias("o"), F.lit(0).alias("d"))).alias("up"))
        else:
            owners = done.filter("a < len")
            splits = owners.select(F.col("c").alias("o"), F.col("len").alias("d")).unionByName(done.select(F.explode("path").alias("e")).select("e.o", "e.d"))
            nodes = stage.write(_dictionary(owners, splits), f"nodes{k}", codec="zstd")
            left = _exits(batch, nodes, root, rounds)
        left = stage.write(left, f"exits{k}", codec="zstd")
        more = stage.write(_insert(left, stage, root, k), f"batch{k}", codec="zstd")
        stage.discard(f"exits{k}")
        stage.discard(f"new{k}")
        done = more if done is None else done.unionByName(more)
    owners, owned = done.filter("a < len"), F.col("a") < F.col("len")
    # what leaves an owner or ends there: conversations, and the children that begin there
    own_end = F.when(owned, F.array(F.struct(F.col("c").alias("o"), F.col("len").alias("d")))).otherwise(F.lit([]).cast(_EVENT))
    events = done.select("copies", F.when(owned, F.size("path") - 1).otherwise(-1).alias("kid"), F.posexplode(F.concat("path", own_end)).alias("i", "e"))
    sums = events.groupBy("e.o", "e.d").agg(F.sum("copies").alias("convs"), F.sum((F.col("i") == F.col("kid")).cast("long")).alias("kids"))
    sums = stage.write(sums, "sums")
    at = sums.groupBy("o").agg(F.collect_list(F.struct("d", "convs", "kids")).alias("at")).withColumnRenamed("o", "c")
    totals = stage.write(_own_sums(owners.join(at, "c", "left")), "totals")
    below = owners.select("c", F.explode("path").alias("e")).join(totals.withColumnRenamed("o", "c"), "c").groupBy("e.o", "e.d").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    # the node where each conversation ends: its own last one, or one on its path
    end_of = done.select("len", end.alias("q"), F.when(owned, F.col("c")).otherwise(F.element_at(F.col("path"), -1)["o"]).alias("o"))
    ends = _digests(ids.join(end_of, ["len", "q"]).select("o", F.col("len").alias("d"), "c"))
    null = lambda kind: F.lit(None).cast(kind)
    parts = [
        sums.select("o", "d", "convs", "kids", null("long").alias("leaves"), null("long").alias("saved"), null("string").alias("ends")),
        below.select("o", "d", null("long").alias("convs"), null("long").alias("kids"), "leaves", "saved", null("string").alias("ends")),
        ends.select("o", "d", null("long").alias("convs"), null("long").alias("kids"), null("long").alias("leaves"), null("long").alias("saved"), "ends"),
    ]
    figures = reduce(DataFrame.unionByName, parts).groupBy("o", "d").agg(*[F.max(x).alias(x) for x in ("convs", "kids", "leaves", "saved", "ends")])
    at = figures.groupBy("o").agg(F.collect_list(F.struct("d", "convs", "kids", "leaves", "saved", "ends")).alias("at")).withColumnRenamed("o", "c")
    return _expand(owners.withColumn("up", F.when(F.col("a") >= 0, F.element_at(F.col("path"), -1)["o"])).join(at, "c", "left"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % 5, then its own beyond its first h; h is crc32 of the decimal c, mod 9."""
    own = convs.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")).withColumn("_base", F.col("conv") - F.col("conv") % 5)
    bases = convs.filter("conv % 5 = 0").select(F.col("conv").alias("_base"), F.slice("turns", 1, 8).alias("_head"))
    empty = F.slice("turns", 1, 0)
    out = own.join(bases, "_base", "left").withColumn("_head", F.coalesce("_head", empty))
    return out.select("conv", F.concat(F.slice("_head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(rebuilt(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = r"""
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
  SELECT c, turns, flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM own),
crc AS (
  SELECT c, turns,
         (xor(list_reduce(list_concat([4294967295::BIGINT], steps), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 9)::INT AS h
  FROM bits),
built AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns
  FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, len(turns) AS n, d, list_slice(turns, 1, d) AS k FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM prefixes GROUP BY d, k),
kids AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN nodes.d > 0 THEN (n_convs - 1) * strlen(nodes.k[nodes.d].x) ELSE 0 END AS own FROM nodes LEFT JOIN kids USING (d, k)),
above AS (SELECT i AS d, list_slice(k, 1, i) AS k, own, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM full_)),
sums AS (SELECT d, k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM above GROUP BY d, k)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums s ON s.d = f.d AND s.k = f.k LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = list_slice(f.k, 1, f.d - 1)
"""
