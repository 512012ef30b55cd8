"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashes of five consecutive words. Tasks count, for each class of tokens, those
that they met in several documents; the classes' counts over all documents are a table of
fixed size, and a class is frequent if its count is well above the mean of all, so that some
are rare however large the corpus. Tokens are ordered by class count, rare ones first, then by hash. Two sets
with a Jaccard similarity of t or more share a token among the first n - ceil(t n) + 1 of
either. If the least token that they share is rare, both have it as a single key. If it
is frequent, all shared tokens are, and the prefix is extended: of the n_x + n_y - 2 o
tokens that aren't shared at most 0.4 n_x lie between the shared ones in a way that keeps
two shared neighbours apart, so among the first 0.4 n + 2 frequent tokens (less two for
each rare one) some pair of neighbours is the same in both sets. So neighbours in the
order are the combinations that are indexed: their number is linear in the set.

Equal sets link, and one document of each set has keys: room and work beyond the reading
of the texts grow with the different sets, however many copies a corpus holds. Keys of the
same documents name one class, so that what families have in common counts once. Documents of one class aren't expanded to all pairs at once. Each is
verified against one of them, which a hash picks; links are joined to components; and
only documents of one class that lie in different components remain, which shrinks large
groups of copies to nothing. What remains is verified in full. Before sets are fetched,
pairs whose sizes, whose least key's place or whose bitmaps of parities rule the
similarity out are dropped; none of these can drop a pair that links. No step needs all
rows of a key in one task: counts are combined before they are shuffled, and joins are
plain ones, which Spark splits where they are skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Staging, hash_spans, mix, row_chunks, row_keys, settings, shingles, signed, text_buffers, whole_row, word_spans

WORDS = 5
#: Cells of the table of class counts (a byte each), and documents of one stretch of a task's text that make a token count.
CELLS, OFTEN = 1 << 22, 2
_SHIFT = np.uint64(64 - 22)
#: Text bytes of a stretch, and of one in which copies are told.
_COUNT_BYTES, _LOCAL_BYTES = 16 << 20, 32 << 20
_COUNT_ROWS = 1 << 16  # cells in a row of partial counts
#: Bytes of an Arrow batch, which the JVM and the Python worker of each task both hold.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Times the mean count beyond which a class is frequent.
_FREQUENT = 4
#: Bits of the small bitmaps that joins look at, and sizes from which they can't tell sets apart.
_SMALL, _TELLS = 256, 1024
#: Orders by which a class picks the document that the others are verified against; few, so that classes of a group pick alike.
_ORDERS = 4
#: Least classes of a document by which a pair that shares many is told to have come out before.
_MARKS = 16


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of every row."""
    starts, ends, firsts = word_spans(data, offsets)
    tokens, bounds = shingles(hash_spans(LOWER[data], starts, ends), firsts, WORDS)
    return [np.unique(tokens[a:b]) if b > a else tokens[:0] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def name_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    if not len(tokens):
        return 0, 0
    return int(mix(tokens).sum(dtype=np.uint64).view(np.int64)), int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CELLS, np.int32)
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    size = 0

    def settle() -> None:
        if held:
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()  # in place: a task's memory is what limits the stretch
            firsts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(firsts, append=len(tokens))
            often = counts >= OFTEN
            np.add.at(cells, (tokens[firsts[often]] >> _SHIFT).astype(np.int64), counts[often].astype(np.int32))

    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in row_chunks(offsets):
            for tokens in sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                if len(tokens) and (name := name_of(tokens)) not in seen:  # copies count once
                    seen.add(name)
                    held.append(tokens)
            size += int(offsets[j] - offsets[i])
            if size >= _COUNT_BYTES:
                settle()
                size = 0
                seen.clear()
    settle()
    for k in range(0, CELLS, _COUNT_ROWS):
        part = cells[k : k + _COUNT_ROWS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(part, 65535).astype("<u2").tobytes()], pa.binary())], ["k", "x"])


def _sum_counts(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_COUNT_ROWS, np.int64)
    for batch in tables:
        for x in batch.column(1):
            total += np.frombuffer(x.as_py(), "<u2")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([levels(total).tobytes()], pa.binary())], ["k", "x"])


def class_counts(docs: DataFrame, text: str) -> np.ndarray:
    """For each class of tokens 0 if it is rare, else a level that grows with how often stretches met its tokens in OFTEN documents or more; covers all documents."""
    parts = docs.select(text).mapInArrow(_class_counts, "k int, x binary").groupBy("k").applyInArrow(_sum_counts, "k int, x binary")
    out = np.zeros(CELLS, np.uint8)
    with settings(docs.sparkSession, _BATCH):
        for r in parts.toLocalIterator():  # a byte for each of CELLS
            out[r["k"] : r["k"] + _COUNT_ROWS] = np.frombuffer(bytes(r["x"]), np.uint8)
    return frequent(out)


def levels(total: np.ndarray) -> np.ndarray:
    """Counts as bytes, eight steps for each doubling; 0 for none."""
    return np.where(total > 0, np.clip(1 + 8 * np.log2(np.maximum(total, 1)), 1, 255), 0).astype(np.uint8)


def frequent(level: np.ndarray) -> np.ndarray:
    """The levels of classes whose count is beyond _FREQUENT times the mean of all, 0 for the others."""
    count = np.append(0, 2 ** (np.arange(255) / 8))
    mean = (np.bincount(level, minlength=256) * count).sum() / len(level)
    return np.where(np.arange(256) * (count > _FREQUENT * mean), np.arange(256), 0).astype(np.uint8)[level]


def bitmap(tokens: np.ndarray, bits: int = 0) -> bytes:
    """Parities of the tokens' counts in ``bits`` cells (0: about as many as there are tokens).

    Each token that two sets don't share changes one cell at most, so the cells in which
    their bitmaps differ are no more than those tokens.
    """
    bits = bits or max(64, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps don't rule the similarity out; the longer one is folded to the shorter's cells."""
    for batch in batches:
        a, b, na, nb, ba, bb = (batch.column(i) for i in range(6))
        keep = np.zeros(batch.num_rows, bool)
        sizes = na.to_numpy().astype(np.int64) + nb.to_numpy()
        for i, (x, y) in enumerate(zip(ba.to_pylist(), bb.to_pylist(), strict=True)):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            while len(u) > len(v):
                u = u[: len(u) // 2] ^ u[len(u) // 2 :]
            while len(v) > len(u):
                v = v[: len(v) // 2] ^ v[len(v) // 2 :]
            keep[i] = 9 * int(np.bitwise_count(u ^ v).sum()) <= sizes[i]
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))


def keys_of(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Single tokens of rare classes, in order, then neighbouring pairs of frequent ones, for a similarity of 0.8; and how many are single."""
    n = len(tokens)
    if n == 0:
        return tokens, 0
    base = n - (4 * n + 4) // 5 + 1
    f = counts[(tokens >> _SHIFT).astype(np.int64)]
    rare = tokens[f == 0]
    single = mix(rare[:base])
    if len(rare) >= base:
        return single, len(single)
    frequent = np.flatnonzero(f > 0)
    frequent = tokens[frequent[np.argsort(f[frequent], kind="stable")]]
    most = (4 * n) // 10 + 2 - 2 * len(rare)
    first = frequent[: max(0, most)]
    pairs = mix(first[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(first[1:]))
    return np.concatenate([single, pairs]), len(single)


def components(edges: DataFrame, stage: Staging) -> DataFrame:
    """(``id``, ``comp``) for the ends of edges (``a``, ``b``): the least id that each can reach.

    In every round each node goes over to the first node within two edges, in an order that
    a hash deals anew; nodes that go to one merge, and the edges between merged nodes are
    the next round's. Whatever is left is a window's minimum, so a path loses two thirds of
    its nodes in a round and a star all but one: the rounds grow with the logarithm of a
    component's size, however long its chains are.
    """
    tag = len(stage.paths)
    first = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
    live = stage.write(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"live{tag}-0")
    labels, turn = None, 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(first("b")).alias("f")).select(F.col("a").alias("id"), F.least("f", first("a")).alias("f"))
        far = both.join(near.select(F.col("id").alias("b"), "f"), "b").groupBy(F.col("a").alias("id")).agg(F.min("f")["to"].alias("to"))
        moved = stage.write(far, f"moved{tag}-{turn}")
        if labels is None:
            labels = stage.write(moved.select("id", F.col("to").alias("label")), f"labels{tag}-0")
        else:
            labels = stage.write(labels.join(moved.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), f"labels{tag}-{turn}")
            stage.discard(f"labels{tag}-{turn - 1}")
        ends = live.join(moved.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(moved.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        live = stage.write(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"live{tag}-{turn + 1}")
        stage.discard(f"live{tag}-{turn}")
        stage.discard(f"moved{tag}-{turn}")
        turn += 1
    if labels is None:
        return live.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    least = labels.groupBy("label").agg(F.min("id").alias("comp"))
    return stage.write(labels.join(least, "label").select("id", "comp"), f"components{tag}")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (``a``, ``b``) of rows of ``sets`` (``rid``, ``tokens``) whose Jaccard similarity is 0.8 or more."""
    one = pairs.hint("merge").join(sets.hint("merge").select(F.col("rid").alias("b"), F.col("tokens").alias("tb")), "b")
    two = one.hint("merge").join(sets.hint("merge").select(F.col("rid").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    return two.withColumn("o", shared).filter(100 * F.col("o") >= 80 * (F.size("ta") + F.size("tb") - F.col("o"))).select("a", "b")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (``a`` < ``b``) of rows ``x`` and ``y`` of a key that sizes and places allow to link.

    The least key that linked sets share leaves both enough tokens from there on; a
    pair passes if one of its keys does. Keys of pairs of tokens are placed after the
    rare tokens: sets that have no rare token in common share frequent ones alone.
    """
    n, m = F.col("x.n"), F.col("y.n")
    enough = F.ceil(4 * (n + m) / F.lit(9))
    ok = (F.col("x.rid") != F.col("y.rid")) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (n - F.col("x.at") >= enough) & (m - F.col("y.at") >= enough)
    return rows.filter(ok).select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()


def _plausible_pairs(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    one = pairs.hint("merge").join(bits.hint("merge").select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    two = one.hint("merge").join(bits.hint("merge").select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    return two.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_plausible, "a bigint, b bigint")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in row_chunks(offsets):
            own = [signed(x) for x in sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.list_(pa.int64()))], ["rid", "tokens"])


def _sets(texts: DataFrame, pairs: DataFrame, stage: Staging, name: str) -> DataFrame:
    """The token sets of documents that a pair asks for."""
    wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    # wanted grows with the corpus: the same join at any size
    texts = texts.hint("merge").join(wanted.hint("merge"), F.col("_rid") == F.col("rid"), "left_semi")
    return stage.write(texts.mapInArrow(_tokens, "rid bigint, tokens array<bigint>"), name)


def similarity_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (least key reachable by links), ``_rid`` and ``_comp`` of every document.

    Fewer words than five are one shingle; null, empty and wordless texts have none and
    link with nothing. Null keys don't name a component unless all its keys are null.
    Rows that repeat a key count apart, rows repeated whole alike.
    """
    keyed, unique = row_keys(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")), "_key", "_text")
    return _similarity_components(keyed, unique).withColumnRenamed("_key", key)


def _similarity_components(docs: DataFrame, unique: bool) -> DataFrame:
    """Of documents with ``_rid``, ``_key`` and ``_text``; ``unique``: no two share a ``_rid``."""
    with settings(docs.sparkSession, _BATCH):  # all tables are written before it ends
        return _joined(docs, unique)


def _joined(docs: DataFrame, unique: bool) -> DataFrame:
    spark = docs.sparkSession
    stage = Staging(spark, "jaccard")
    texts = docs.select("_rid", "_text")
    texts = texts if unique else texts.dropDuplicates(["_rid"])  # rows repeated whole take part once
    shared = spark.sparkContext.broadcast(class_counts(texts, "_text"))  # CELLS numbers

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, size = shared.value, set(), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets):
                n, a, b, keys, singles, bits, small = [], [], [], [], [], [], []
                for tokens in sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    name = name_of(tokens)
                    n.append(len(tokens))
                    a.append(name[0])
                    b.append(name[1])
                    again = name in seen
                    seen.add(name)
                    own, single = keys_of(tokens, counts)
                    keys.append(None if again else signed(own))
                    singles.append(None if again else single)
                    bits.append(None if again else bitmap(tokens))
                    small.append(None if again or len(tokens) >= _TELLS else np.frombuffer(bitmap(tokens, _SMALL), np.int64))
                size += int(offsets[j] - offsets[i])
                if size >= _LOCAL_BYTES:
                    seen, size = set(), 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int32()), pa.array(a), pa.array(b), pa.array(keys, pa.list_(pa.int64())), pa.array(singles, pa.int32()), pa.array(bits, pa.binary()), pa.array(small, pa.list_(pa.int64()))], ["rid", "n", "s1", "s2", "keys", "singles", "bits", "small"])

    described = stage.write(texts.mapInArrow(describe, "rid bigint, n int, s1 bigint, s2 bigint, keys array<bigint>, singles int, bits binary, small array<bigint>"), "described")

    # equal sets link, and one document stands for all of a set in what follows: copies add nothing to keys, pairs and sets
    stands = F.min(F.struct(F.col("singles").isNull().alias("again"), "rid"))["rid"]
    low = described.filter("n > 0").groupBy("s1", "s2", "n").agg(stands.alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    equal = stage.write(described.select("rid", "s1", "s2", "n").join(low, ["s1", "s2", "n"]).select(F.col("rid").alias("a"), "b"), "equal")
    sizes = stage.write(described.select("rid", "n"), "sizes")
    copies = equal.filter("a != b").select(F.col("a").alias("rid"))
    unlike = described.filter("keys is not null").select("rid", "n", "keys", "singles", "bits", "small")
    unlike = stage.write(unlike.join(copies, "rid", "left_anti"), "unlike")
    stage.discard("described")

    # a class of keys is named by a hash of its documents; two that share a name by chance are one class, which loses no pair
    rows = unlike.select("rid", "n", F.posexplode("keys").alias("at", "key"), "singles").withColumn("at", F.least("at", "singles"))
    named = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("rid")).alias("class")).filter("k > 1")
    named = stage.write(named.select("key", "class"), "named")
    rows = rows.select("rid", "n", "at", "key").hint("merge").join(named.hint("merge"), "key")
    groups = stage.write(rows.groupBy("class", "rid").agg(F.min("n").alias("n"), F.min("at").alias("at")), "groups")
    bits = stage.write(unlike.select("rid", "n", "bits", "small"), "bits")
    stage.discard("named")
    stage.discard("unlike")

    # one document of each class stands against the others
    own = F.struct("rid", "n", "at")
    hubs = groups.groupBy("class").agg(F.min(F.struct(F.xxhash64("rid", F.pmod("class", F.lit(_ORDERS))).alias("h"), "rid", "n", "at")).alias("x")).select("class", "x")
    against = hubs.hint("merge").join(groups.select("class", own.alias("y")).hint("merge"), "class")
    tried = stage.write(_plausible_pairs(_pairs(against), bits), "pairs")
    links = stage.write(linked(tried, _sets(texts, tried, stage, "sets")), "links")
    stage.discard("sets")
    edges = equal.unionByName(links)
    labels = components(edges, stage)

    # documents of one class in different components: verify what hasn't been yet
    placed = groups.join(labels.withColumnRenamed("id", "rid"), "rid", "left").withColumn("c", F.coalesce("comp", "rid")).drop("comp")
    several = placed.groupBy("class").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("class")
    rest = placed.hint("merge").join(several.hint("merge"), "class", "left_semi")
    rest = stage.write(rest.select("class", "rid", "n", "at", "c"), "unsettled")
    # a pair comes out at the first of the classes that both have among their least _MARKS, else at all they share; so a document's least place holds for all its classes
    marks = rest.groupBy("rid").agg(F.min("at").alias("at"), F.slice(F.sort_array(F.collect_list("class")), 1, _MARKS).alias("marks"))
    rest = rest.drop("at").hint("merge").join(marks.hint("merge"), "rid").hint("merge").join(bits.select("rid", "small").hint("merge"), "rid")
    rest = stage.write(rest.select("class", "c", F.struct("rid", "n", "at", "small", "marks").alias("x")), "rest")
    differ = sum((F.bit_count(F.col("x.small")[i].bitwiseXOR(F.col("y.small")[i])) for i in range(_SMALL // 64)), F.lit(0))
    other = rest.select("class", F.col("x").alias("y"), F.col("c").alias("d"))
    first = F.coalesce(F.array_min(F.array_intersect("x.marks", "y.marks")) >= F.col("class"), F.lit(True))
    more = rest.hint("merge").join(other.hint("merge"), "class").filter("c < d").filter(first).filter(F.coalesce(9 * differ <= F.col("x.n") + F.col("y.n"), F.lit(True)))
    more = stage.write(_plausible_pairs(_pairs(more), bits).join(tried, ["a", "b"], "left_anti"), "more")
    found = stage.write(linked(more, _sets(texts, more, stage, "more_sets")), "found")
    if not found.isEmpty():
        labels = components(edges.unionByName(found), stage)

    own = sizes.join(labels.withColumnRenamed("id", "rid"), "rid", "left").select("rid", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "rid").alias("_comp"))
    named = docs.select("_key", "_rid").join(own.distinct(), F.col("_rid") == F.col("rid"))
    least = named.groupBy("_comp").agg(F.min("_key").alias("component_id"))
    return named.join(least, "_comp").select("_key", "n_shingles", "component_id", "_rid", "_comp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of every component, with all columns; of rows repeated whole one stays."""
    rows = docs.select(whole_row(docs).alias("_row"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    keyed, unique = row_keys(rows, "_key", "_text")
    found = _similarity_components(keyed.select("_rid", "_key", "_text"), unique)
    first = found.filter("_rid = _comp").select(F.col("_rid").alias("_keep")).distinct()
    kept = keyed.join(first, F.col("_rid") == F.col("_keep"), "left_semi")
    return (kept if unique else kept.dropDuplicates(["_rid"])).select("_row.*")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
