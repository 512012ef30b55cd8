"""Suffix-array dedup: blockwise suffix sorting with a difference cover.

A byte is removed if a string of ``width`` bytes that covers it also starts earlier, in an
earlier document or further left in the same one.

1. Every string has one anchor: its 24-byte part with the least hash, the leftmost of
   equal ones. Equal strings have equal anchors at equal places, so suffixes fall into
   buckets by anchor, and a string that repeats does so inside one bucket. The strings
   of one anchor at one place are neighbours: a stretch. Stretches that are equal
   throughout are one: two 64-bit hashes, of the anchor and of the stretch, tell (inside
   the task that reads them, then over all), and all but the first are repeats.
2. Buckets that still have different stretches are sorted, a block of buckets at a time:
   suffixes by their first 16 bytes; ties by the precomputed ranks of sample suffixes, those
   at places that are {0, 1, 2, 5, 8} modulo 16. For any two places a common shift below 16
   leads to two samples, so a tie of any length takes one comparison. Neighbours in suffix
   order that agree on ``width`` bytes are one class; all but its first are repeats.
3. A bucket of too many stretches for a task is split by longer keys: its strings are taken
   16 neighbouring distances from the anchor at a time, and the 85 bytes that all strings of
   such distances have in common name the new bucket; after that by whole strings. Equal
   strings stay together at every step, and the new buckets go through 1 and 2 again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, _powers, _prefix, hash_windows, keyed_schema, mix, row_chunks, signed, text_buffers, whole_row, with_row_key

WIDTH, ANCHOR = 100, 24
#: Different stretches of a bucket up to which it is sorted whole: about 1 MB of text.
BUCKET_STRETCHES = 1 << 13
#: Distances from the anchor that the strings of a split bucket have, in order of the splits.
STEPS = (16, 1)
#: Bytes of text that one block of buckets holds, about; bounds a task's memory.
BLOCK_BYTES = 2 << 20
#: Text bytes whose equal stretches a task settles by itself before anything is shuffled.
_LOCAL_BYTES = 32 << 20
_PERIOD, _COVER = 16, (0, 1, 2, 5, 8)
_PART = (1 << 20) - 1  # places that fit beside 44 bits of hash


# ---------------------------------------------------------------- anchors


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in two passes over blocks of that size."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def stretches(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, row, first start, number of starts) for all strings of the rows.

    ``data`` has at most 2^20 bytes.
    """
    n = len(data)
    starts_ok = np.zeros(max(0, n - width + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            starts_ok[a : b - width + 1] = True
    none = np.zeros(0, np.int64)
    if not starts_ok.any():
        return none, none, none, none, none
    grams = hash_windows(data, anchor)
    packed = ((grams >> np.uint64(20)) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(packed, width - anchor + 1) & np.uint64(_PART)).astype(np.int64)
    usable = np.flatnonzero(starts_ok)
    chosen = at[usable]
    new = np.ones(len(usable), bool)
    new[1:] = (np.diff(chosen) != 0) | (np.diff(usable) != 1)
    begin = np.flatnonzero(new)
    first = usable[begin]
    count = np.diff(np.append(begin, len(usable)))
    sums = _prefix(data)
    last = first + count + width - 1
    whole = mix((sums[last] - sums[first]) * _powers()[1][first] + count.astype(np.uint64))
    row = np.searchsorted(offsets, first, "right") - 1
    return signed(grams[chosen[begin]]), signed(whole), row, first - offsets[row], count


def _pieces(offsets: np.ndarray, most: int = 1 << 20, width: int = WIDTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(row from, row to, byte from, byte to, place of byte from in its row): rows together up to ``most`` bytes, longer ones in overlapping parts."""
    for i, j in row_chunks(offsets, most):
        if offsets[j] - offsets[i] <= most:
            yield i, j, int(offsets[i]), int(offsets[j]), 0
            continue
        for a in range(int(offsets[i]), int(offsets[j]), most - width + 1):
            b = min(a + most, int(offsets[j]))
            yield i, j, a, b, a - int(offsets[i])
            if b == int(offsets[j]):
                break


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All stretches, those equal to an earlier one of this task's text as settled (``g`` null)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        g, s, rid, first, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((first, rid, s, g))
        g, s, rid, first, count = (x[order] for x in (g, s, rid, first, count))
        same = np.zeros(len(g), bool)
        same[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (count[1:] == count[:-1])
        # repeated rows have one number: their copies of a place are that place
        twin = np.zeros(len(g), bool)
        twin[1:] = same[1:] & (rid[1:] == rid[:-1]) & (first[1:] == first[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
        settled = same & ~((rid == rid[lead]) & (first == first[lead]))
        keep = ~twin
        g, s, rid, first, count, settled = (x[keep] for x in (g, s, rid, first, count, settled))
        for a in range(0, len(g), 50_000):
            b = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(g[b], mask=settled[b]), pa.array(s[b], mask=settled[b]), pa.array(rid[b]), pa.array(first[b]), pa.array(count[b].astype(np.int32))], ["g", "s", "rid", "first", "n"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        data, offsets = text_buffers(batch.column(1))
        for i, j, a, b, place in _pieces(offsets):
            bounds = np.clip(offsets[i : j + 1], a, b) - a
            g, s, row, first, count = stretches(data[a:b], bounds)
            if len(g):
                held.append((g, s, keys[i + row], first + place, count))
            size += b - a
            if size >= _LOCAL_BYTES and held:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


# ---------------------------------------------------------------- sorting a block


def _words64(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 by the keys, the first one foremost; equal keys share a rank."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        step[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def _shifts() -> np.ndarray:
    """For residues i and j, a shift that leads both into the cover."""
    out = np.zeros((_PERIOD, _PERIOD), np.int64)
    for i in range(_PERIOD):
        for j in range(_PERIOD):
            out[i, j] = next(k for k in range(_PERIOD) if (i + k) % _PERIOD in _COVER and (j + k) % _PERIOD in _COVER)
    return out


_SHIFTS = _shifts()


def sample_ranks(text: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the cover's suffixes by their first ``width`` bytes or more, by doubling; -1 elsewhere."""
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % _PERIOD, _COVER))
    index = np.full(n, -1, np.int64)
    index[at] = np.arange(len(at))
    second = np.where(at + 8 < n, words[np.minimum(at + 8, n - 1)], 0)
    rank, depth = _dense(words[at], second), _PERIOD
    while depth < width:
        # the depth is a multiple of the period: the place so far on is a sample as well
        there = at + depth
        rank = _dense(rank, np.where(there < n, rank[index[np.minimum(there, n - 1)]], -1))
        depth *= 2
    out = np.full(n + _PERIOD, -1, np.int64)
    out[at] = rank
    return out


def sort_suffixes(text: np.ndarray, suffixes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The suffixes in the order of their first ``width`` bytes or more."""
    words = _words64(text)
    ranks = sample_ranks(text, words, width)
    n = len(text)
    second = np.where(suffixes + 8 < n, words[np.minimum(suffixes + 8, n - 1)], 0)
    group = _dense(words[suffixes], second)
    order = np.argsort(group, kind="stable")
    place, group = suffixes[order], group[order]
    lo = np.arange(len(place))
    live = np.zeros(len(place), bool)
    live[1:] = group[1:] == group[:-1]
    live[:-1] |= live[1:]
    lo = lo[live]
    # three-way quicksort of all ties at once: compare with the middle one, split, go on with both sides
    while len(lo):
        own, tie = place[lo], group[lo]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(tie)) + 1])
        size = np.diff(np.append(begin, len(lo)))
        pivot = np.repeat(own[begin + size // 2], size)
        k = _SHIFTS[own % _PERIOD, pivot % _PERIOD]
        side = np.sign(ranks[own + k] - ranks[pivot + k]) + 1
        run = np.repeat(np.arange(len(begin)), size)
        turn = np.argsort(run * 3 + side, kind="stable")
        place[lo] = own[turn]
        side, run = side[turn], run[turn]
        part = run * 3 + side
        alone = np.ones(len(part), bool)
        alone[1:] &= part[1:] != part[:-1]
        alone[:-1] &= part[:-1] != part[1:]
        go = (side != 1) & ~alone
        group = group.copy()
        group[lo] = part
        lo = lo[go]
    return place


def _agree(text: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    same = np.ones(len(a), bool)
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        live = np.flatnonzero(same)
        same[live] = words[a[live] + k] == words[b[live] + k]
    return same


def repeats_in_block(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, rid: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (rid, first start, number of starts) of strings that also start earlier within the block.

    ``begins``: where each stretch lies in ``text``; ``counts``: its strings; ``rid``, ``first``: where they are from.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, doc, start = begins[owner] + within, rid[owner], first[owner] + within
    back = np.zeros(len(text), np.int64)
    back[at] = np.arange(len(at))
    order = sort_suffixes(text, at, width)
    words = _words64(text)
    new = np.ones(len(order), bool)
    new[1:] = ~_agree(text, words, order[:-1], order[1:], width)
    who = back[order]
    cls = np.cumsum(new) - 1
    rank = np.empty(len(at), np.int64)
    rank[np.lexsort((start, doc))] = np.arange(len(at))
    best = np.minimum.reduceat(rank[who], np.flatnonzero(new))
    winner = np.lexsort((start, doc))[best][cls]
    repeat = np.zeros(len(at), bool)
    repeat[who] = (doc[winner] != doc[who]) | (start[winner] != start[who])
    hit = np.flatnonzero(repeat)
    if not len(hit):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    cut = np.ones(len(hit), bool)
    cut[1:] = (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])
    begin = np.flatnonzero(cut)
    return doc[hit[begin]], start[hit[begin]], np.diff(np.append(begin, len(hit)))


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; whole buckets are gathered to blocks."""
    held: list[pa.Table] = []
    size = 0

    def out(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        text, offsets = text_buffers(table["context"].combine_chunks() if table["context"].num_chunks != 1 else table["context"].chunk(0))
        doc, first, n = repeats_in_block(text, offsets[:-1], table["n"].to_numpy().astype(np.int64), table["rid"].to_numpy(), table["first"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(n.astype(np.int32))], ["rid", "first", "n"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.column(4).nbytes
        if size >= BLOCK_BYTES:
            table = pa.concat_tables(held)
            g = table["g"].to_numpy()
            changes = np.flatnonzero(np.diff(g) != 0)
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield out(table.slice(0, cut))
                held = [table.slice(cut)]
                size = held[0]["context"].nbytes
    if held and sum(t.num_rows for t in held):
        yield out(pa.concat_tables(held))


# ---------------------------------------------------------------- the operator


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the stretches asked for, one row each."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        data, offsets = text_buffers(batch.column(1))
        wanted = batch.column(2)
        flat = wanted.flatten()
        per = np.diff(wanted.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), per)
        first, n = flat.field("first").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
        begin = offsets[row] + first
        size = n + WIDTH - 1
        for a in range(0, len(row), 20_000):
            b = slice(a, a + 20_000)
            context = _slices(data, begin[b], size[b])
            yield pa.RecordBatch.from_arrays([flat.field("g").slice(a, len(context)), pa.array(keys[row[b]]), pa.array(first[b]), pa.array(n[b].astype(np.int32)), context, flat.field("big").slice(a, len(context))], ["g", "rid", "first", "n", "context", "big"])


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[begin : begin + size] for each of them as an Arrow array."""
    ends = np.cumsum(size)
    index = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[index]))])


def narrow(g: np.ndarray, n: np.ndarray, data: np.ndarray, offsets: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """(bucket, hash, stretch, its first string, strings, begin in data) of the narrower stretches of at most 2^20 bytes of stretches.

    Strings of one stretch whose distances from the anchor, whose hash ``g`` is, fall into one
    run of ``step`` are a narrower stretch; for a step of 1 ``g`` may be any bucket. Its bucket is named by the bytes that every string at those distances
    has, whichever of them are there.
    """
    begin = offsets[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    if step > 1:
        grams = hash_windows(data, ANCHOR)
        match = np.flatnonzero(grams == np.repeat(g.view(np.uint64), np.diff(offsets))[: len(grams)])
        anchor = match[np.searchsorted(match, begin + n - 1)]  # the first one that the last string holds
        run = (anchor[owner] - begin[owner] - within) // step
    else:  # every string is alone
        run = within
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(owner)))
    row, first, run = owner[at], within[at], run[at]
    start = begin[row] + first
    common = hash_windows(data, WIDTH - step + 1)[anchor[row] - step * run if step > 1 else start]
    bucket = mix(common ^ mix(g.view(np.uint64)[row] + (run if step > 1 else 0 * run).astype(np.uint64)))
    sums = _prefix(data)
    whole = mix((sums[start + count + WIDTH - 1] - sums[start]) * _powers()[1][start] + count.astype(np.uint64))
    return signed(bucket), signed(whole), row, first, count, start


def _narrower(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, rid, first0, n = (batch.column(k).to_numpy() for k in range(4))
            data, offsets = text_buffers(batch.column(4))
            for i, j in row_chunks(offsets, 1 << 17):
                part = data[offsets[i] : offsets[j]]
                bucket, whole, row, first, count, start = narrow(g[i:j], n[i:j].astype(np.int64), part, offsets[i : j + 1] - offsets[i], step)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(whole), pa.array(rid[i:j][row]), pa.array(first0[i:j][row] + first), pa.array(count.astype(np.int32)), _slices(part, start, count + WIDTH - 1)], ["g", "s", "rid", "first", "n", "context"])

    return run


def _judged(rows: DataFrame, stage: Staging, name: str) -> DataFrame:
    """Whether each stretch (``g``, ``s``, ``rid``, ``first``, ``n``) is equal to an earlier one: ``again``."""
    lead = F.struct("rid", "first")
    equal = Window.partitionBy("g", "s", "n").orderBy("rid", "first")  # a row for each 32 MB of text at most
    return stage.write(rows.withColumn("again", F.first(lead).over(equal) != lead).drop("s"), name)


def _several(judged: DataFrame) -> DataFrame:
    """The first of all equal stretches in buckets that have different ones, with ``big``: too many for one task."""
    first = judged.filter("not again").drop("again")
    kinds = first.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    return first.join(kinds, "g").withColumn("big", F.col("kinds") > BUCKET_STRETCHES).drop("kinds")


def repeated_runs(docs: DataFrame, stage: Staging) -> DataFrame:
    """(rid, first, n): strings of WIDTH bytes starting at first .. first + n - 1 that also start earlier. ``docs``: ``_rid``, ``_text``."""
    run = ["rid", "first", "n"]
    local = stage.write(docs.select("_rid", "_text").mapInArrow(_local, "g bigint, s bigint, rid bigint, first bigint, n int"), "local")
    found = stage.write(local.filter("g is null").select(*run), "local_runs")
    judged = _judged(local.filter("g is not null"), stage, "judged")
    stage.discard("local")
    found = found.unionByName(judged.filter("again").select(*run))

    asked = _several(judged).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("first", "n", "g", "big"))).alias("wanted"))
    # what is asked for grows with the corpus: the same join at any size
    cut = docs.select("_rid", "_text").hint("merge").join(asked.hint("merge"), F.col("_rid") == F.col("rid")).select("_rid", "_text", "wanted")
    cut = stage.write(cut.mapInArrow(_cut_contexts, "g bigint, rid bigint, first bigint, n int, context binary, big boolean"), "contexts", codec="zstd")
    columns = ["g", *run, "context"]
    whole, big = cut.filter("not big").select(columns), cut.filter("big").select(columns)
    for step in STEPS:
        if big.isEmpty():
            break
        narrower = big.mapInArrow(_narrower(step), "g bigint, s bigint, rid bigint, first bigint, n int, context binary")
        narrower = _judged(narrower, stage, f"judged{step}")
        found = found.unionByName(narrower.filter("again").select(*run))
        several = stage.write(_several(narrower), f"several{step}", codec="zstd")  # none is left of whole strings
        whole, big = whole.unionByName(several.filter("not big").select(columns)), several.filter("big").select(columns)
    sorted_ = whole.repartition("g").sortWithinPartitions("g").mapInArrow(_sort_blocks, "rid bigint, first bigint, n int")
    return found.unionByName(sorted_)


def _remove(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, list[bytes]]:
    """Merge each document's runs to removed spans: text sizes, spans and what is left."""
    data, offsets = text_buffers(batch.column(1))
    runs = batch.column(2)
    bounds = np.concatenate([[0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = runs.flatten()
    firsts, counts = flat.field("first").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
    spans, kept = [], []
    for r in range(batch.num_rows):
        text = data[offsets[r] : offsets[r + 1]]
        f, c = firsts[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]
        if not len(f):
            spans.append([])
            kept.append(text.tobytes())
            continue
        order = np.argsort(f, kind="stable")
        begin, end = f[order], np.maximum.accumulate((f + c + WIDTH - 1)[order])
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > end[:-1]
        a, b = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
        mark = np.zeros(len(text) + 1, np.int8)
        mark[a] += 1
        mark[b] -= 1
        kept.append(text[np.cumsum(mark)[:-1] == 0].tobytes())
        spans.append([{"first": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
    return pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), kept


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """``row`` (the other columns), ``n_bytes``, ``spans`` (removed byte runs) and ``kept`` (the bytes left) of every document.

    Texts are UTF-8 bytes, null is empty; texts under 100 bytes stay whole. Null keys
    come first; rows that share a key are ordered by their texts' hashes, and rows
    repeated whole count as one document, each keeping the same bytes. With ``as_text``
    ``kept`` is a string, without the bytes of characters that were cut in two.
    """
    stage = Staging(docs.sparkSession, "suffix")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), whole_row(docs, (text,)).alias("row"))
    keyed = with_row_key(rows, "_key", "_text")
    runs = stage.write(repeated_runs(keyed, stage), "runs")
    by_doc = runs.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    joined = keyed.hint("merge").join(by_doc.hint("merge"), F.col("_rid") == F.col("rid"), "left").select("row", "_text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _remove(batch)
            kept = [x.decode("utf-8", "ignore") for x in out[2]] if as_text else out[2]
            yield pa.RecordBatch.from_arrays([batch.column(0), out[0], out[1], pa.array(kept, pa.string() if as_text else pa.binary())], ["row", "n_bytes", "spans", "kept"])

    kind = "string" if as_text else "binary"
    return joined.mapInArrow(run, keyed_schema(joined, "row", f"n_bytes bigint, spans array<struct<first:bigint,end:bigint>>, kept {kind}", "row"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The documents with repeated strings removed from their texts, and ``chars`` counted anew."""
    out = dedup_substrings(docs, key, text, as_text=True)
    columns = [F.col("kept").alias(text) if c == text else F.char_length("kept").cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["first"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
