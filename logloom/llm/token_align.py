"""Which tokens of two tokenizers stand for the same text, and how many documents link them.

Both tokenizers cut a text's bytes; where both have an end at the same byte, a group ends,
and all tokens of a group are linked. Token ids of both are written once. The first pass
aligns every document and counts, for each task, the documents of every pair of ids.
Distinct pairs get a minimal perfect hash, built shard by shard on executors; with it the
counts become dense vectors without keys, which are summed in a tree. The second pass aligns
the documents again and looks counts up by hash, each checked against the pair that the
hash stands for.

Hash, pairs and counts reach the tasks by broadcast, for at most ``RANGE_KEYS`` pairs at a
time (about 13 bytes each); more pairs take several rounds over the written ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staging, keyed_schema, mix, row_chunks, text_buffers
from .tokens import _PLAIN as PLAIN

#: Pairs that one shard of the hash holds on average, and that are broadcast at once.
SHARD_KEYS, RANGE_KEYS = 1 << 18, 1 << 22
#: Bits for each key that a level of the hash has still to place.
_GAMMA = 2
#: Counts in one piece of a dense vector, and vectors that are summed at once.
_VECTOR, _FAN = 1 << 17, 16
#: Links of one group up to which they are listed; a longer group's equal links are counted.
_LISTED = 1 << 14
_IDS = 1 << 18  # bytes of ids that are aligned at once, a longer document alone

# ---------------------------------------------------------------- alignment


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """A byte-level vocabulary file (A) and a sentence-piece one (B), with the bytes of their tokens.

    A's file may have a twin of ranks (the same name ending in .tiktoken): plain texts, of
    composed Latin letters and ASCII, where no table of characters can matter, are then
    encoded with that, three times as fast and with equal ids.

    Neither tokenizer has a token that goes on over a space after a character that isn't
    white space, so texts are cut there and the ids of short pieces are kept.
    """

    KEPT, KEPT_CHARS = 500_000, 40  # about 300 bytes each

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        at = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.a = Tokenizer.from_file(at(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=at(b))
        alphabet, vocabulary = _byte_alphabet(), self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes([alphabet[c] for c in token]) if all(c in alphabet for c in token) else token.encode()
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if max(len(a_bytes), len(b_bytes)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.twin, twin = None, at(a).removesuffix(".json") + ".tiktoken"
        if os.path.exists(twin):
            with open(twin, "rb") as f:
                ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
            if all(a_bytes[i] == x for x, i in ranks.items()):
                self.twin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spelling = [(np.frombuffer(b"".join(x), np.uint8), np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int64)) for x in (a_bytes, b_bytes)]
        self.lengths = [np.diff(offsets) for _, offsets in self.spelling]
        # a space after white space stays within its piece, in either dialect's sense of white space
        cuttable = not any(re.search("[^\u2581]\u2581", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.pieces = re.compile(r" (?:[^ ]+|(?<=[\s\u180e]) )*+" if cuttable else r"(?s:.+)")
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}

    def spell(self, which: int, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes."""
        data, offsets = self.spelling[which]
        sizes = self.lengths[which][ids]
        ends = np.cumsum(sizes)
        return data[np.repeat(offsets[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Ids of A and B, as 16-bit numbers, of texts that begin with a space (B adds that itself); null where they don't give back the bytes."""
        a = [self.twin.encode_ordinary(x) if self.twin and PLAIN.fullmatch(x) else self.a.encode(x, add_special_tokens=False).ids for x in texts]
        b = self.b.encode([x[1:] for x in texts], num_threads=1)
        raw = [x.encode() for x in texts]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)), np.int64)
        same = np.ones(len(texts), bool)
        for k, ids in ((0, a), (1, b)):
            flat, owner = np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(texts)), list(map(len, ids)))
            own = np.zeros(len(texts), np.int64)
            np.add.at(own, owner, self.lengths[k][flat])
            same &= own == sizes
        for k, ids in ((0, a), (1, b)):
            spelt = self.spell(k, np.array([i for x, ok in zip(ids, same, strict=True) if ok for i in x], np.int64))
            at = np.repeat(same, sizes)
            wrong = np.zeros(len(texts), bool)
            wrong[np.repeat(np.arange(len(texts)), sizes)[at][spelt != data[at]]] = True
            same &= ~wrong
        for x, y, ok in zip(a, b, same, strict=True):
            yield (np.array(x, "<u2").tobytes(), np.array(y, "<u2").tobytes()) if ok else None

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of a space and each text, none for null and empty texts and where the bytes differ."""
        cut = [self.pieces.findall(" " + x) if x else [] for x in texts]
        kept = self.kept
        if len(kept) > self.KEPT:
            kept.clear()
        new = list({p for pieces in cut for p in pieces if p not in kept})
        for lo in range(0, len(new), 1 << 14):
            kept.update(zip(new[lo : lo + (1 << 14)], self._encode(new[lo : lo + (1 << 14)]), strict=True))
        out = []
        for x, pieces in zip(texts, cut, strict=True):
            found = [kept[p] for p in pieces]
            if None in found:  # the whole text decides
                out.append(next(self._encode([" " + x])) or (b"", b""))
            else:
                out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        for p in new:
            if len(p) > self.KEPT_CHARS:
                del kept[p]
        return out


@functools.lru_cache(maxsize=2)
def encoders(a: str, b: str) -> Encoders:
    """Kept by the worker."""
    return Encoders(a, b)


@dataclass
class Aligned:
    """Groups and links of some documents: numbers by document, and distinct (document, key) in order with their numbers of links."""

    n_groups: np.ndarray
    n_links: np.ndarray
    doc: np.ndarray
    key: np.ndarray  # A's id in the upper 16 bits
    number: np.ndarray
    group_a: np.ndarray  # the group of each token
    group_b: np.ndarray


def align(a: np.ndarray, bounds_a: np.ndarray, b: np.ndarray, bounds_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Align documents whose tokens lie between bounds and have the same bytes in A and B."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    docs = len(bounds_a) - 1
    total = int(end_a[-1]) if len(end_a) else 0
    in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    in_a[end_a], in_b[end_b] = True, True
    last_a, last_b = in_b[end_a], in_a[end_b]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    first_b = np.cumsum(n_b) - n_b
    closed = np.concatenate([[0], np.cumsum(last_a)])[bounds_a]  # groups before each document
    doc_of = np.repeat(np.arange(docs), np.diff(closed))
    links = n_a * n_b
    listed = links <= _LISTED
    times = np.where(listed, n_b, 0)[group_a]  # each token of A meets all of B in its group
    from_a = np.repeat(np.arange(len(a)), times)
    within = np.arange(len(from_a)) - np.repeat(np.cumsum(times) - times, times)
    key = (a[from_a] << 16) | b[first_b[group_a[from_a]] + within]
    full = (doc_of[group_a[from_a]] << 32) | key
    full, number = np.unique(full, return_counts=True)
    if not listed.all():
        first_a, more, numbers = np.cumsum(n_a) - n_a, [full], [number]
        for g in np.flatnonzero(~listed):
            (x, n_x), (y, n_y) = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True), np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            more.append((doc_of[g] << 32) | ((x[:, None] << 16) | y[None, :]).ravel())
            numbers.append((n_x[:, None] * n_y[None, :]).ravel())
        full, number = summed(np.concatenate(more), np.concatenate(numbers))
    n_links = np.zeros(docs, np.int64)
    np.add.at(n_links, doc_of, links)
    return Aligned(np.diff(closed), n_links, full >> 32, full & 0xFFFFFFFF, number, group_a, group_b)


@functools.lru_cache(maxsize=1)
def _written() -> list[str]:
    """Ids with the mark behind them: a comma, a bar or a semicolon."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(1 << 16)]


def groups_texts(a: np.ndarray, bounds_a: np.ndarray, b: np.ndarray, bounds_b: np.ndarray, x: Aligned) -> Iterator[str]:
    """Each document's groups as ``a1,a2|b1;a3|b2``."""
    groups = int(x.n_groups.sum())
    n_a, n_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    end_a, first_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + first_b[x.group_a]] = a
    line[np.arange(len(b)) + end_a[x.group_b]] = b
    line[end_a + first_b - 1] += 1 << 16  # the last of A and of B in a group
    line[end_a + first_b + n_b - 1] += 2 << 16
    written = _written().__getitem__
    bounds = bounds_a + bounds_b
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield "".join(map(written, line[lo:hi].tolist()))[:-1]


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their numbers."""
    if not len(keys):
        return keys, numbers
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(numbers, first)


# ---------------------------------------------------------------- minimal perfect hash


class PerfectHash:
    """Distinct 32-bit keys to 0 .. n - 1. Each level is a bitmap: a key that has a bit alone is placed there, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, total = levels, [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.n = total

    @staticmethod
    def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            words = -(-_GAMMA * len(keys) // 64)
            bit = cls._bit(keys, len(levels), words)
            alone = np.bincount(bit, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[bit]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1 for some keys that it wasn't built for (any other one gets some place)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, words in enumerate(self.levels):
            if not len(open_):
                break
            bit = self._bit(keys[open_], k, len(words))
            word, place = words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> place) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[k][bit >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        bounds = 8 * (1 + n + np.concatenate([[0], np.cumsum(sizes)]))
        return cls([np.frombuffer(data, "<u8", int(s), int(at)) for s, at in zip(sizes, bounds[:-1], strict=True)])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class Range:
    """The hashes of some consecutive shards, as broadcast: places of keys in one vector."""

    def __init__(self, shards: int, first: int, packed: list[bytes]):
        self.shards, self.first, self.hashes = shards, first, [PerfectHash.unpack(x) for x in packed]
        sizes = [h.n for h in self.hashes]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for keys of other shards."""
        shard, out = shard_of(keys, self.shards) - self.first, np.full(len(keys), -1, np.int64)
        for k, h in enumerate(self.hashes):
            own = np.flatnonzero(shard == k)
            if len(own):
                at = h.index(keys[own])
                out[own] = np.where(at >= 0, at + self.offsets[k], -1)
        return out


# ---------------------------------------------------------------- passes


def token_ids(docs: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """``row``, ``key``, ``a`` and ``b``: ids as little-endian 16-bit numbers, none for texts without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(a, b)
        for batch in batches:
            _, offsets = text_buffers(batch.column(2))
            for i, j in row_chunks(offsets):
                found = e.encode(batch.column(2).slice(i, j - i).to_pylist())
                ids = [pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *ids], ["row", "key", "a", "b"])

    schema = T.StructType([T.StructField("row", T.LongType()), *keyed_schema(docs, key, "a binary, b binary").fields])
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def _aligned(batch: pa.RecordBatch, e: Encoders) -> Iterator[tuple[int, int, Aligned, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Alignments of some rows at a time, with their ids and bounds."""
    (data_a, at_a), (data_b, at_b) = (text_buffers(batch.column(batch.schema.get_field_index(x))) for x in "ab")
    for i, j in row_chunks(at_a + at_b, _IDS):
        x, y = (np.frombuffer(d[at[i] : at[j]].tobytes(), "<u2").astype(np.int64) for d, at in ((data_a, at_a), (data_b, at_b)))
        to_a, to_b = (at_a[i : j + 1] - at_a[i]) // 2, (at_b[i : j + 1] - at_b[i]) // 2
        yield i, j, align(x, to_a, y, to_b, *e.lengths), (x, to_a, y, to_b)


def _document_pairs(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Pass one: ``key`` and ``n``, the number of a task's documents that link the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, keys, numbers, waiting = encoders(a, b), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            for _, _, x, _ in _aligned(batch, e):
                waiting.append(x.key)
                if sum(map(len, waiting)) > 1 << 20:
                    distinct, n = np.unique(np.concatenate(waiting), return_counts=True)
                    keys, numbers = summed(np.concatenate([keys, distinct]), np.concatenate([numbers, n]))
                    waiting = []
        if waiting:
            distinct, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, numbers = summed(np.concatenate([keys, distinct]), np.concatenate([numbers, n]))
        for lo in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)]), pa.array(numbers[lo : lo + (1 << 16)])], ["key", "n"])

    return tokens.select("a", "b").mapInArrow(run, "key bigint, n bigint")


def _hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """``shard``, ``n``, its packed hash and its keys in the hash's order."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(np.asarray(batch.column(0)), shards)), batch.column(0)], ["shard", "key"])

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy().astype(np.uint32)
        h = PerfectHash.build(keys)
        ordered = np.empty(len(keys), "<u4")
        ordered[h.index(keys)] = keys
        return pa.table({"shard": group.column("shard").slice(0, 1), "n": [len(keys)], "hash": [h.pack()], "keys": [ordered.tobytes()]})

    # one shard is SHARD_KEYS distinct keys, about: its size doesn't grow with the corpus
    return pairs.select("key").distinct().mapInArrow(number, "shard bigint, key bigint").groupBy("shard").applyInArrow(build, "shard bigint, n bigint, hash binary, keys binary")


def _tree_sum(pairs: DataFrame, part: Range, spread) -> DataFrame:
    """Counts of the pairs of a range as pieces of one dense vector: each task's vector, summed ``_FAN`` at a time."""
    size = int(part.offsets[-1])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, out = spread.value, np.zeros(size, np.int64)
        for batch in batches:
            at = r.index(np.asarray(batch.column(0)).astype(np.uint32))
            np.add.at(out, at[at >= 0], np.asarray(batch.column(1))[at >= 0])
        me = TaskContext.get().partitionId()
        for k in range(0, size, _VECTOR):
            v = out[k : k + _VECTOR]
            if v.any():
                yield pa.RecordBatch.from_arrays([pa.array([me], pa.int64()), pa.array([k // _VECTOR], pa.int64()), pa.array([v.astype("<i8").tobytes()], pa.binary())], ["part", "piece", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in group.column("v"))
        return pa.table({"part": [group.column("part")[0].as_py() // _FAN], "piece": group.column("piece").slice(0, 1), "v": [total.tobytes()]}, schema=pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("v", pa.binary())]))

    schema = "part bigint, piece bigint, v binary"
    out, parts = pairs.mapInArrow(dense, schema), pairs.rdd.getNumPartitions()
    while True:
        out = out.groupBy("piece", F.floor(F.col("part") / _FAN).alias("up")).applyInArrow(add, schema)
        parts = -(-parts // _FAN)
        if parts <= 1:
            return out


class _Table:
    """What the second pass looks up: a range's hash, its keys, their counts, and the highest count of every A id."""

    def __init__(self, part: Range, keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.part, self.keys, self.counts, self.best = part, keys, counts, best

    def sums(self, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """n_best and count_sum of each document's links in this range."""
        at = self.part.index(x.key.astype(np.uint32))
        mine = np.flatnonzero(at >= 0)
        mine = mine[self.keys[at[mine]] == x.key[mine]]  # the hash gives any key some place
        count, number, doc = self.counts[at[mine]], x.number[mine], x.doc[mine]
        best, total = np.zeros((2, len(x.n_groups)), np.int64)
        np.add.at(best, doc, np.where(count == self.best[x.key[mine] >> 16], number, 0))
        np.add.at(total, doc, number * count)
        return best, total


def _ranges(sizes: dict[int, int], shards: int, most: int) -> list[list[int]]:
    """Consecutive shards of at most ``most`` keys together, or one shard."""
    out: list[list[int]] = [[]]
    for s in range(shards):
        if out[-1] and sum(sizes.get(x, 0) for x in out[-1]) + sizes.get(s, 0) > most:
            out.append([])
        out[-1].append(s)
    return out


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", range_keys: int = RANGE_KEYS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of every row.

    A text is encoded after one space. Null and empty texts, and texts whose tokens don't
    give back their bytes, have no tokens: zeros and an empty digest. Every row is a document
    of its own, also where keys or whole rows repeat or the key is null. Of several pairs with
    an A id's highest count all are best. Other columns aren't read. An empty table gives no
    rows. At most ``range_keys`` pairs (or one shard) are broadcast at once.
    """
    spark = docs.sparkSession
    stage, sc = Staging(spark, "align"), spark.sparkContext
    tokens = stage.write(token_ids(docs, key, text, a, b), "tokens", codec="zstd")
    pairs = stage.write(_document_pairs(tokens, a, b), "pairs", codec="zstd")
    shards = max(1, -(-pairs.select(F.count_distinct("key")).first()[0] // shard_keys))
    hashes = stage.write(_hashes(pairs, shards), "hashes")
    ranges = _ranges(dict(hashes.select("shard", "n").collect()), shards, range_keys)  # a row for each SHARD_KEYS pairs

    def range_of(own: list[int]) -> tuple[Range, np.ndarray]:
        rows = {r["shard"]: r for r in hashes.filter(F.col("shard").between(own[0], own[-1])).collect()}
        empty = PerfectHash([]).pack()
        part = Range(shards, own[0], [bytes(rows[s]["hash"]) if s in rows else empty for s in own])
        return part, np.frombuffer(b"".join(bytes(rows[s]["keys"]) for s in own if s in rows), "<u4")

    def counts_of(vector: DataFrame, n: int) -> np.ndarray:
        counts = np.zeros(n, np.int64)
        for r in vector.select("piece", "v").collect():
            counts[r["piece"] * _VECTOR : r["piece"] * _VECTOR + len(r["v"]) // 8] = np.frombuffer(r["v"], "<i8")
        return counts

    best, vectors = np.zeros(1 << 16, np.int64), []
    for k, own in enumerate(ranges):
        part, keys = range_of(own)
        vectors.append(stage.write(_tree_sum(pairs, part, sc.broadcast(part)), f"counts{k}"))
        np.maximum.at(best, keys >> 16, counts_of(vectors[-1], len(keys)))

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def look_up(k: int, with_digest: bool) -> DataFrame:
        """Pass two for one range of pairs."""
        part, keys = range_of(ranges[k])
        spread = sc.broadcast(_Table(part, keys, counts_of(vectors[k], len(keys)), best))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e, table = encoders(a, b), spread.value
            for batch in batches:
                for i, j, x, (ids_a, to_a, ids_b, to_b) in _aligned(batch, e):
                    numbers = [pa.array(v) for v in (np.diff(to_a), np.diff(to_b), x.n_groups, x.n_links, *table.sums(x))]
                    texts = groups_texts(ids_a, to_a, ids_b, to_b, x) if with_digest else [""] * (j - i)
                    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in texts]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *numbers, pa.array(digests, pa.string())], ["row", "key", *names, "groups_sha256"])

        return tokens.select("row", "key", "a", "b").mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), *keyed_schema(docs, key, ", ".join(f"{x} bigint" for x in names) + ", groups_sha256 string").fields]))

    out = look_up(0, True)
    if len(ranges) > 1:  # the other ranges' sums are added by row
        rest = [stage.write(look_up(k, False).select("row", "n_best", "count_sum"), f"sums{k}") for k in range(1, len(ranges))]
        more = functools.reduce(DataFrame.unionByName, rest).groupBy("row").agg(F.sum("n_best").alias("_b"), F.sum("count_sum").alias("_s"))
        out = out.join(more, "row").withColumns({"n_best": F.col("n_best") + F.col("_b"), "count_sum": F.col("count_sum") + F.col("_s")})
    return out.select(F.col("key").alias(key), *names, "groups_sha256")


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
