"""Token ids of whole texts, with the tokenizers' own results kept for each piece of text.

Both vocabularies split a text by a pattern and encode each piece alone, so a piece's ids
are computed once by the library and then looked up. Texts with characters outside a
plain range, where the library's normalisation could matter, go to the library whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_spans, keyed_schema, row_chunks, text_buffers

#: ASCII and Latin letters that are composed already and whose lower case is one to one.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ſ]*+")
_KEPT = 400_000  # pieces


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = np.asarray(self.encode(piece), "<u2").tobytes()
        if len(self) < _KEPT:
            self[piece] = out
        return out


class PieceTokenizer:
    """``ids(text)``: the token ids as little-endian 16-bit numbers, equal to the library's."""

    def __init__(self, whole, split: str, lower: bool, special: str, library=None):
        self.library = library
        self.whole, self.lower, self.special = whole, lower, special
        self.split, self.pieces = regex.compile(split), _Pieces(whole)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) is None or self.special in text:
            return np.asarray(self.whole(text), "<u2").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text.lower() if self.lower else text)))


def word_bpe(path: str) -> PieceTokenizer:
    """A tokenizers file that lower-cases, drops white space and encodes letter runs, digits and marks apart."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return PieceTokenizer(lambda x: t.encode(x, add_special_tokens=False).ids, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", True, "<|", t)


def byte_bpe(path: str, pattern: str) -> PieceTokenizer:
    """A tiktoken file of ranks, lossless on bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return PieceTokenizer(e.encode_ordinary, pattern, False, "\x00")


class WordTable:
    """The word tokenizer over many texts at once: pieces are found and looked up as arrays.

    Texts of ASCII and the Latin-1 letters go this way; the others one by one. Ids of pieces
    are kept by the pieces' 64-bit hashes across tasks of a worker.
    """

    KEPT = 2_000_000  # pieces, about 60 MB

    def __init__(self, tokenizer: PieceTokenizer, model):
        self.tokenizer, self.model = tokenizer, model
        bytes_ = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in bytes_]
        self.letters = {b: chr(b) for b in bytes_} | {b: chr(256 + k) for k, b in enumerate(rest)}  # the byte-level alphabet
        self.kind = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 mark
        self.kind[[0x20, 9, 10, 13]] = 0
        self.kind[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
        self.kind[48:58] = 2
        self.odd = np.zeros(256, bool)
        self.odd[[*range(0, 9), 11, 12, *range(14, 32), 127, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def encode(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece]))]

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = [self.encode(p) for p in pieces]
        sizes = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint16)])
        into = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = np.insert(self.keys, into, hashes), np.insert(self.at, into, at), np.insert(self.size, into, sizes)

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that the arrays can handle."""
        bad = self.odd[data]
        lead, cont = data == 0xC3, (data >= 0x80) & (data < 0xC0)
        after = np.zeros_like(lead)
        after[1:] = lead[:-1]
        bad |= cont & ((data == 0x97) | (data == 0xB7))  # the two signs among the letters
        bad |= cont != after
        special = (data[:-1] == 60) & (data[1:] == 124)  # "<|" may begin a special token
        bad[:-1] |= special
        sums = np.concatenate([[0], np.cumsum(bad)])
        return sums[offsets[1:]] == sums[offsets[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end``, and the rows' bounds among them."""
        rows = len(offsets) - 1
        if not len(data):
            return np.full(rows, end, np.uint16), np.arange(rows + 1)
        ok = self.plain(data, offsets)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        accented = np.zeros(len(data), bool)
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        low[accented] += 32
        kind = self.kind[data]
        if not ok.all():
            kind[np.repeat(~ok, np.diff(offsets))] = 0
        before = np.zeros_like(kind)
        before[1:] = kind[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = 0
        first = (kind != 0) & ((kind != before) | (kind == 2))
        # 's 't 'm 'd 're 've 'll, where the mark begins a piece
        quote = np.flatnonzero((data == 39) & first)
        if len(quote):
            limit = offsets[np.searchsorted(offsets, quote, "right")]
            pad = np.concatenate([low, np.zeros(2, np.uint8)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [115, 116, 109, 100]) & (quote + 1 < limit)
            two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (quote + 2 < limit)
            size = np.where(one, 2, np.where(two, 3, 0))
            hit = size > 0
            first[quote[hit] + 1] = False
            nxt = quote[hit] + size[hit]
            nxt = nxt[nxt < limit[hit]]
            first[nxt[kind[nxt] != 0]] = True
        starts = np.flatnonzero(first)
        ends = np.concatenate([starts[1:], [len(data)]])
        # a piece ends at white space, at its row's end or where the next begins
        blank = np.flatnonzero(kind == 0)
        k = np.searchsorted(blank, starts)
        ends = np.minimum(ends, np.where(k < len(blank), blank[np.minimum(k, max(0, len(blank) - 1))] if len(blank) else len(data), len(data)))
        ends = np.minimum(ends, offsets[np.searchsorted(offsets, starts, "right")]) if len(starts) else ends
        hashes = hash_spans(low, starts, ends)
        known, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, known)
        new = (at >= len(self.keys)) | (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] != known) if len(self.keys) else np.ones(len(known), bool)
        if new.any():
            if len(self.keys) > self.KEPT:
                self.clear()
                new = np.ones(len(known), bool)
            raw = low.tobytes()
            self.learn(known[new], [raw[s:e] for s, e in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, known)
        begin, size = self.at[at][inverse], self.size[at][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        per = total[np.searchsorted(starts, offsets)]
        if ok.all():
            return np.insert(flat, per[1:], end), per + np.arange(rows + 1)
        parts = []
        for r in range(rows):
            x = flat[per[r] : per[r + 1]] if ok[r] else np.frombuffer(self.tokenizer.ids(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")), "<u2")
            parts += [x, np.array([end], np.uint16)]
        sizes = [len(parts[2 * r]) + 1 for r in range(rows)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class _OneByOne:
    """Any other tokenizer, text by text."""

    def __init__(self, tokenizer: PieceTokenizer):
        self.tokenizer = tokenizer

    def ids(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.append(np.frombuffer(self.tokenizer.ids(data[a:b].tobytes().decode("utf-8", "replace")), "<u2"), np.uint16(end)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


_TABLES: dict[str, WordTable | _OneByOne] = {}


def table(name: str) -> WordTable | _OneByOne:
    """The tokenizer ``name`` over arrays of texts, kept by the worker."""
    if name not in _TABLES:
        t = load(name)
        _TABLES[name] = WordTable(t, t.library.model) if t.lower else _OneByOne(t)
    return _TABLES[name]


def load(name: str) -> PieceTokenizer:
    """A tokenizer of the installed vocabulary folder by its file name; a path is used as it is."""
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    return word_bpe(path) if path.endswith(".json") else byte_bpe(path, public_tokenizers.PATTERN)


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 2) -> DataFrame:
    """``row`` (a number of the row), ``key``, ``n`` and ``ids`` (16-bit little-endian) of every whole text, then the id ``end``.

    Null and empty texts have the end id alone. Rows are apart even if they are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(tokenizer)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in row_chunks(offsets):
                ids, bounds = t.ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds), pa.int64()), packed], ["row", "key", "n", "ids"])

    schema = T.StructType([T.StructField("row", T.LongType()), *keyed_schema(docs, key, "n bigint, ids binary").fields])
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
