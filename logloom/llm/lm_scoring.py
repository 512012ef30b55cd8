"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network, written in numpy, predicts every word from the two words
on either side: their embeddings go through one tanh layer to a softmax over classes and
a softmax over the words of the class, so probabilities are exact and cheap. A document's
score is the sum of its words' conditional log-probabilities.

The network has a number for every word: frequent words have one of their own, all others
share the numbers of GROUPS groups, told by their first and last bytes. So it predicts rare
words from both sides too, and sees them as contexts. A rare word has the probability of
its group times that of the word in the group: by its count in the rest of the corpus,
smoothed by its spelling (a chain over bytes, whose mass in each group is worked out
exactly) with the weight of the group's words that occur once. So what is gathered grows
with the corpus: the counts of all its words are a table. The counts of the most frequent
ones are broadcast, those of the long tail are joined.

Training covers all words of all documents: each task trains a copy of the network on the
words of its own documents, and the copies are averaged by the words that they saw, in
rounds; each word is a target in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Staging, hash_spans, mix, row_chunks, signed, text_buffers, word_spans

CLASSES, PER_CLASS = 80, 64
VOCABULARY = CLASSES * PER_CLASS
#: Numbers of groups of rare words, a square of a power of two; the numbers after them are frequent words.
GROUPS = 1024
_SIDE = 32  # first bytes and last bytes are told apart by so many remainders
EMBED, HIDDEN, SIDE = 12, 32, 2
#: A word in so many is a training target, another one in each round: over all rounds, every word once.
STRIDE = ROUNDS = 2
#: Rare words whose counts are broadcast (12 bytes each), at most; the counts of others are joined.
TABLE = 1 << 20
_BATCH, _LARGE_BATCH = 2048, 16384  # batches grow with the words seen
_ROWS = 2048  # rows of a batch that are worked on at once, so that they stay in a core's cache
_FAR = 60  # exp of numbers nearer to 0 is safe in float32
_PIECE = 4096  # parameters in a row when copies are averaged
_HELD = np.array([LOWER[b] == b and b not in b" \t\n\x0b\x0c\r" for b in range(256)])  # bytes of words
_SHAPES = {"e": (VOCABULARY + 1, EMBED), "w": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "d": (CLASSES,), "u": (CLASSES, HIDDEN, PER_CLASS), "v": (CLASSES, PER_CLASS)}


def initial(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; output biases at the log frequencies of classes and words."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) / np.sqrt(max(1, s[-2] if len(s) > 1 else 1))).astype(np.float32) * 0.3 for k, s in _SHAPES.items()}
    grid = (counts.astype(float) + 0.5).reshape(CLASSES, PER_CLASS)
    p["b"][:] = 0
    p["u"] *= 0.1
    p["c"] *= 0.1
    p["d"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
    p["v"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
    return p


def contexts(ids: np.ndarray, firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words around each place, the number VOCABULARY beyond a document's ends."""
    owner = np.searchsorted(firsts, at, "right") - 1
    out = np.empty((len(at), 2 * SIDE), np.int32)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        near = at + d
        ok = (near >= firsts[owner]) & (near < firsts[owner + 1])
        out[:, k] = np.where(ok, ids[np.clip(near, 0, len(ids) - 1)], VOCABULARY)
    return out


def _tame(x: np.ndarray) -> np.ndarray:
    """x, with rows moved by their maxima where exp could leave float32; no softmax changes by it."""
    if x.size and max(x.max(), -x.min()) > _FAR:
        x -= x.max(1, keepdims=True)
    return x


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)  # BLAS takes a third of the time of sum(1)


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at one place; uses up x."""
    own = _tame(x)[np.arange(len(x)), at]
    return own - np.log(_row_sums(np.exp(x, out=x)))


def _gradient(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's softmax less 1 at one place, in x."""
    np.exp(_tame(x), out=x)
    x /= _row_sums(x)[:, None]
    x[np.arange(len(x)), at] -= 1
    return x


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, list[tuple[int, slice]]]]]:
    """An order of the rows by class, and blocks of it that fit a core's cache, each with the classes' runs in it."""
    cls = (target // PER_CLASS).astype(np.uint8)  # small numbers are sorted by radix
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    blocks, k = [], 0
    for i in range(0, len(cls), _ROWS):
        j, runs = min(i + _ROWS, len(cls)), []
        while bounds[k + 1] <= i:
            k += 1
        for c in range(k, CLASSES):
            if bounds[c] >= j:
                break
            if bounds[c] < bounds[c + 1]:
                runs.append((c, slice(max(bounds[c], i) - i, min(bounds[c + 1], j) - i)))
        blocks.append((slice(i, j), runs))
    return order, blocks


def _with_biases(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of words in classes, each with its biases as the last row."""
    return np.concatenate([p["c"], p["d"][None]]), np.concatenate([p["u"], p["v"][:, None]], 1)


def _hidden(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The hidden layer, and a last column of ones for the biases."""
    h = x @ p["w"]
    h += p["b"]
    out = np.ones((len(h), HIDDEN + 1), h.dtype)
    out[:, :-1] = np.tanh(h, out=h)
    return out


def _inside(h: np.ndarray, words: np.ndarray, runs: list[tuple[int, slice]]) -> np.ndarray:
    """The logits of the words of each row's class; one array, so that all classes' softmaxes are taken at once."""
    out = np.empty((len(h), PER_CLASS), h.dtype)
    for k, rows in runs:
        np.matmul(h[rows], words[k], out=out[rows])
    return out


def log_probabilities(p: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    order, blocks = _by_class(target)
    around, target = around.take(order, axis=0), target[order]
    classes, words = _with_biases(p)
    out = np.empty(len(target), classes.dtype)
    for at, runs in blocks:
        h = _hidden(p, p["e"].take(around[at], axis=0).reshape(-1, 2 * SIDE * EMBED))
        out[order[at]] = _log_share(h @ classes, target[at] // PER_CLASS) + _log_share(_inside(h, words, runs), target[at] % PER_CLASS)
    return out


class Trainer:
    """Adagrad on mini-batches."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.08):
        self.rate, self.seen = rate, 0
        classes, words = _with_biases(p)
        self.arrays = {"e": p["e"].copy(), "w": p["w"].copy(), "b": p["b"].copy(), "classes": classes, "words": words}
        self.g = {k: np.full_like(v, 0.1) for k, v in self.arrays.items()}
        # views of the arrays
        self.p = {k: self.arrays[k] for k in "ewb"} | {"c": classes[:-1], "d": classes[-1], "u": words[:, :-1], "v": words[:, -1]}

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        order, blocks = _by_class(target)
        around, target = around.take(order, axis=0), target[order]
        p, n, words = self.p, len(target), self.arrays["words"]
        grad = {k: np.zeros_like(v) for k, v in self.arrays.items()}
        grad["e"] = np.zeros_like(p["e"], order="F")  # a column stays in the nearest cache while it is added to
        for at, runs in blocks:
            x = p["e"].take(around[at], axis=0).reshape(-1, 2 * SIDE * EMBED)
            h = _hidden(p, x)
            dc = _gradient(h @ self.arrays["classes"], target[at] // PER_CLASS)
            grad["classes"] += h.T @ dc
            dw, dh = _gradient(_inside(h, words, runs), target[at] % PER_CLASS), np.empty((len(h), HIDDEN), h.dtype)
            for k, rows in runs:
                grad["words"][k] += h[rows].T @ dw[rows]
                np.matmul(dw[rows], p["u"][k].T, out=dh[rows])
            dh += dc @ p["c"].T
            h = h[:, :-1]
            dh *= 1 - h * h
            grad["w"] += x.T @ dh
            grad["b"] += np.ones(len(dh), dh.dtype) @ dh
            near, dx = around[at].T.ravel().astype(np.intp), (p["w"] @ dh.T).reshape(2 * SIDE, EMBED, -1)
            for k in range(EMBED):
                np.add.at(grad["e"][:, k], near, dx[:, k].ravel())
        scale = np.float32(1 / np.sqrt(n))
        for k, v in grad.items():
            v *= scale
            self.g[k] += v * v
            self.arrays[k] -= self.rate * v / np.sqrt(self.g[k])
        self.seen += n


def spelling_table(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of the next byte after each byte from counts of pairs; row 256 begins a word, column 256 ends it.

    Rows are smoothed with the frequencies of all bytes that words can hold, so they sum to 1.
    """
    held = np.append(_HELD, True)
    once = np.where(held, pairs.sum(0) + 0.5, 0.0)
    share = np.tile(once / once.sum(), (257, 1))
    share[256, 256] = 0  # no word is empty
    share[256] /= share[256].sum()
    table = (pairs + 16 * share) / (pairs.sum(1, keepdims=True) + 16)
    return np.log(np.maximum(table, 1e-300))


def spelled(table: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The log-probability of each word's bytes. Words share no bytes."""
    if not len(starts):
        return np.zeros(0)
    steps = np.zeros(len(low))
    steps[1:] = table[low[:-1], low[1:]]
    steps[starts] = table[256, low[starts]]
    bounds = np.stack([starts, ends], 1).ravel()
    sums = np.add.reduceat(np.append(steps, 0.0), bounds)[::2]
    return sums + table[low[ends - 1], 256]


def group_mass(table: np.ndarray) -> np.ndarray:
    """The log of the probability that the chain of spellings makes a word of each group; all sum to 1.

    ``passes[f, l]``, the inverse of 1 - step, is how often a word that begins with byte f is
    expected to pass byte l. No pivots are needed, as every row's steps sum to less than 1.
    """
    step, begin, end = np.exp(table[:256, :256]), np.exp(table[256, :256]), np.exp(table[:256, 256])
    left, passes = np.eye(256) - step, np.eye(256)
    for k in range(256):
        scale = left[k, k]
        left[k] /= scale
        passes[k] /= scale
        factor = left[:, k].copy()
        factor[k] = 0
        left -= factor[:, None] * left[k]
        passes -= factor[:, None] * passes[k]
    mass = begin[:, None] * passes * end
    return np.log(mass.reshape(256 // _SIDE, _SIDE, 256 // _SIDE, _SIDE).sum((0, 2)).ravel())


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs of neighbouring bytes in rare words, which lie in a column."""
    pairs = np.zeros(257 * 257, np.int64)
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in row_chunks(offsets):
            low = data[offsets[i] : offsets[j]].astype(np.int64)
            starts, ends, _ = word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(starts):
                continue
            inner = np.zeros(len(low) + 1, np.int8)
            inner[starts + 1] += 1
            inner[ends] -= 1
            at = np.flatnonzero(np.cumsum(inner[:-1]))
            codes = np.concatenate([low[at - 1] * 257 + low[at], 256 * 257 + low[starts], low[ends - 1] * 257 + 256])
            pairs += np.bincount(codes, minlength=len(pairs))
    seen = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(pairs[seen])], ["pair", "n"])


def spelling(numbered: DataFrame) -> np.ndarray:
    counts = numbered.select("other").mapInArrow(_spellings, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.zeros(257 * 257)
    for r in counts.collect():  # at most 257 * 257
        pairs[r["pair"]] = r["n"]
    return spelling_table(pairs.reshape(257, 257))


def codes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: a hash of its bytes, with its group in the place of the lowest ten; words of equal codes count as one."""
    group = (low[starts] % _SIDE).astype(np.uint64) * np.uint64(_SIDE) + low[ends - 1] % _SIDE
    return hash_spans(low, starts, ends) & ~np.uint64(GROUPS - 1) | group


def groups(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(GROUPS - 1)).astype(np.int32)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = word_spans(data, offsets)
    return codes(LOWER[data], starts, ends), firsts


class Numbers:
    """Codes of words to numbers: a frequent word's own, or its group's."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.keys, self.ids = words[order], (order + GROUPS).astype(np.int32)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return groups(words)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, self.ids[at], groups(words)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(kept)), pa.array(n)], ["h", "n"])

    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in row_chunks(offsets, 4 << 20):
            words, _ = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            u, c = np.unique(words, return_counts=True)
            both = np.concatenate([kept, u])
            weights = np.concatenate([n, c])
            kept, inverse = np.unique(both, return_inverse=True)
            n = np.bincount(inverse, weights, len(kept)).astype(np.int64)
            if len(kept) > 1_000_000:
                yield out()
                kept, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(kept):
        yield out()


@dataclass
class Words:
    """What is known of the corpus's words: ``numbers`` and their ``frequency``, counts of the more frequent rare words, and the table of the rest."""

    numbers: Numbers
    frequency: np.ndarray  # by number
    hashes: np.ndarray  # sorted, of rare words that occur ``least`` times or more
    counts: np.ndarray
    least: int
    rest: DataFrame  # (h, n) of rare words that occur less often
    once: np.ndarray  # by group, words that occur once


def vocabulary(docs: DataFrame, text: str = "text", stage: Staging | None = None, most: int = TABLE, own: int = VOCABULARY - GROUPS) -> Words:
    """Counts of all words of all documents; the ``own`` most frequent ones (ties by code) have numbers of their own."""
    stage = stage or Staging(docs.sparkSession, "words")
    counts = stage.write(docs.select(text).mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "h").limit(own).collect()
    by_group = counts.groupBy(F.col("h").bitwiseAND(F.lit(GROUPS - 1)).alias("g")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()  # GROUPS rows
    frequency, once = np.zeros(VOCABULARY), np.zeros(GROUPS)
    for r in by_group:
        frequency[r["g"]], once[r["g"]] = r["n"], r["once"]
    for k, r in enumerate(top):
        frequency[GROUPS + k] = r["n"]
        frequency[r["h"] & (GROUPS - 1)] -= r["n"]
        once[r["h"] & (GROUPS - 1)] -= r["n"] == 1
    # levels of counts, eight for each doubling, so that the driver gets a few hundred rows at any size
    level = F.floor(8 * F.log2(F.col("n").cast("double"))).alias("level")
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy(F.desc("level")).collect()
    least, held = 1 + (levels[0]["high"] if levels else 0), 0
    for r in levels:
        held += r["k"]
        if held > most + len(top):
            break
        least = r["low"]
    known = counts.filter(F.col("n") >= least).toArrow()  # ``most`` rows and those with a number
    words, n = known["h"].to_numpy().view(np.uint64), known["n"].to_numpy()
    inside = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    rare = ~np.isin(words, inside)
    order = np.argsort(words[rare])
    return Words(Numbers(inside), frequency, words[rare][order], n[rare][order], least, counts.filter(F.col("n") < least), np.maximum(once, 1))


def _number(numbers: Numbers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's words as 16-bit numbers, and the rare ones in lower case with a blank after each."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        for i, j in row_chunks(offsets):
            low = LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, firsts = word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = numbers(codes(low, starts, ends))
            at = np.flatnonzero(ids < GROUPS)
            size = ends[at] - starts[at] + 1
            stop = np.cumsum(size)
            index = np.repeat(starts[at] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
            other = np.append(low, np.uint8(32))[np.minimum(index, len(low))]
            other[stop - 1] = 32
            cut = np.concatenate([[0], stop])[np.searchsorted(at, firsts)].astype(np.int32)
            column = lambda b, x: pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(b), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), column((2 * firsts).astype(np.int32), ids.astype("<u2").tobytes()), column(cut, other.tobytes())], ["rid", "key", "ids", "other"])


def number(docs: DataFrame, numbers: Numbers, key: str, text: str, stage: Staging, name: str = "numbered") -> DataFrame:
    """``rid``, ``key``, ``ids`` and ``other`` of every row, written once so that no later pass goes through texts."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # the frequent words
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.BinaryType()), T.StructField("other", T.BinaryType())])
    return stage.write(rows.mapInArrow(lambda batches: _number(shared.value, batches), schema), name, codec="zstd")


def targets(words: np.ndarray, turn: int, stride: int) -> np.ndarray:
    """The places of the words to predict in a round: over ``stride`` rounds, each place once."""
    at = np.arange(len(words), dtype=np.uint64)
    return np.flatnonzero(mix(words.astype(np.uint64) + (at << np.uint64(16))) % np.uint64(stride) == np.uint64(turn % stride))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES]).astype(np.float32)


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def _mean(table: pa.Table) -> pa.Table:
    table = table.sort_by([("seen", "ascending"), ("x", "ascending")])  # sums in a known order
    seen = table["seen"].to_numpy()
    x = np.stack([np.frombuffer(b.as_py(), "<f4") for b in table["x"]]).astype(np.float64)
    mean = (x * seen[:, None]).sum(0) / seen.sum()
    return pa.table({"piece": table["piece"].slice(0, 1), "seen": pa.array([seen.sum()]), "x": pa.array([mean.astype("<f4").tobytes()], pa.binary())})


@dataclass
class Model:
    words: Words
    p: dict[str, np.ndarray]
    table: np.ndarray  # of spellings
    numbered: DataFrame  # the corpus


def train(numbered: DataFrame, p: dict[str, np.ndarray], rounds: int = ROUNDS, stride: int = STRIDE) -> dict[str, np.ndarray]:
    """The weights after all rounds over the rows' ``ids``."""
    for turn in range(rounds):
        shared = numbered.sparkSession.sparkContext.broadcast(p)  # about 1 MB, whatever the corpus

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer, around, target = Trainer(shared.value), [], []

            def flush(least: int) -> None:
                if sum(map(len, target)) < least or not target:
                    return
                a, t = np.concatenate(around), np.concatenate(target)
                order = np.random.default_rng(trainer.seen + turn).permutation(len(t))
                k = 0
                while k < len(t):
                    some = order[k : k + min(max(_BATCH, trainer.seen // 16), _LARGE_BATCH)]
                    trainer.train(a[some], t[some])
                    k += len(some)
                around.clear()
                target.clear()

            for batch in batches:
                data, offsets = text_buffers(batch.column(0))
                for i, j in row_chunks(offsets):
                    ids = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<u2").astype(np.int32)
                    at = targets(ids, turn, stride)
                    if len(at):
                        around.append(contexts(ids, (offsets[i : j + 1] - offsets[i]) // 2, at))
                        target.append(ids[at])
                    flush(4 * _LARGE_BATCH)
            flush(1)
            if trainer.seen:
                x = _flat(trainer.p)
                cuts = range(0, len(x), _PIECE)
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int64()), pa.array([float(trainer.seen)] * len(cuts)), pa.array([x[c : c + _PIECE].tobytes() for c in cuts], pa.binary())], ["piece", "part", "seen", "x"])

        copies = numbered.select("ids").mapInArrow(run, "piece int, part bigint, seen double, x binary")
        # means of up to about 256 copies, then the mean of the means
        few = copies.groupBy("piece", F.floor(F.col("part") / 256).alias("_group")).applyInArrow(_mean, "piece int, seen double, x binary")
        got = few.groupBy("piece").applyInArrow(_mean, "piece int, seen double, x binary").orderBy("piece").collect()
        if got:
            p = _shaped(np.concatenate([np.frombuffer(bytes(r["x"]), "<f4") for r in got]))
    return p


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, stride: int = STRIDE, most: int = TABLE, own: int = VOCABULARY - GROUPS) -> Model:
    """Count the corpus's words, number its texts, train the network and count spellings.

    Null, empty and wordless texts add nothing; rows that repeat a key or a whole row count
    each for itself; an empty table gives the untrained network. Other columns aren't read.
    """
    stage = Staging(docs.sparkSession, "lm")
    words = vocabulary(docs, text, stage, most, own)
    numbered = number(docs, words.numbers, key, text, stage)
    return Model(words, train(numbered, initial(words.frequency), rounds, stride), spelling(numbered), numbered)


def among_others(counts: np.ndarray, own: np.ndarray, novel: np.ndarray) -> np.ndarray:
    """log of (count in the rest of the corpus + exp(novel), the weight of the word's spelling in its group)."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(counts - own, 0).astype(float)), novel)


def _group_sums(of: np.ndarray, row: np.ndarray, rows: int, total: np.ndarray, own: bool) -> np.ndarray:
    """For each row the sum over its rare words of log(weight of the word's group in the rest of the corpus)."""
    both, times = np.unique(row * GROUPS + of, return_counts=True)
    return np.bincount(both // GROUPS, times * np.log(total[both % GROUPS] - times * own), rows)


def score(numbered: DataFrame, model: Model, own: bool = True) -> DataFrame:
    """``key``, ``n_words``, ``log_likelihood`` (summed) and ``mean_log_likelihood`` (0 without words) of numbered rows.

    ``own``: the rows are the corpus itself, so a row's own words don't count for it. Rows
    that repeat a key or a whole row are scored each for itself, and copies count for each
    other; null, empty and wordless texts have 0.
    """
    spark, w = numbered.sparkSession, model.words
    shared = spark.sparkContext.broadcast((model.p, model.table, w.hashes, w.counts, np.log(w.once) - group_mass(model.table), w.frequency[:GROUPS] + w.once))  # TABLE words and the weights
    kind = numbered.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, table, hashes, counts, weight, total = shared.value
        names = ["rid", "key", "n_words", "ll", "h", "k", "novel"]
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            low, bounds = text_buffers(batch.column(3))
            for i, j in row_chunks(offsets):
                n, rows = (np.diff(offsets[i : j + 1]) // 2), j - i
                ids, firsts = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<u2").astype(np.int32), (offsets[i : j + 1] - offsets[i]) // 2
                sums = np.zeros(len(ids) + 1)
                for k in range(0, len(ids), 16384):
                    at = np.arange(k, min(k + 16384, len(ids)))
                    sums[at + 1] = log_probabilities(p, contexts(ids, firsts, at), ids[at])
                sums = np.cumsum(sums)
                ll = sums[firsts[1:]] - sums[firsts[:-1]]
                # rare words: each distinct one of a row, and how often it is there
                part = low[bounds[i] : bounds[j]]
                starts, ends, cut = word_spans(part, bounds[i : j + 1] - bounds[i])
                words, row = codes(part, starts, ends), np.repeat(np.arange(rows), np.diff(cut))
                novel = spelled(table, part, starts, ends) + weight[groups(words)]
                ll -= _group_sums(groups(words), row, rows, total, own)
                order = np.lexsort((words, row))
                words, novel, row = words[order], novel[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])) if len(words) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(words)))
                words, novel, row = words[first], novel[first], row[first]
                place = np.minimum(np.searchsorted(hashes, words), max(0, len(hashes) - 1))
                known = hashes[place] == words if len(hashes) else np.zeros(len(words), bool)
                mine = times if own else 0 * times
                here = times[known] * among_others(counts[place[known]], mine[known], novel[known])
                ll += np.bincount(row[known], here, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(n, pa.int64()), pa.array(ll), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.float64())], names)
                if (~known).any():
                    at = pa.array(row[~known] + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.nulls(len(at), batch.column(1).type), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64()), pa.array(signed(words[~known])), pa.array(times[~known], pa.int64()), pa.array(novel[~known])], names)

    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("key", kind), *T.StructType.fromDDL("n_words bigint, ll double, h bigint, k bigint, novel double").fields])
    out = Staging(spark, "lm").write(numbered.mapInArrow(run, schema), "scores")
    tail = out.filter("h is not null").select("rid", "h", "k", "novel").join(w.rest, "h", "left")
    rest = F.coalesce("n", F.lit(0)) - (F.col("k") if own else F.lit(0))
    novel = F.col("novel")
    each = F.when(rest > 0, F.log(rest.cast("double")) + F.log1p(F.exp(novel - F.log(rest.cast("double"))))).otherwise(novel)
    more = tail.groupBy("rid").agg(F.sum(F.col("k") * each).alias("more"))
    ll = F.col("ll") + F.coalesce("more", F.lit(0.0))
    return out.filter("h is null").join(more, "rid", "left").select("key", "n_words", ll.alias("log_likelihood"), F.coalesce(F.try_divide(ll, F.col("n_words")), F.lit(0.0)).alias("mean_log_likelihood"))


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of other documents than those that the model was fitted on."""
    numbered = number(docs, model.words.numbers, key, text, Staging(docs.sparkSession, "lm"))
    return score(numbered, model, own=False).withColumnRenamed("key", key)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs)
    return score(model.numbered, model).withColumnRenamed("key", "doc_id")
