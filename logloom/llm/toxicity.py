"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, word pairs and pairs with one word between are hashed to 2^20 coordinates. FTRL
keeps a learning rate for each coordinate, and its L1 term leaves most weights at zero, so
the model that goes to the executors is a short list of coordinates and weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_table, hash_spans, held_out, keyed_schema, mix, row_chunks, text_buffers, word_spans

DIMS = 1 << 20
#: Labelled rows of each class that the fit takes at most, by the smallest seeded hash of their key, and bytes of their texts (one text at least).
FIT_ROWS, FIT_BYTES = 6000, 16 << 20
#: Learning rates, and shares of the positive examples that make L1, among which a fifth of the training rows decides.
ALPHAS, SHARES = (0.3, 0.1, 1.0), (0.01, 0.003, 0.03)
#: Words here: letters, digits and all bytes beyond ASCII.
_WORD = byte_table([b for b in range(128) if not chr(b).isalnum()])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all n-grams and skip-grams, and for each the number of its row."""
    starts, ends, firsts = word_spans(data, offsets, _WORD)
    words = hash_spans(LOWER[data], starts, ends)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    ids, rows = [words >> np.uint64(44)], [owner]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(words) > gap:
            same = owner[:-gap] == owner[gap:]
            pairs = mix(words[:-gap] * np.uint64(salt) + words[gap:])[same]
            ids.append(pairs >> np.uint64(44))
            rows.append(owner[:-gap][same])
    return np.concatenate(ids).astype(np.int64), np.concatenate(rows)


def _distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * DIMS + ids)
    return both % DIMS, both // DIMS


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in row_chunks(offsets):
            ids, rows = _distinct(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            cut = np.searchsorted(rows, np.arange(j - i + 1))
            packed = [ids[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i), pa.array(packed, pa.binary())], ["label", "check", "hash", "ids"])


def fit_ftrl(examples: list[tuple[int, np.ndarray]], prior: float, alpha: float = ALPHAS[0], beta: float = 1.0, share: float = SHARES[0], l2: float = 0.1, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and intercept. The intercept starts at the prior's log odds and learns along.

    L1 is ``share`` of the positive examples (0.5 to 20): a coordinate needs about so many to count.
    """
    l1 = min(20.0, max(0.5, share * sum(y for y, _ in examples)))
    z, n = np.zeros(DIMS), np.zeros(DIMS)
    bias, bias_n = float(np.log(prior / (1 - prior))), 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            label, ids = examples[k]
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            grown = ni + g * g
            z[ids] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[ids] = grown
            bias_n += g * g
            bias -= 0.02 * g / np.sqrt(bias_n)
    kept = np.flatnonzero(np.abs(z) > l1)
    z, n = z[kept], n[kept]
    return kept, ((np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32), bias


def margins(model: tuple[np.ndarray, np.ndarray, float], examples: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The model's log odds of the examples, and their labels."""
    dense = np.zeros(DIMS, np.float32)
    dense[model[0]] = model[1]
    return np.array([model[2] + dense[ids].sum(dtype=float) for _, ids in examples]), np.array([y for y, _ in examples])


def calibrate(margins: np.ndarray, labels: np.ndarray, prior: float, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on the margins, classes weighted to the prior; a slight ridge keeps it finite."""
    weight = np.where(labels == 1, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
    x, theta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        grad = x.T @ (weight * (p - labels)) + 1.0 * (theta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def loss(odds: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """Mean log loss, classes weighted to the prior."""
    p = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
    each = -np.log(np.where(labels == 1, p, 1 - p))
    means = [each[labels == k].mean() if (labels == k).any() else 0.0 for k in (0, 1)]
    return float((1 - prior) * means[0] + prior * means[1])


def choose_rates(examples: list[tuple[int, np.ndarray]], check: list[tuple[int, np.ndarray]], prior: float) -> tuple[float, float, float, float]:
    """The learning rate, then the share for L1, whose fit on ``examples`` has the least loss on ``check``; and slope and shift that calibrate its margins there.

    The first rates, and margins as they are, where a class is missing.
    """
    if len({y for y, _ in examples}) < 2 or len({y for y, _ in check}) < 2:
        return ALPHAS[0], SHARES[0], 1.0, 0.0
    tried: dict[tuple[float, float], tuple[float, float, float]] = {}

    def of(alpha: float, share: float) -> float:
        if (alpha, share) not in tried:
            odds, labels = margins(fit_ftrl(examples, prior, alpha, share=share), check)
            slope, shift = calibrate(odds, labels, prior)
            tried[alpha, share] = loss(slope * odds + shift, labels, prior), slope, shift
        return tried[alpha, share][0]

    alpha = min(ALPHAS, key=lambda a: of(a, SHARES[0]))
    share = min(SHARES, key=lambda s: of(alpha, s))
    return alpha, share, *tried[alpha, share][1:]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled rows outside the held-out fifth: at most ``fit_rows`` rows and ``fit_bytes`` of text of each class.

    Rates are chosen and margins calibrated on a fifth of all rows (a remainder of 1) with a
    fit on the others, then all of them are fitted; held-out rows have no part in it. Null labels and keys are left out; of several
    labels for one key the largest counts, of several texts one. Without both classes the
    model is the intercept alone.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k")).agg(F.max((F.col(label) > 0).cast("int")).alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    order = [F.xxhash64(F.lit(seed), "_k"), F.col("_k")]
    chosen = known.filter("_y = 1").orderBy(*order).limit(fit_rows).unionByName(known.filter("_y = 0").orderBy(*order).limit(fit_rows))
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_k")  # 2 * fit_rows keys at most
    rows = rows.groupBy("_k", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), F.octet_length("_t"))).alias("_t"))
    before = F.coalesce(F.sum(F.octet_length("_t")).over(Window.partitionBy("_y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 2 * fit_rows rows at most
    rows = rows.withColumn("_b", before).filter(F.col("_b") < fit_bytes)
    check = F.crc32(F.col("_k").cast("string").cast("binary")) % 5 == 1
    got = rows.select("_y", "_t", check.cast("int").alias("_c"), F.xxhash64("_k").alias("_h")).mapInArrow(_extract, "label int, check int, hash bigint, ids binary").toArrow().combine_chunks()  # one copy of the bounded sample
    label, checked = got["label"].to_numpy(), got["check"].to_numpy()
    if not (label == 1).any() or not (label == 0).any():
        return np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior)))
    data, offsets = text_buffers(got["ids"])
    order = np.lexsort((got["hash"].to_numpy(), label)).tolist()
    part = lambda keep: [(int(label[k]), data[offsets[k] : offsets[k + 1]].view("<i4")) for k in order if keep[k]]
    examples = part(np.ones(len(label), bool))
    alpha, share, slope, shift = choose_rates(part(checked == 0), part(checked == 1), prior)
    kept, weights, bias = fit_ftrl(examples, prior, alpha, share=share)
    return kept, (slope * weights).astype(np.float32), slope * bias + shift


class Scorer:
    """Scores texts with a model's weights spread out."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        kept, weights, self.bias = model
        self.dense = np.zeros(DIMS, np.float32)
        self.dense[kept] = weights

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(texts)
        out = np.full(len(texts), self.bias)
        for i, j in row_chunks(offsets):
            ids, rows = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hit = self.dense[ids] != 0
            ids, rows = _distinct(ids[hit], rows[hit])
            out[i:j] += np.bincount(rows, self.dense[ids], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _shared(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]):
    kept, weights, bias = model
    return docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), weights, bias))  # DIMS entries at most


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every whole text; null and empty texts get the intercept's."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1)))], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, keyed_schema(docs, key, "score double")).withColumnRenamed("key", key)


def reject_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model fitted on ``labels`` scores below 0.5."""
    shared, at = _shared(docs, fit(docs, labels, key, text)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at).cast(pa.string())) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
