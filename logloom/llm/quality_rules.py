"""Quality rules: a decision list learned by sequential covering, emitted as a Spark CASE expression.

Statistics of a text are built-in functions over its words and lines. Covering grows
conjunctions of thresholds on one part of the labelled rows, prunes them on the other,
takes away what a rule covers and goes on while rules are precise enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, whole_row

#: Labelled rows that the covering takes at most, by the smallest seeded hash of their key.
FIT_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: What a rule may test; ratios are to word characters or words.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "lines_per_word", "distinct_ratio")
_WINDOW = 5


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with a struct ``stats``, which takes the place of a column of that name.

    Null and empty texts have zeros throughout. Rows don't look at each other, so ties,
    repeated rows and null keys make no difference; an empty table stays empty.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.translate(F.col("_t"), BLANKS, "")
    count = lambda chars: (F.char_length("_b") - F.char_length(F.translate("_b", chars, ""))).cast("long")
    words = F.array_remove(F.split(F.translate("_t", BLANKS, " " * len(BLANKS)), " "), "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    first = docs.select(whole_row(docs).alias("_row"), t.alias("_t")).select("_row", words.alias("_w"), lines.alias("_l"), bare.alias("_b"))
    first = first.withColumn("_d", F.size(F.array_distinct("_w")))
    # each word is hashed once; without an equal pair of words no window can repeat
    first = first.withColumn("_x", F.when((F.size("_w") > _WINDOW) & (F.col("_d") < F.size("_w")), F.transform("_w", lambda w: F.xxhash64(w))))
    # one hash for each window of words; a text without equal ones is settled by their distinct count
    at = lambda i, k: F.get(F.col("_x"), i + k)
    hashes = F.when(F.col("_x").isNotNull(), F.transform(F.sequence(F.lit(0), F.size("_x") - _WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(_WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumn("_h", hashes)
    pairs = F.array_sort(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(F.lit(None)))
    near = lambda i, d: F.get(F.col("_s"), i + d)["h"]
    equal = F.filter(F.col("_s"), lambda x, i: F.coalesce(near(i, -1) == x["h"], F.lit(False)) | F.coalesce(near(i, 1) == x["h"], F.lit(False)))
    fourth = third.withColumn("_r", F.array_sort(F.transform(equal, lambda x: x["i"])))
    # windows start at increasing places: each adds as many words as lie beyond the one before
    covered = F.aggregate(F.transform(F.col("_r"), lambda x, i: F.when(i == 0, F.lit(_WINDOW)).otherwise(F.least(F.lit(_WINDOW), x - F.get(F.col("_r"), i - 1)))), F.lit(0), lambda a, x: a + x)
    n = F.size("_w").cast("long")
    stats = F.struct(
        n.alias("n_words"),
        F.char_length("_b").cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("0123456789").alias("n_digits"),
        count(".,;:!?\"'()[]{}").alias("n_marks"),
        F.col("_d").cast("long").alias("n_distinct"),
    )
    return fourth.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "stats"], stats.alias("stats"))


def feature_columns(stats: str = "stats") -> dict[str, Column]:
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    by = lambda a, b: F.coalesce(F.try_divide(s(a), s(b)), F.lit(0.0))
    return {
        "n_words": s("n_words"),
        "mean_word": by("word_chars", "n_words"),
        "symbol_ratio": by("n_symbols", "word_chars"),
        "dup_line_ratio": by("n_dup_lines", "n_lines"),
        "repeat_ratio": by("n_repeat_words", "n_words"),
        "upper_ratio": by("n_upper", "word_chars"),
        "digit_ratio": by("n_digits", "word_chars"),
        "mark_ratio": by("n_marks", "word_chars"),
        "lines_per_word": by("n_lines", "n_words"),
        "distinct_ratio": by("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    ok = np.ones(n, bool)
    for c in rule:
        ok &= (x[c.feature] > c.threshold) == c.above
    return ok


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 16, depth: int = 3, precision: float = 0.9, least: int = 5, cuts: int = 48, seed: int = 3) -> list[Rule]:
    """Ordered rules that reject; what none rejects is kept."""
    n = len(bad)
    grow = np.random.default_rng(seed).random(n) < 2 / 3
    left, rules = np.ones(n, bool), []
    while len(rules) < most:
        part = left & grow
        covered, rule = part.copy(), ()
        while len(rule) < depth:
            p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
            if p0 < least or n0 == 0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None, None)
            for f, values in x.items():
                order = np.sort(values[covered])
                places = np.unique(np.linspace(0, len(order) - 1, cuts).astype(int))
                for t in np.unique(np.concatenate([(order[places][:-1] + order[places][1:]) / 2, order[places]])):
                    above = values > t
                    for up in (True, False):
                        now = covered & (above if up else ~above)
                        p = (now & bad).sum()
                        if p < least:
                            continue
                        gain = p * (np.log2(p / now.sum()) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(f, up, float(t)), now)
            if best[1] is None:
                break
            rule, covered = (*rule, best[1]), best[2]
        if not rule:
            break

        def worth(r: Rule, within: np.ndarray) -> float:
            hit = _holds(r, x, n) & within
            return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

        check = left & ~grow
        while len(rule) > 1 and worth(rule[:-1], check) >= worth(rule, check):
            rule = rule[:-1]
        hit = _holds(rule, x, n) & left
        if hit.sum() < least or (hit & bad).sum() / hit.sum() < precision or worth(rule, check) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, seed: int = 13) -> list[Rule]:
    """Learn rules from at most ``fit_rows`` labelled rows outside the held-out fifth. Null labels and keys are left out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k")).agg(F.max((F.col(label) > 0).cast("int")).alias("_y"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "_k"), "_k").limit(fit_rows)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k")  # fit_rows keys at most
    got = statistics(rows, "_t").select("_k", "_y", *[c.alias(f) for f, c in feature_columns().items()]).collect()
    got.sort(key=lambda r: tuple(r))
    if not got:
        return []
    return learn({f: np.array([r[f] for r in got]) for f in FEATURES}, np.array([r["_y"] == 0 for r in got]))


def rule_column(rules: list[Rule], stats: str = "stats") -> Column:
    """The number of the first rule that holds, null if none does."""
    columns, out = feature_columns(stats), F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        test = F.lit(True)
        for c in rules[k]:
            test = test & (columns[c.feature] > c.threshold if c.above else columns[c.feature] <= c.threshold)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = fit(docs, labels)
    out = statistics(docs.select("doc_id", "text")).withColumn("rule", rule_column(rules))
    s = lambda name: F.col(f"stats.{name}")
    out = out.withColumn("base_failed", (s("n_words") < 10) | (100 * s("n_repeat_words") > 20 * s("n_words")))
    return out.select("doc_id", *[s(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
