"""The corpus operators against brute force on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import itertools
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, decontam, lm_scoring, ngram_join, packing, quality_rules, sharding, suffix_dedup, token_output, toxicity, url_filter
from logloom.llm.common import hash_spans, shingles, word_spans

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, shard int, key string, score double"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(30)
    out = [say(rng.randint(20, 200)) for _ in range(40)]
    out += [base] * 6 + [" ".join(w if rng.random() > 0.01 else "zz" for w in base.split()) for _ in range(25)]
    out += [say(40) + " " + passage + " " + say(40) for _ in range(8)]
    out += [None, "", "   ", "one two", "one two", "a" * 700, "é" * 200 + " ünïcode Ä", say(3000), (say(90) + " ") * 9, "Line one\nLine one\nLine two", "x!! $$ ## " * 20, base.upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "r", 1, "k", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def awkward(spark, texts):
    """Null keys, keys of several texts, whole repeats."""
    rows = [(None, "null key one two three four five six", "en", "s", 1, "r", 1, "k", 0.5), (None, None, None, None, None, None, None, None, None), (1, texts[0], "en", "s", 1, "r", 1, "k", 0.5), (1, texts[0], "en", "s", 1, "r", 1, "k", 0.5), (1, texts[1], "en", "s", 1, "r", 1, "k", 0.5), (2, texts[0], "en", "s", 1, "r", 1, "k", 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_hashes_are_alike_at_any_place():
    data = np.frombuffer(b"abc abc xabc \xc3\xa9 abc", np.uint8)
    s, e, firsts = word_spans(data, np.array([0, 8, len(data)]))
    h = hash_spans(data, s, e)
    assert h[0] == h[1] == h[4] and h[2] != h[0] and firsts.tolist() == [0, 2, 5]
    long = np.frombuffer(b"q" * 3_000_000, np.uint8)
    assert hash_spans(long, np.array([0]), np.array([2_500_000]))[0] == hash_spans(long, np.array([7]), np.array([2_500_007]))[0]
    _, bounds = shingles(h, np.array([0, 2, 2, 5]), 5)
    assert np.diff(bounds).tolist() == [1, 0, 1]


def check_repeats(rows, got):
    seen, expected = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        mark = [False] * len(b)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                mark[p : p + 100] = [True] * 100
            seen.add(s)
        expected[i] = (len(b), bytes(x for x, m in zip(b, mark) if not m))
    assert got == expected


@pytest.mark.parametrize("whole", [1 << 13, 3, 1])
def test_suffix_dedup(spark, docs, texts, whole, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRETCHES", whole)  # 3: large buckets are split, 1: down to single strings
    out = suffix_dedup.dedup_substrings(docs).collect()
    check_repeats(enumerate(texts), {r["row"]["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in out})


def test_narrower_stretches_keep_equal_strings_together():
    rng = random.Random(7)
    say = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    texts = [say(rng.randint(0, 30)) + core + say(rng.randint(0, 60)) for core in [say(130), b"ab" * 70, b"a" * 120, say(101)] for _ in range(6)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    g, _, row, first, n = suffix_dedup.stretches(data, offsets)
    parts = [bytes(data[offsets[r] + f : offsets[r] + f + k + 99]) for r, f, k in zip(row, first, n)]
    for step in suffix_dedup.STEPS:
        flat, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        bucket, _, owner, at, count, start = suffix_dedup.narrow(g, n, flat, bounds, step)
        strings, places = {}, []
        for b, o, f, c, x in zip(bucket.tolist(), owner, at, count, start):
            for k in range(c):
                strings.setdefault(bytes(flat[x + k : x + k + 100]), set()).add((int(g[o]), b))
                places.append((int(o), int(f + k)))
        assert sorted(places) == [(o, k) for o in range(len(n)) for k in range(n[o])] and all(len(x) == 1 for x in strings.values())


def test_blocks_end_between_buckets(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1000)
    rng = random.Random(2)
    say = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    small, hot = say(120), [say(120) for _ in range(4)]
    # batches of five rows: a small bucket, a bucket longer than a batch, two short ones
    buckets = [(5, [small, small]), (7, [*hot, say(110), hot[0], *hot[1:], say(130), hot[0]]), (8, [hot[2], hot[2]]), (9, [say(105)])]
    rows = [(g, rid, 0, len(c) - 99, c) for rid, (g, c) in enumerate((g, c) for g, cs in buckets for c in cs)]
    schema = pa.schema([("g", pa.int64()), ("rid", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("context", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5]), schema)], schema=schema) for i in range(0, len(rows), 5)]
    got = {(r["rid"], r["first"] + k) for b in suffix_dedup._sort_blocks(iter(batches)) for r in b.to_pylist() for k in range(r["n"])}
    seen, expected = set(), set()
    for g, rid, first, n, c in rows:
        for k in range(n):
            if (g, c[k : k + 100]) in seen:
                expected.add((rid, first + k))
            seen.add((g, c[k : k + 100]))
    # strings meet in one bucket only, but a block may hold several
    assert expected <= got and all(any(c[k : k + 100] in x for _, r, _, _, x in rows if r < rid) for rid, k in got for c in [rows[rid][4]])


def test_suffix_order():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 600), np.full(300, 97), np.tile(rng.integers(97, 100, 40), 12)]).astype(np.uint8)
    at = np.arange(len(text) - 100)
    got = suffix_dedup.sort_suffixes(text, at)
    raw = text.tobytes()
    keys = [raw[i : i + 100] for i in got]
    assert keys == sorted(keys)


def jaccard_components(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("often", [2, 1])
def test_ngram_join(docs, texts, often, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN", often)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(docs).collect()}
    assert got == jaccard_components(enumerate(texts))


def test_copies_add_no_keys_and_sets(spark, monkeypatch):
    """Copies in all tasks, the least key last: bitmaps, classes and sets are of one document of each set, and no link is lost."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    different = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(5)]
    different += [f"{different[0]} end", f"other {different[1]}"]
    rows = list(enumerate([x for t in different for x in (t, t.upper())] * 6))
    counts, write = {}, common.Staging.write

    def counted(self, df, name, **k):
        out = write(self, df, name, **k)
        counts[name] = out.select("rid").distinct().count() if name in ("bits", "groups", "sets") else 0
        return out

    monkeypatch.setattr(common.Staging, "write", counted)
    df = spark.createDataFrame(rows[::-1], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(df).collect()}
    assert got == jaccard_components(rows)
    assert (counts["bits"], counts["groups"], counts["sets"]) == (7, 4, 4)


@pytest.mark.parametrize("shape", ["shuffled chain", "chain in order", "star", "two rings"])
def test_components_need_few_rounds(spark, shape, monkeypatch):
    n = 10_000 if shape == "shuffled chain" else 2000
    ids = list(range(n))
    if shape == "shuffled chain":
        random.Random(9).shuffle(ids)
    pairs = list(zip(ids, ids[1:]))
    if shape == "star":
        pairs = [(n // 2, i) for i in ids] * 2
    if shape == "two rings":
        pairs = [(i, (i + 2) % n) for i in ids]
    rounds, write = [], common.Staging.write
    monkeypatch.setattr(common.Staging, "write", lambda self, df, name, **k: (rounds.append(name) if name.startswith("moved") else None, write(self, df, name, **k))[1])
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)
    got = {r["id"]: r["comp"] for r in ngram_join.components(edges, common.Staging(spark, "test")).collect()}
    assert got == {i: i % 2 if shape == "two rings" else 0 for i in ids} and len(rounds) <= 20
    assert ngram_join.components(edges.filter("false"), common.Staging(spark, "test")).count() == 0


def test_frequent_pairs_are_complete():
    """Sets of 0.8 or more share a key, whatever is frequent."""
    rng = np.random.default_rng(2)
    for turn in range(300):
        n = int(rng.integers(2, 120))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = x.copy()
        for _ in range(int(rng.integers(0, max(1, n // 5) + 1))):
            k = int(rng.integers(0, len(y)))
            y = np.delete(y, k) if rng.random() < 0.5 and len(y) > 1 else np.where(np.arange(len(y)) == k, rng.integers(0, 2**63), y).astype(np.uint64)
        x, y = np.unique(x), np.unique(y)
        o = len(np.intersect1d(x, y))
        counts = (rng.random(ngram_join.CELLS) < [0.0, 0.5, 0.9, 1.0][turn % 4]).astype(np.uint8) * rng.integers(1, 9, ngram_join.CELLS).astype(np.uint8)
        if 100 * o >= 80 * (len(x) + len(y) - o) and not np.array_equal(x, y):
            assert len(np.intersect1d(ngram_join.keys_of(x, counts)[0], ngram_join.keys_of(y, counts)[0]))


def test_some_classes_are_rare_at_any_size():
    rng = np.random.default_rng(3)
    of = lambda x: ngram_join.frequent(ngram_join.levels(x))
    few = rng.poisson(0.05, 10_000)
    assert ((of(few) > 0) == (few > 0)).all() and not of(np.zeros(8, np.int64)).any()
    many = rng.poisson(3000, 10_000)
    many[:50] *= 1000
    got = of(many)
    assert (got[:50] > 0).all() and not got[50:].any() and (np.diff(got[:50][np.argsort(many[:50])].astype(int)) >= 0).all()


def test_keep_one(docs, texts):
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).select("doc_id").collect()}
    assert kept == {c for _, c in jaccard_components(enumerate(texts)).values()}


def test_decontamination(spark, docs, texts):
    rng = random.Random(1)
    items = [(k, " ".join(t.split()[5:25])) for k, t in enumerate(texts) if t and len(t.split()) > 30][:12] + [(90, "One-Two"), (91, None), (92, "!!"), (93, "never seen words here at all in any of the documents")]
    rng.shuffle(items)
    word = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t or "").split(" ")
    expected = {}
    for i, t in enumerate(texts):
        w = [x for x in word(t) if x]
        mark, hit = [0] * len(w), set()
        for k, b in items:
            v = [x for x in word(b) if x]
            for p in range(max(1, len(v) - 9) if v else 0):
                win = v[p : p + 10]
                for q in range(len(w) - len(win) + 1):
                    if w[q : q + len(win)] == win:
                        mark[q : q + len(win)] = [1] * len(win)
                        hit.add(k)
        expected[i] = (len(w), sum(mark), len(hit), hashlib.sha256(",".join(sorted(map(str, hit))).encode()).hexdigest(), any(mark))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (decontam.BLOCK_WINDOWS, 60):  # in one pass and in several
        got = {r["doc_id"]: tuple(r)[1:] for r in decontam.digest(decontam.contamination(docs, benchmark, block=block)).collect()}
        assert got == expected
    assert decontam.digest(decontam.contamination(docs, benchmark.filter("false"))).filter("contaminated").isEmpty()
    for slop in (1, 2):
        said, ask = [rng.choices("abcdefg", k=rng.randint(0, 40)) for _ in range(60)], [rng.choices("abcdefg", k=k) for k in (3, 5, 6, 1, 4)]
        expected = {}
        for i, w in enumerate(said):
            mark, hit = [0] * len(w), set()
            for k, v in enumerate(ask):
                for p in range(max(1, len(v) - 3)):
                    win = v[p : p + 4]
                    for q in range(len(w) - len(win) + 1):
                        if all(any(x in w[max(0, q + o + d) : max(0, q + o + d + 1)] for d in range(-slop, slop + 1)) for o, x in enumerate(win)):
                            mark[q : q + len(win)] = [1] * len(win)
                            hit.add(str(k))
            expected[i] = ([i for i, x in enumerate(mark) if x], sorted(hit))
        rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(said)], "doc_id bigint, text string")
        items = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(ask)], "item_id bigint, text string")
        got = {r["doc_id"]: ([k for a, b in r["spans"] for k in range(a, b)], r["items"]) for r in decontam.contamination(rows, items, width=4, slop=slop).collect()}
        assert got == expected
    index = decontam.PositionalIndex(docs)  # one index, several benchmarks
    assert index.search(benchmark).filter(F.size("spans") > 0).count() > 10 and index.search(benchmark.filter("item_id > 90")).filter(F.size("spans") > 0).isEmpty()
    near = spark.createDataFrame([(0, "p q r s")], "item_id bigint, text string")
    text = spark.createDataFrame([(0, "p x q r s")], "doc_id bigint, text string")
    assert [decontam.contamination(text, near, slop=k).first()["items"] for k in (0, 1)] == [[], ["0"]]


def test_an_index_is_opened_by_its_path(spark, docs, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_BLOCK", 2000)  # many blocks
    rng, path = random.Random(5), str(tmp_path / "index")
    decontam.PositionalIndex(docs, path=path)
    ask = [(k, " ".join(t.split()[3:17])) for k, t in enumerate(texts) if t and len(t.split()) > 30]
    ask += [(1000 + k, " ".join(rng.sample((texts[k] or "").split(), 12))) for k in range(20)]  # words of texts, in no text
    benchmark = spark.createDataFrame(ask, "item_id bigint, text string")
    opened = decontam.PositionalIndex.open(spark.newSession(), path, "id")
    again = opened.table.sparkSession.createDataFrame(ask, "item_id bigint, text string")
    want = {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination(docs, benchmark).collect()}
    got = {r["id"]: tuple(r)[1:] for r in opened.search(again).collect()}
    assert got == want and len(got) == len(texts)
    found = {i for _, _, items in got.values() for i in items}
    assert {str(k) for k, _ in ask if k < 1000} == found
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        decontam.PositionalIndex(docs, path=path)
    empty = str(tmp_path / "empty")
    decontam.PositionalIndex(docs.filter("false"), path=empty)
    assert decontam.PositionalIndex.open(spark, empty).search(benchmark).count() == 0


def test_shards_are_written_whole(spark, docs, awkward, tmp_path):
    path = str(tmp_path / "shards")
    rows = docs.unionByName(awkward)
    sharding.write_shards(rows, path, 4)
    got = spark.read.parquet(path)
    assert sorted(map(str, (tuple(r["row"]) for r in got.collect()))) == sorted(map(str, map(tuple, rows.collect())))
    slots = [sorted(r["slot"] for r in got.filter(F.col("shard") == k).collect()) for k in range(4)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert len(list((tmp_path / "shards").glob("shard=*"))) == 4


def test_sharding(docs, texts):
    out = sharding.shard(docs, 7, bucket_bytes=4000).collect()
    assert sorted(r["row"]["doc_id"] for r in out) == list(range(len(texts)))
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert [r["row"]["doc_id"] for r in sorted(out, key=lambda r: (r["slot"], r["shard"]))] != list(range(len(texts)))
    assert sharding.shard(docs.filter("false"), 4).count() == 0


def test_statistics(docs, texts):
    clash = docs.withColumnsRenamed({"lang": "_w", "source": "_x", "n_chars": "stats", "row": "_row"})
    out = quality_rules.statistics(clash)
    assert out.columns == [c for c in clash.columns if c != "stats"] + ["stats"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {(r["_w"], r["_x"], r["_row"]) for r in got.values()} == {("en", "s", "r")}
    for i, t in enumerate(texts):
        t = t or ""
        w, word = [], ""
        for c in t + " ":
            w, word = (w + [word] if word else w, "") if c in BLANKS else (w, word + c)
        lines = [x for x in t.split("\n") if any(c not in BLANKS for c in x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times = Counter(windows)
        repeat = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(5)}
        s = got[i]["stats"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert s["n_repeat_words"] == len(repeat) and s["n_distinct"] == len(set(w))


def test_rules_are_learned():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = (x["a"] > 0.8) | (x["b"] < 0.1)
    rules = quality_rules.learn(x, bad)
    caught = np.zeros(2000, bool)
    for r in rules:
        caught |= quality_rules._holds(r, x, 2000)
    assert (caught == bad).mean() > 0.97 and quality_rules.learn(x, np.zeros(2000, bool)) == []


def test_ftrl_against_a_plain_one():
    """One coordinate at a time, in the same order of examples."""
    rng = np.random.default_rng(4)
    examples = [(int(k % 3 == 0), np.unique(rng.integers(0, 40, 9))) for k in range(90)]
    prior, alpha, beta, l2 = 0.2, 0.3, 1.0, 0.1
    l1 = 0.5  # the least that a share makes
    z, n, bias, bias_n = {}, {}, np.log(prior / (1 - prior)), 1.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (np.sign(zi) * l1 - zi) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(3):
        for k in order.permutation(len(examples)):
            y, ids = examples[k]
            w = {int(i): weight(int(i)) for i in ids}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * wi
                n[i] = old + g * g
            bias_n += g * g
            bias -= 0.02 * g / bias_n**0.5
    kept, weights, intercept = toxicity.fit_ftrl(examples, prior, alpha, beta, 0.001, l2)
    plain = {i: weight(i) for i in z if weight(i)}
    assert sorted(plain) == kept.tolist() and np.allclose([plain[i] for i in kept.tolist()], weights, rtol=1e-4) and abs(bias - intercept) < 1e-6
    odds, labels = toxicity.margins((kept, weights, intercept), examples)
    assert np.allclose(odds, [bias + sum(plain.get(int(i), 0.0) for i in ids) for _, ids in examples], rtol=1e-4)
    slope, shift = toxicity.calibrate(odds, labels, prior)
    assert toxicity.loss(slope * odds + shift, labels, prior) <= toxicity.loss(odds, labels, prior) + 1e-2 and toxicity.loss(odds, labels, prior) < toxicity.loss(0 * odds, labels, prior)
    assert toxicity.choose_rates(examples, examples[:1], prior) == (toxicity.ALPHAS[0], toxicity.SHARES[0], 1.0, 0.0)


def test_toxicity(spark):
    rng = random.Random(3)
    say = lambda: [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 30)) for _ in range(60)]
    rows, labels = [], []
    for i in range(600):
        w, bad = say(), i % 4 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["nastyword", "vileword"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (7000, "")], "doc_id bigint, text string")
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held) and len(got) == 602
    assert toxicity.score(docs, toxicity.fit(docs, table.filter("false"))).filter("score is null").isEmpty()
    # other labels of held-out rows change nothing; a bound on bytes holds; keys repeat
    swapped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.fit(docs, x) for x in (table, swapped)]
    assert all(np.array_equal(a, b) for a, b in zip(*models)) and len(models[0][0]) > 0
    assert not np.array_equal(toxicity.fit(docs.union(docs), table, fit_bytes=1)[0], models[0][0])
    wide = docs.withColumns({"row": F.lit(1), "label": F.lit("x"), "score": F.lit(2.0)})
    assert toxicity.reject_toxic(wide, table).columns == wide.columns and toxicity.reject_toxic(wide.filter("false"), table).count() == 0


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://x.www.example.com/en/?q", "http://example.com/english", "ftp://n.net/es/a#f", "http://net/fr/", "http://com", "no scheme", None, "://", "http://xcom/", "http://a.net/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).orderBy("row.page_id").collect()]
    assert [g[2] for g in got] == ["com/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None, None, None]
    assert [g[3] for g in got] == ["allow", "block", "allow", "allow", "allow", "block", "block", *["allow"] * 6] and got[1][:2] == ("example.com", "/en/1") and got[9][:2] == ("", "")


def test_url_rules_from_a_table_in_several_passes(spark):
    rng = random.Random(5)
    hosts = [f"h{i % 40}.d{i % 7}.org" for i in range(300)]
    urls = [f"http://{h}/p{rng.randint(0, 9)}/q{rng.randint(0, 9)}/x?y" for h in hosts]
    rules = [(f"{h}/p{rng.randint(0, 9)}/", rng.choice(["allow", "block"])) for h in hosts[:90]] + [("d3.org/", "block"), ("d4.org/", "block"), ("d4.org/", "allow"), ("h1.d1.org/p1/q1/", "allow"), (None, "allow"), ("x/", "other")]
    both = {r for r, v in rules if (r, "allow") in rules and (r, "block") in rules}
    expected = []
    for h, u in zip(hosts, urls):
        path = u.split(h, 1)[1].split("?")[0]
        fits = {(r, "block" if r in both else v) for r, v in rules if r and v != "other" and (h + "/").endswith("." + r[: r.index("/")] + "/") | (h == r[: r.index("/")]) and path.startswith(r[r.index("/") :])}
        best = min(fits, key=lambda x: (-len(x[0]), x[0]), default=(None, "allow"))
        expected.append(best)
    pages = spark.createDataFrame(list(enumerate(urls)), "rule bigint, url string")
    table = spark.createDataFrame(rules, "rule string, verdict string")
    for most in (1 << 20, 40):
        got = url_filter.judge(pages, table, most_bytes=most).orderBy("row.rule").collect()
        assert [(r["rule"], r["verdict"]) for r in got] == expected
    assert {r["verdict"] for r in url_filter.judge(pages, table.filter("false")).collect()} == {"allow"}
    assert url_filter.judge(pages.filter("false"), table).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(30_000).select(F.xxhash64("id").alias("h"))
    listed = spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("h"))
    cascade = url_filter.build_cascade(listed, universe)
    h = np.array([r["h"] for r in universe.collect()], np.int64).view(np.uint64)
    inside = {r["h"] for r in listed.collect()}
    assert cascade.listed(h).tolist() == [int(x) in inside for x in h.view(np.int64)] and len(cascade.levels) > 1


def test_packing(docs, texts, awkward):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (docs, awkward):
        pieces = packing.pack_documents(table, window=256).collect()
        ids, seqs = {}, {}
        for r in sorted(pieces, key=lambda r: r["start"]):
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            if table is docs:
                assert r["start"] == len(ids.setdefault(r["doc_id"], b"")) // 2
                ids[r["doc_id"]] += bytes(r["ids"])
        for x in seqs.values():
            at = 0
            for o, n in sorted(x):
                assert o == at
                at += n
            assert at <= 256
        assert len(seqs) <= sum(r["length"] for r in pieces) / 256 + 1.5 * 64
        for i, b in ids.items():
            assert np.frombuffer(b, "<u2").tolist() == [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
    assert packing.pack_documents(docs.filter("false")).count() == 0


def test_ids_are_the_library_s():
    import public_tokenizers
    from logloom.llm.tokens import load, table
    from tokenizers import Tokenizer

    library, own, rows = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), load("word_bpe_49k.json"), table("word_bpe_49k.json")
    rng = random.Random(13)
    parts = ["a", "Z", "é", "ß", "İ", "ſ", "ñ", "中", "文", "🙂", "\u0301", "\u200b", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "'s", "'LL", "don't", "0", "12", "$", "--", "<|endoftext|>", "<|startoftext|>", "<|", "\x00", "\ufffd", "qwxz", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(own.ids(t), "<u2").tolist() for t in texts] == expected
    raw = [t.encode() for t in texts]
    flat, bounds = rows.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*x, 2] for x in expected]


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((8, 30)), np.zeros(30)
    x[[3, 9, 20]] = [1.0, 2.0, 0.5]
    assert np.linalg.norm(a @ packing.nnls(a, a @ x) - a @ x) < 1e-6
    h = rng.integers(0, 50, 64)
    used = np.zeros(64, int)
    for parts, n in packing.plan(h):
        assert sum(parts) == 64
        for p in parts:
            used[p - 1] += n
    assert (used <= h).all()


def test_token_output(docs, texts):
    from logloom.llm.tokens import load

    t = load("word_bpe_49k.json")
    got = {}
    for r in token_output.packed_rows(docs, window=128, stretch=3000).collect():
        ids = np.frombuffer(bytes(r["input_ids"]), "<u2")
        end = r["cu_seqlens"][-1]
        assert len(ids) == 128 and r["cu_seqlens"][0] == 0 and (ids[end:] == token_output.PAD).all() and token_output.PAD not in ids[:end]
        position, expected = np.zeros(128, int), np.zeros(128, int)
        for a, b in zip(r["resets"], [*r["resets"][1:], 128]):
            position[a:b] = range(b - a)
        for a, b in zip(r["cu_seqlens"], [*r["cu_seqlens"][1:], 128]):
            expected[a:b] = range(b - a)
        assert position.tolist() == expected.tolist()
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            got.setdefault(d, {})[s] = ids[a:b].tolist()
    for i, x in enumerate(texts):
        assert sum((got[i][s] for s in sorted(got[i])), []) == [*np.frombuffer(t.ids(x), "<u2").tolist(), 49407]


def test_written_matrices(docs, awkward, tmp_path):
    spark = docs.sparkSession
    token_output.write_packed(docs, str(tmp_path / "packed"), window=256)
    back = spark.read.parquet(str(tmp_path / "packed"))
    key = lambda df: sorted((bytes(r["input_ids"]), tuple(r["cu_seqlens"]), tuple(r["resets"]), tuple(r["doc_ids"])) for r in df.collect())
    assert key(back) == key(token_output.packed_rows(docs, window=256))
    assert sum(len(r["doc_ids"]) for r in token_output.packed_rows(awkward).collect()) == awkward.count()
    assert token_output.packed_rows(docs.filter("false")).count() == 0
    # the emptiest sequences of a stretch go on: little padding however short the stretches
    rows = token_output.packed_rows(docs.coalesce(1), window=128, stretch=2000).select("cu_seqlens").collect()
    tokens = sum(r["cu_seqlens"][-1] for r in rows)
    assert len(rows) <= 1.03 * tokens / 128 + 1


def test_best_fit():
    into, n = token_output.best_fit(np.array([6, 5, 5, 4, 3, 3, 2, 2]), 10)
    sizes = np.bincount(into, [6, 5, 5, 4, 3, 3, 2, 2])
    assert n == 3 and sizes.max() == 10


@pytest.mark.parametrize("most", [1 << 20, 60, 0])
def test_word_counts(docs, texts, most):
    total = Counter(w for t in texts for w in words_of(t))
    words = lm_scoring.vocabulary(docs, most=most, own=63)
    assert words.frequency.sum() == sum(total.values()) and len(words.hashes) <= most
    assert len(words.hashes) + words.rest.join(docs.sparkSession.createDataFrame([(int(h),) for h in words.numbers.keys.view(np.int64)], "h bigint"), "h", "left_anti").count() == len(total) - 63


def test_pseudo_likelihood_by_hand(spark, docs, texts):
    model = lm_scoring.fit(docs, most=100, own=150)
    out = {r["key"]: r for r in lm_scoring.score(model.numbered, model).collect()}
    assert out[79]["n_words"] == 0 and out[79]["log_likelihood"] == out[79]["mean_log_likelihood"] == 0.0 and len(out) == len(texts)
    w, p, table = model.words, model.p, model.table
    total = Counter(x for t in texts for x in words_of(t))
    code = lambda x: lm_scoring.codes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))
    numbers = {x: int(w.numbers(code(x))[0]) for x in total}
    group = lambda x: 32 * (x.encode()[0] % 32) + x.encode()[-1] % 32
    rare = {x: n for x, n in total.items() if numbers[x] < lm_scoring.GROUPS}
    assert len(total) - len(rare) == 150 and all(numbers[x] == group(x) for x in rare)
    assert min(n for x, n in total.items() if x not in rare) >= max(rare.values())
    once, mass = Counter(group(x) for x, n in rare.items() if n == 1), Counter()
    for x, n in rare.items():
        mass[group(x)] += n
    assert [(w.once[g], w.frequency[g]) for g in range(lm_scoring.GROUPS)] == [(max(1, once[g]), mass[g]) for g in range(lm_scoring.GROUPS)]
    spelt_mass = lm_scoring.group_mass(table)
    for i in (0, 45, 80, 81, 85, 88):
        said = words_of(texts[i])
        ids = [numbers[x] for x in said]
        mine, ll = Counter(x for x in said if x in rare), 0.0
        k = Counter(group(x) for x in said if x in rare)
        for at, x in enumerate(said):
            around = [ids[at + d] if 0 <= at + d < len(ids) else lm_scoring.VOCABULARY for d in (-2, -1, 1, 2)]
            h = np.tanh(np.concatenate([p["e"][c] for c in around]).astype(float) @ p["w"] + p["b"])
            c, m = divmod(ids[at], lm_scoring.PER_CLASS)
            a, b = h @ p["c"] + p["d"], h @ p["u"][c] + p["v"][c]
            ll += a[c] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())
            if x in rare:
                chain, g = [256, *x.encode(), 256], group(x)
                novel = np.log(max(1, once[g])) + sum(table[e, f] for e, f in zip(chain, chain[1:])) - spelt_mass[g]
                ll += np.logaddexp(np.log(total[x] - mine[x]) if total[x] > mine[x] else -np.inf, novel) - np.log(mass[g] - k[g] + max(1, once[g]))
        assert abs(out[i]["log_likelihood"] - ll) < 1e-3 * abs(ll) + 1e-3 and out[i]["n_words"] == len(said)
    fresh = lm_scoring.score_texts(docs.limit(3), model).collect()
    assert all(r["log_likelihood"] >= out[r["doc_id"]]["log_likelihood"] - 1e-6 for r in fresh)
    none = lm_scoring.fit(docs.filter("false"))
    assert lm_scoring.score(none.numbered, none).count() == 0


def test_mass_of_spellings():
    """The chain's mass in a group is that of its words, all spelled out."""
    pairs = np.zeros((257, 257))
    for x, n in (("ab", 900), ("a", 700), ("ba", 500), ("abb", 300)):
        chain = [256, *x.encode(), 256]
        for f, g in zip(chain, chain[1:]):
            pairs[f, g] += 1e9 * n  # so much that smoothing adds next to nothing
    table = lm_scoring.spelling_table(pairs)
    mass = np.exp(lm_scoring.group_mass(table))
    assert abs(mass.sum() - 1) < 1e-9
    words = ["".join(x) for n in range(1, 15) for x in itertools.product("ab", repeat=n)]
    for first, last in itertools.product("ab", repeat=2):
        own = 0.0
        for x in words:
            if x[0] == first and x[-1] == last:
                chain = [256, *x.encode(), 256]
                own += np.exp(sum(table[f, g] for f, g in zip(chain, chain[1:])))
        assert abs(mass[32 * (ord(first) % 32) + ord(last) % 32] - own) < 2e-3


def test_rare_words_depend_on_both_sides(spark):
    """Words of which each occurs once: those like others at such a place are likelier there than where words of another kind stand."""
    rng = random.Random(8)
    kind = {"the": "a", "we": "b"}
    novel = lambda first: first + "".join(rng.choice("mnopqr") for _ in range(9)) + first
    lines = [" ".join(f"{x} {novel(kind[x])} {'of' if x == 'the' else 'it'}" for x in (rng.choice(["the", "we"]) for _ in range(60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model = lm_scoring.fit(docs.coalesce(1), rounds=12, stride=1, own=8)  # small tables make few steps in a round
    new = [(novel("a"), novel("b")) for _ in range(40)]
    right = [(i, f"the {a} of we {b} it") for i, (a, b) in enumerate(new)]
    swapped = [(100 + i, f"the {b} of we {a} it") for i, (a, b) in enumerate(new)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_scoring.score_texts(spark.createDataFrame(right + swapped, "doc_id long, text string"), model).collect()}
    assert all(got[i] > got[100 + i] + 0.5 for i in range(40))


def test_shuffled_text_is_less_likely(spark):
    """Sentences of one grammar with many names that occur a few times: shuffled words score below, name for name."""
    rng = random.Random(9)
    names = ["".join(rng.choice("klmnt") + rng.choice("aeiou") for _ in range(4)) for _ in range(500)]
    say = lambda: " ".join(f"old {rng.choice(names)} went to see {rng.choice(names)} by the river" for _ in range(8))
    model = lm_scoring.fit(spark.createDataFrame([(i, say()) for i in range(200)], "doc_id long, text string").coalesce(1), rounds=12, stride=1, own=20)
    fresh = [say().split() for _ in range(20)]
    rows = [(i, " ".join(x)) for i, x in enumerate(fresh)] + [(100 + i, " ".join(rng.sample(x, len(x)))) for i, x in enumerate(fresh)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i] > got[100 + i] for i in range(20))


def test_gradients():
    """The trainer's steps are those of the gradient of the summed negative log-likelihood, by finite differences."""
    rng = np.random.default_rng(6)
    p = {k: v.astype(float) for k, v in lm_scoring.initial(rng.integers(1, 50, lm_scoring.VOCABULARY).astype(float)).items()}
    p = {k: v + 0.1 * rng.standard_normal(v.shape) for k, v in p.items()}
    around, target = rng.integers(0, lm_scoring.VOCABULARY + 1, (40, 4)).astype(np.int32), rng.integers(0, 400, 40).astype(np.int32)
    trainer = lm_scoring.Trainer(p)
    trainer.train(around, target)
    loss = lambda q: -lm_scoring.log_probabilities(q, around, target).sum() / np.sqrt(len(target))
    for k in p:
        step = (p[k] - trainer.p[k]) / trainer.rate  # g / sqrt(0.1 + g^2)
        grad = np.sign(step) * np.sqrt(0.1 * step**2 / (1 - step**2))
        for at in [np.unravel_index(x, grad.shape) for x in np.argsort(-np.abs(grad).ravel())[:4]]:
            near = {n: v.copy() for n, v in p.items()}
            near[k][at] += 1e-5
            far = {n: v.copy() for n, v in p.items()}
            far[k][at] -= 1e-5
            assert abs((loss(near) - loss(far)) / 2e-5 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


@pytest.mark.parametrize("far", [10, 4000])
def test_batches_of_several_blocks(far):
    """A step and the log-probabilities over several blocks, with logits that leave float32's range too, are those worked out plainly in float64."""
    rng = np.random.default_rng(16)
    p = lm_scoring.initial(rng.integers(1, 50, lm_scoring.VOCABULARY).astype(float))
    for k, times in (("e", 70), ("w", 10), ("c", far), ("u", far)):
        p[k] *= times
    n = 5000
    target = np.minimum(rng.geometric(0.002, n) - 1, lm_scoring.VOCABULARY - 1).astype(np.int32)
    around = rng.integers(0, lm_scoring.VOCABULARY + 1, (n, 4)).astype(np.int32)
    trainer = lm_scoring.Trainer(p)
    trainer.train(around, target)

    q, cls, within, rows = {k: v.astype(float) for k, v in p.items()}, target // lm_scoring.PER_CLASS, target % lm_scoring.PER_CLASS, np.arange(n)
    x = q["e"][around].reshape(n, -1)
    h = np.tanh(x @ q["w"] + q["b"])
    a, b = h @ q["c"] + q["d"], np.einsum("ni,nij->nj", h, q["u"][cls]) + q["v"][cls]
    assert far == 10 or max(np.abs(a).max(), np.abs(b).max()) > 100  # exp leaves float32
    a, b = a - a.max(1, keepdims=True), b - b.max(1, keepdims=True)
    plain = a[rows, cls] - np.log(np.exp(a).sum(1)) + b[rows, within] - np.log(np.exp(b).sum(1))
    assert np.allclose(lm_scoring.log_probabilities(p, around, target), plain, rtol=1e-3, atol=1e-3)

    a, b = (np.exp(z) / np.exp(z).sum(1, keepdims=True) for z in (a, b))
    a[rows, cls] -= 1
    b[rows, within] -= 1
    da = (a @ q["c"].T + np.einsum("nj,nij->ni", b, q["u"][cls])) * (1 - h * h)
    grad = {k: np.zeros_like(v) for k, v in q.items()} | {"c": h.T @ a, "d": a.sum(0), "w": x.T @ da, "b": da.sum(0)}
    np.add.at(grad["u"], cls, h[:, :, None] * b[:, None])
    np.add.at(grad["v"], cls, b)
    np.add.at(grad["e"], around, (da @ q["w"].T).reshape(n, 4, -1))
    for k in q:
        g = grad[k] / np.sqrt(n)
        assert np.allclose(trainer.p[k], q[k] - trainer.rate * g / np.sqrt(0.1 + g * g), rtol=1e-3, atol=1e-3), k


def test_cost_of_a_word():
    """Training on a word and scoring it take few times the CPU of the bare products of their matrices."""
    code = """
import time
import numpy as np
from logloom.llm import lm_scoring as lm

rng, n = np.random.default_rng(1), 16384
often = 1e6 / np.arange(1, lm.VOCABULARY + 1)
p = lm.initial(often)
pick = lambda *shape: np.minimum(np.searchsorted(np.cumsum(often / often.sum()), rng.random(shape)), lm.VOCABULARY - 1).astype(np.int32)
trainer, (x, h) = lm.Trainer(p), (rng.random((n, k), np.float32) for k in (2 * lm.SIDE * lm.EMBED, lm.HIDDEN))
batches = [(pick(n, 2 * lm.SIDE), pick(n)) for _ in range(8)]

def least(work):
    took = []
    for batch in batches:
        began = time.process_time()
        work(*batch)
        took.append(time.process_time() - began)
    return min(took)

bare = least(lambda around, target: (x @ p["w"], h @ p["c"], h @ p["u"][0]))
print((least(trainer.train) + least(lambda around, target: lm.log_probabilities(p, around, target))) / bare)
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, cwd=Path(lm_scoring.__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert float(ran.stdout) < 6


def test_copies_are_likelier(spark):
    """A text that occurs twice is likelier than such texts that occur once: what is gathered takes in the whole corpus."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("aeionrstlk") for _ in range(rng.randint(4, 9)))
    common = [word() for _ in range(300)]
    say = lambda: " ".join(rng.choice(common) if rng.random() < 0.7 else word() for _ in range(80))
    rows = [say() for _ in range(420)]
    rows += rows[:20]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    model = lm_scoring.fit(docs)
    got = {r["key"]: r["mean_log_likelihood"] for r in lm_scoring.score(model.numbered, model).collect()}
    alone = sorted(got[i] for i in range(20, 420))
    assert all(got[i] > alone[-10] for i in [*range(20), *range(420, 440)])


def test_spelling_of_unknown_words(spark):
    table = lm_scoring.spelling_table(np.random.default_rng(3).integers(0, 3, (257, 257)) * np.append(lm_scoring._HELD, True))
    assert np.allclose(np.exp(table).sum(1), 1)
    low, starts, ends = np.frombuffer(b"ab  c\xc3 d", np.uint8), np.array([0, 4, 7]), np.array([2, 6, 8])
    chains = [[256, *w, 256] for w in (b"ab", b"c\xc3", b"d")]
    assert np.allclose(lm_scoring.spelled(table, low, starts, ends), [sum(table[a, b] for a, b in zip(c, c[1:])) for c in chains])

    rng = random.Random(8)
    common = ["".join(rng.choice("aeionrst") for _ in range(5)) for _ in range(300)]
    rare = iter(range(10**9))
    prose = lambda: " ".join(rng.choice(common) for _ in range(60))
    noise = lambda: " ".join(f"{hashlib.md5(str(next(rare)).encode()).hexdigest()[:8]}" for _ in range(60))
    rows = [(i, prose()) for i in range(40)] + [(100 + i, noise()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    model = lm_scoring.fit(docs)
    out = {r["key"]: r["mean_log_likelihood"] for r in lm_scoring.score(model.numbered, model).collect()}
    assert max(v for k, v in out.items() if k >= 100) < min(v for k, v in out.items() if k < 100)


def test_every_word_is_a_target_once():
    words = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    words[1000:3000] = words[0]
    taken = [lm_scoring.targets(words, turn, lm_scoring.STRIDE) for turn in range(lm_scoring.ROUNDS)]
    assert np.sort(np.concatenate(taken)).tolist() == list(range(5000))


def test_awkward_rows(awkward):
    joined = ngram_join.similarity_components(awkward).collect()
    assert len(joined) == 6 and sum(r["component_id"] == 1 for r in joined) >= 3
    kept = suffix_dedup.dedup_substrings(awkward).collect()
    assert len(kept) == 6 and {len(bytes(r["kept"])) for r in kept if r["row"]["doc_id"] == 2} == {0}
    assert ngram_join.keep_one(awkward).count() == 4
    assert sharding.shard(awkward, 2).count() == 6


def test_awkward_rows_elsewhere(spark, awkward):
    """Null keys, keys of several texts and whole repeats: every row has its own result."""
    rows = awkward.collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    benchmark = spark.createDataFrame([(None, "null key one two three four five six"), (3, None)], "item_id bigint, text string")
    found = decontam.contamination(awkward, benchmark).collect()
    assert sorted((r["doc_id"] is not None, len(r["spans"])) for r in found) == sorted((r["doc_id"] is not None, int((r["text"] or "").startswith("null key"))) for r in rows)
    assert decontam.reject_contaminated(awkward, benchmark).count() == len(rows) - 1
    assert [r["stats"]["n_words"] for r in sorted(quality_rules.statistics(awkward).collect(), key=key)] == [len(words_of(r["text"])) for r in sorted(rows, key=key)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(awkward, toxicity.fit(awkward, labels)).count() == toxicity.reject_toxic(awkward, labels).count() + toxicity.score(awkward, toxicity.fit(awkward, labels)).filter("score >= 0.5").count() == len(rows)
    model = lm_scoring.fit(awkward)
    assert sorted((r["key"] is None, r["key"] or 0, r["n_words"]) for r in lm_scoring.score(model.numbered, model).collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(words_of(r["text"]))) for r in rows)
    assert packing.with_crc(packing.pack_documents(awkward)).count() >= len(rows)


def test_keys_of_other_types(spark, texts):
    """Text keys and fractions are ordered as they are; nothing is merged."""
    for kind, make in (("string", lambda i: f"d{i:04}"), ("double", lambda i: i + 0.5)):
        docs = spark.createDataFrame([(make(i), t) for i, t in enumerate(texts[:75])], f"doc_id {kind}, text string")
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(docs).collect()}
        assert got == {make(i): make(c) for i, (_, c) in jaccard_components(enumerate(texts[:75])).items()}
        kept = {r["row"]["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(docs).collect()}
        check_repeats([(make(i), t) for i, t in enumerate(texts[:75])], kept)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        common.Staging(Session, "x")
    Context.master = "local[2]"
    assert common.Staging(Session, "x").root.startswith("/tmp/spark-")
