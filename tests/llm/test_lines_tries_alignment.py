"""Line dedup, the conversation trie and cross-tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import line_dedup, prefix_trie, token_align

DOCS = "doc_id long, text string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# ---------------------------------------------------------------- lines


def lines_brute(rows, least=10):
    """By documents in order of id; rows with equal ids and texts are one document."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first.setdefault(key(x), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def run_lines(spark, rows):
    out = line_dedup.line_bitmaps(spark.createDataFrame(rows, DOCS))
    kept = F.sha2(line_dedup.kept_text(F.col("row.text"), F.col("keep")).cast("binary"), 256)
    return sorted([tuple(r) for r in out.select("row.doc_id", "n_lines", "n_dropped", kept).collect()], key=repr)


def test_lines_against_brute_force(spark):
    random.seed(3)
    pool = ["The quick brown fox", " the QUICK brown fox\t", "short", "", "ÄRGER und Übermut", "ärger und übermut", "0123456789", "012345678", "a\x0bline of words\x0c", "\x0ba\x0bline of words"]
    rows = [(d, "\n".join(random.choice(pool + [f"own line number {d}"]) for _ in range(random.randint(1, 12)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 2_000_000 + "\n" + "the quick brown fox"), (104, "\n".join(["the quick brown fox", "kept alone in 104"] * 5000)), (7, rows[7][1]), (7, rows[7][1]), (None, "the quick brown fox\nnull key line")]
    rows = [r for r in rows if r[0] != 7] + [(7, rows[7][1])] * 3
    assert run_lines(spark, rows) == lines_brute(rows)


def test_frequent_lines_are_taken_out(spark):
    rows = [(d, f"the line of every document\nown line {d:06d}\nthe line of every document") for d in range(3000)]
    lines = spark.createDataFrame([(5, 1, d, 0) for d in range(3000)] + [(d, 2, d, 1) for d in range(10, 3000)], "h1 long, h2 long, _rid long, pos int")
    assert line_dedup._frequent(lines) == [5]
    assert run_lines(spark, rows) == lines_brute(rows)


def test_lines_of_odd_tables(spark):
    assert run_lines(spark, []) == []
    odd = spark.createDataFrame([("a", "one long enough line", 1, 2, 3), ("b", "One long enough line\nx", 4, 5, 6)], "doc_id string, text string, row int, keep int, pos int")
    out = sorted(tuple(r) for r in line_dedup.without_repeated_lines(odd).collect())
    assert out == [("a", "one long enough line", 1, 2, 3), ("b", "x", 4, 5, 6)]
    same_key = spark.createDataFrame([(1, "one long enough line"), (1, "one long enough line\nmore")], DOCS)
    assert sum(r["n_dropped"] for r in line_dedup.line_bitmaps(same_key).collect()) == 1


def test_runs_round_trip(spark):
    df = spark.sql("select array(named_struct('at', 0, 'n', 3), named_struct('at', 70000, 'n', 1)) as r union all select cast(array() as array<struct<at:int,n:int>>)")
    got = df.select("r", line_dedup.unpack_runs(line_dedup.pack_runs(F.col("r"))).alias("x")).collect()
    assert all(r["r"] == r["x"] for r in got)


# ---------------------------------------------------------------- tries


def trie_brute(convs):
    """convs: {id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += kids[k] == 0
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return sorted(out)


def rows_of(convs):
    return [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]


def arrays(spark, convs):
    """Also conversations without turns."""
    got = prefix_trie.turn_arrays(spark.createDataFrame(rows_of(convs), "conv_id long, turn long, role string, text string"))
    none = [c for c, t in convs.items() if not t]
    if none:
        empty = spark.createDataFrame([(c,) for c in none], "conv long").withColumn("turns", F.array().cast(got.schema["turns"].dataType))
        got = got.unionByName(empty)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed):
    random.seed(seed)
    turns = [("user", "a"), ("user", "bb"), ("assistant", "ééé"), ("", "")]
    convs = {c: [random.choice(turns[: 2 + seed]) for _ in range(random.choice([0, 1, 2, 3, 5, 9, 17]))] for c in random.sample(range(-50, 1000), 150)}
    got = sorted(tuple(r) for r in prefix_trie.conversation_trie(arrays(spark, convs), batches=(0.05, 0.2, 0.6)).collect())
    assert got == trie_brute(convs)


def test_trie_of_hot_and_long_conversations(spark):
    long = [("user", str(k)) for k in range(400)]
    convs = {c: long[: 400 - c] + [("user", "x")] * (c % 3) for c in range(40)} | {c: [("system", "hello"), ("user", "same")] for c in range(100, 400)} | {c: [("system", "hello"), ("user", str(c))] for c in range(500, 600)}
    got = sorted(tuple(r) for r in prefix_trie.conversation_trie(arrays(spark, convs)).collect())
    assert got == trie_brute(convs)


def test_ends_join_over_pieces(spark, monkeypatch):
    ends = spark.range(30000).selectExpr("cast(1 as bigint) o", "2 as d", "id as c").unionByName(spark.sql("select 3L o, 1 d, 7L c"))
    got = {(r["o"], r["d"]): r["ends"] for r in prefix_trie._digests(ends).collect()}
    assert got == {(1, 2): sha(",".join(map(str, range(30000)))), (3, 1): sha("7")}


def test_rebuilt_conversations_and_odd_rows(spark):
    random.seed(5)
    rows = []
    for c in random.sample(range(200), 120):
        rows += [(c, random.choice([None, k]), random.choice(["user", None]), random.choice(["hi", "there", None])) for k in range(random.randint(1, 10))]
    rows += rows[:5] + [(None, 0, "user", "nobody's")]
    own = defaultdict(list)
    for c, k, r, t in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, r or "", t or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    convs = {c: own.get(c - c % 5, [])[: h(c)] + x[h(c) :] for c, x in own.items()}
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv int")
    got = sorted(tuple(r) for r in prefix_trie.conversation_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(df))).collect())
    assert got == trie_brute(convs)
    empty = df.filter("false")
    assert prefix_trie.conversation_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(empty))).collect() == []


@pytest.mark.parametrize("a,b,want", [(0, 1, 1), (0, 6, 4), (4, 6, 6), (4, 7, 6), (6, 7, 7), (0, 16, 16), (8, 15, 12)])
def test_two_fattest(spark, a, b, want):
    assert spark.range(1).select(prefix_trie._fattest(F.lit(a), F.lit(b))).first()[0] == want
    low = max(range(a + 1, b + 1), key=lambda x: x & -x)
    assert low == want


# ---------------------------------------------------------------- alignment


def spelt(e, which, ids):
    return [bytes(e.spell(which, np.array([i]))) for i in ids]


def document_brute(e, text):
    """A's and B's ids and the groups, null without tokens; both libraries see the whole text."""
    if not text:
        return None
    a, b = e.a.encode(" " + text, add_special_tokens=False).ids, e.b.encode(text)
    x, y = spelt(e, 0, a), spelt(e, 1, b)
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return None
    ends = [np.cumsum([len(t) for t in z]).tolist() for z in (x, y)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def alignment_brute(e, rows):
    found = [document_brute(e, t) for _, t in rows]
    links = [Counter((p, q) for x, y in (f[2] if f else []) for p in x for q in y) for f in found]
    count = Counter(k for x in links for k in x)
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (d, _), f, x in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in f[2]) if f else ""
        out.append((d, len(f[0]) if f else 0, len(f[1]) if f else 0, len(f[2]) if f else 0, sum(x.values()), sum(n for k, n in x.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in x.items()), sha(text) if text else ""))
    return sorted(out, key=repr)


ODD = list("ab cdE'slltT .,\n\t\r    é中文😀▁\x00\x1c\x85<|endoftext|>1234  ﬁ́᠎　")


@pytest.fixture(scope="module")
def texts():
    random.seed(9)
    words = "the of and Über naïve can't 2024 3.14 token tokens tokenizer  \n <|endoftext|> </s>".split(" ")
    rows = [(d, " ".join(random.choice(words) for _ in range(random.randint(1, 40)))) for d in range(80)]
    rows += [(100 + d, "".join(random.choice(ODD) for _ in range(random.randint(0, 30)))) for d in range(300)]
    return rows + [(None, "null key"), (500, None), (501, ""), (502, "a" * 3000), (503, rows[0][1]), (503, rows[0][1]), (504, "▁ has no bytes of its own"), (505, "中" * 400)]


def test_alignment_against_brute_force(spark, texts):
    e = token_align.encoders("byte_bpe_50k.json", "piece_bpe_32k.model")
    df = spark.createDataFrame(texts, DOCS).withColumns({"key": F.lit(1), "row": F.lit(2)})
    want = alignment_brute(e, texts)
    assert sorted([tuple(r) for r in token_align.align_documents(df).collect()], key=repr) == want
    # several shards and several rounds of lookups
    assert sorted([tuple(r) for r in token_align.align_documents(df, range_keys=300, shard_keys=100).collect()], key=repr) == want


def test_queries_over_whole_tables(spark, texts, tmp_path):
    e = token_align.encoders("byte_bpe_50k.json", "piece_bpe_32k.model")
    rows = [(d, t) for d, t in texts if d is not None][-60:]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted([tuple(r) for r in token_align.op12_token_align(spark, str(tmp_path)).collect()], key=repr) == alignment_brute(e, rows)
    assert sorted([tuple(r) for r in line_dedup.op11_line_dedup(spark, str(tmp_path)).collect()], key=repr) == lines_brute(rows)


def test_alignment_of_no_rows_and_no_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert sorted(tuple(r) for r in token_align.align_documents(df).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert token_align.align_documents(df.filter("false")).collect() == []


def test_long_groups_and_pieces(texts, monkeypatch):
    e = token_align.encoders("byte_bpe_50k.json", "piece_bpe_32k.model")
    monkeypatch.setattr(token_align, "_LISTED", 1)
    rows = [t for _, t in texts if t]
    ids = [[np.frombuffer(x, "<u2").astype(np.int64) for x in z] for z in e.encode(rows)]
    bounds = [np.concatenate([[0], np.cumsum([len(z[k]) for z in ids])]) for k in (0, 1)]
    x = token_align.align(np.concatenate([z[0] for z in ids]), bounds[0], np.concatenate([z[1] for z in ids]), bounds[1], *e.lengths)
    for d, text in enumerate(rows):
        f = document_brute(e, text)
        links = Counter((p << 16) | q for a, b in (f[2] if f else []) for p in a for q in b)
        assert dict(zip(x.key[x.doc == d].tolist(), x.number[x.doc == d].tolist(), strict=True)) == links


def test_a_long_text_is_encoded_like_the_library_does():
    e = token_align.encoders("byte_bpe_50k.json", "piece_bpe_32k.model")
    text = "Some words, ßome numbers 12 34.\n  And  blanks\t\n" * 25_000 + "ab" * 5_000
    (a, b), = e.encode([text])
    assert np.frombuffer(a, "<u2").tolist() == e.a.encode(" " + text, add_special_tokens=False).ids
    assert np.frombuffer(b, "<u2").tolist() == e.b.encode(text)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 32, n, np.uint32))
        h = token_align.PerfectHash.unpack(token_align.PerfectHash.build(keys).pack())
        assert sorted(h.index(keys).tolist()) == list(range(len(keys))) and h.n == len(keys)
    assert len(h.pack()) * 8 < 5 * len(keys)
