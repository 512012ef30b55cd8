"""Every query of the corpus operators, on small tables in a folder, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from logloom.llm import queries

BLANKS = " \t\n\x0b\x0c\r"


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def words_of(text, blanks=BLANKS):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in blanks:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def held(i):
    return i is not None and crc(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, leaks, toxic words, nulls, empty texts, a text over 1 MB and clashing columns."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [say(rng.randint(14, 30)) for _ in range(12)] + ["too short", None, "!!"]
    passage = say(60)
    texts = []
    for i in range(260):
        t = say(rng.randint(30, 120))
        if i % 4 == 0:
            t += " vileword nastyword " + say(5)
        if i % 9 == 0:
            t += " " + items[i % 12] + " " + say(4)
        if i % 20 == 0:
            t = say(20) + " " + passage + " " + say(20)
        if i % 13 == 0:
            t = " ".join([say(6)] * 12)
        texts.append(t)
    texts += [texts[3]] * 5 + [texts[7].upper(), texts[7] + " more", None, "", " \n ", "one two", "one two", "x" * 130, "é" * 120, (say(60) + "\n") * 3, say(190_000)]
    sf = str(tmp_path_factory.mktemp("tables"))
    documents = [(i, t, "en", "web", len(t or ""), "r", "k", 0.5, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, score double, shard int").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels = [(i, int(len(set((t or "").split())) > 20), int("vileword" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://b.net/fr/", None, "none", "http://b.net/fr/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{sf}/pages.parquet")
    return sf, texts, items


def rows_of(spark, name, sf):
    return queries.QUERIES[name](spark, sf).collect()


def test_op1(spark, tables):
    sf, texts, _ = tables
    got = rows_of(spark, "op1_sharding", sf)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len((t or "").encode()) + 1, crc((t or "").encode()), "rows", None) for i, t in enumerate(texts)}
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(texts) and set(shards) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["shard"]))]
    assert sum(abs(a - b) < 3 for a, b in zip(order, order[1:])) < len(order) / 10


def test_op2(spark, tables):
    sf, texts, _ = tables
    got = {r["doc_id"]: r for r in rows_of(spark, "op2_toxicity", sf)}
    assert len(got) == len(texts) and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    fifth = [i for i in got if held(i)]
    assert sum(got[i]["predicted"] == int("vileword" in (texts[i] or "")) for i in fifth) >= 0.95 * len(fifth)


def test_op3(spark, tables):
    sf, texts, _ = tables
    got = {r["doc_id"]: tuple(r)[1:] for r in rows_of(spark, "op3_suffix_dedup", sf)}
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                mark[p : p + 100] = b"\x01" * 100
            seen.add(s)
        runs = len([r for r in bytes(mark).split(b"\x00") if r])
        expected[i] = (len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    assert got == expected


def test_op4(spark, tables):
    sf, texts, _ = tables
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_quality_rules", sf)}
    for i, t in enumerate(texts):
        t = t or ""
        w = words_of(t)
        lines = [x for x in t.split("\n") if words_of(x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times = Counter(windows)
        repeat = len({k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(5)})
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed)
        assert r["kept"] == (not failed and r["rule"] is None)
    assert len(got) == len(texts)


def test_op5(spark, tables):
    sf, texts, _ = tables
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for t in texts:
        w = words_of(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(texts)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(spark, "op5_ngram_join", sf)}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_op6(spark, tables):
    sf, texts, items = tables

    def tokens(t):
        out, word = [], ""
        for c in (t or "") + " ":
            if ord(c) > 127 or c.isalnum():
                word += c.lower() if "A" <= c <= "Z" else c
            else:
                out += [word] if word else []
                word = ""
        return out

    windows = {}
    for k, b in enumerate(items):
        v = tokens(b)
        for p in range(max(1, len(v) - 9) if v else 0):
            windows.setdefault(tuple(v[p : p + 10]), set()).add(k)
    sizes = {len(x) for x in windows}
    got = {r["doc_id"]: tuple(r)[1:] for r in rows_of(spark, "op6_decontamination", sf)}
    for i, t in enumerate(texts):
        w = tokens(t)
        mark, hit = [0] * len(w), set()
        for n in sizes:
            for q in range(len(w) - n + 1):
                if found := windows.get(tuple(w[q : q + n])):
                    mark[q : q + n] = [1] * n
                    hit |= found
        assert got[i] == (len(w), sum(mark), len(hit), hashlib.sha256(",".join(sorted(map(str, hit))).encode()).hexdigest(), any(mark))
    assert len(got) == len(texts)


def test_op7(spark, tables):
    sf, _, _ = tables
    got = {r["page_id"]: tuple(r)[1:] for r in rows_of(spark, "op7_url_filter", sf)}
    assert got == {0: ("a.com", "/x", "com/", "allow"), 1: ("example.com", "/en/1", "example.com/en/", "block"), 2: ("b.net", "/fr/", "net/fr/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("b.net", "/fr/", "net/fr/", "block")}


def test_op8(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf, texts, _ = tables
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    got, ends, places = rows_of(spark, "op8_packing", sf), [0] * len(texts), {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == ends[r["doc_id"]] and r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == crc(b"".join(x.to_bytes(4, "little") for x in own[r["start"] : r["start"] + r["length"]]))
        ends[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert ends == [len(x) for x in ids]
    for x in places.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    assert len(places) <= sum(ends) / 4096 + 2


def test_op9(spark, tables):
    sf, texts, _ = tables
    got = rows_of(spark, "op9_token_output", sf)
    back = {}
    for r in got:
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            back.setdefault(d, {})[s] = bytes(r["input_ids"])[2 * a : 2 * b]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, x in enumerate(texts):
        assert b"".join(back[i][s] for s in sorted(back[i])) == b"".join(k.to_bytes(2, "little") for k in [*t.encode(x or "", add_special_tokens=False).ids, 49407])
    assert len(back) == len(texts)


def test_op10(spark, tables):
    sf, texts, _ = tables
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_lm_scoring", sf)}
    assert {i: r["n_words"] for i, r in got.items()} == {i: len(words_of(t)) for i, t in enumerate(texts)}
    assert all(r["log_likelihood"] < 0 if r["n_words"] else r["log_likelihood"] == 0 for r in got.values())


def test_empty_tables(spark, tables, tmp_path):
    sf, _, _ = tables
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").filter("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_no_labels_and_no_items(spark, tables, tmp_path):
    sf, texts, _ = tables
    for t in ("documents", "benchmark", "labels"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (df if t == "documents" else df.filter("false")).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert {r["n_hit"] for r in rows_of(spark, "op6_decontamination", str(tmp_path))} == {0}
    assert {r["rule"] for r in rows_of(spark, "op4_quality_rules", str(tmp_path))} == {None}
    assert len({r["score"] for r in rows_of(spark, "op2_toxicity", str(tmp_path))}) == 1
