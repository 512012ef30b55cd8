"""The pipeline's stages against brute force, with null texts, repeated rows and clashing columns."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import common, toxicity

SCHEMA = "doc_id bigint, text string, n_chars bigint, row string, key string, score double, spans string"


def without_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted({(r["doc_id"], r["text"]) for r in rows}):
        b = (t or "").encode()
        mark = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        out[i] = bytes(x for x, m in zip(b, mark) if not m).decode("utf-8", "ignore")
    return out


def windows(text):
    w = (text or "").split()
    return {tuple(w[k : k + 10]) for k in range(len(w) - 9)}


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(n))
    passage, leak = say(40), say(15)
    texts = [say(80) + (" vileword" * 3 if i % 4 == 0 else "") for i in range(200)]
    texts += [say(30) + " " + passage + " é " + say(30) for _ in range(5)] + [say(30) + " " + leak + " " + say(30) for _ in range(4)] + [texts[1], ""]
    rows = [(i, t, len(t), f"r{i}", "k", 0.5, "s") for i, t in enumerate(texts)] + [(1000, None, None, None, None, None, None)]
    rows += [rows[2]]  # a row repeated whole
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("vileword" in t)) for i, t in enumerate(texts)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak), (1, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def after(name, given):
        out = stages[name](spark, given, sf)
        assert out.columns == docs.columns
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        return got, spark.createDataFrame(got, docs.schema)

    clean, _ = after("toxicity", docs)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    low = {r["doc_id"] for r in scored if r["score"] < 0.5}
    assert clean == sorted((r for r in rows if r[0] in low), key=repr) and 0 < len(clean) < len(rows)

    cut, _ = after("repeated_passages", docs)
    kept = without_repeats(docs.collect())
    assert cut == sorted(((r[0], kept[r[0]], len(kept[r[0]]), *r[3:]) for r in rows), key=repr)

    left, _ = after("decontamination", docs)
    assert left == sorted((r for r in rows if not windows(r[1]) & windows(leak)), key=repr) and len(left) == len(rows) - 4

    data = docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        _, data = after(name, data)
    # where pieces are cut depends on the tasks; the tokens of each document don't
    whole = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())
    got = whole(corpus_pipeline.run(spark, sf))
    assert got == whole(stages["packing"](spark, data, sf)) and all(n == m for _, n, m in got)
    assert {i for i, _, _ in got} == {r["doc_id"] for r in data.collect()}


def test_near_duplicates_hold_copies_once(spark, monkeypatch):
    """Copies under keys of their own and rows repeated whole, in all tasks, have one set and one bitmap."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(n))
    texts = [say(60) for _ in range(6)]
    texts.append(texts[0] + " end")
    counts, write = {}, common.Staging.write

    def counted(self, df, name, **k):
        out = write(self, df, name, **k)
        counts[name] = out.count() if name in ("bits", "sets") else 0
        return out

    monkeypatch.setattr(common.Staging, "write", counted)
    for shift in (7, 0):
        rows = [(shift * k + i, t, len(t), "r", "k", 0.5, "s") for k in range(8) for i, t in enumerate(texts)]
        out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA).repartition(5), "")
        assert sorted(tuple(r) for r in out.collect()) == rows[:6]
        assert (counts["bits"], counts["sets"]) == (7, 2)
