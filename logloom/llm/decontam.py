"""Benchmark decontamination with a distributed positional inverted index.

The index is a table: for every block of training documents and every term in it the places
where the term stands, as differences; and for every block its documents. It is written
once, and any number of benchmarks is looked up in it without reading a text again. Blocks
spread each term, so a frequent one is no task's burden. An index that is written to a path
of the caller's stays there, and any later application opens it.

A benchmark window starts from the places of the term that is rarest over all training
tokens, shifted by the term's offset, and is intersected with the places of its other terms,
rarer ones first. Only lists of terms that a benchmark has are fetched, and none for windows
whose rarest term never occurs; a block looks at the windows of its own rarest terms alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Staging, byte_table, hash_spans, keyed_schema, row_chunks, row_keys, signed, text_buffers, whole_row, word_spans

#: Windows that are broadcast at once; a larger benchmark is looked up in parts.
BLOCK_WINDOWS = 200_000
#: Words are runs of ASCII letters, digits and bytes beyond ASCII.
WORD = byte_table([b for b in range(128) if not chr(b).isalnum()])
#: Text bytes of a block of the index; a longer text is a block of its own.
INDEX_BLOCK = 4 << 20
#: Candidate places that one step of an intersection holds, about.
_CANDIDATES = 1 << 22


# ---------------------------------------------------------------- the index


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, term, n, places, docs): one for each term of a block, and one of null term for its documents and their first words."""
    task, turn = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in row_chunks(offsets, INDEX_BLOCK):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, firsts = word_spans(part, bounds, WORD)
            words = hash_spans(LOWER[part], starts, ends)
            order = np.argsort(words, kind="stable")
            run = words[order]
            begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
            steps = np.diff(order, prepend=0)
            steps[begin] = order[begin]
            cut = np.append(begin, len(run)).astype(np.int32)
            block = (task << 32) + turn
            turn += 1
            n = len(begin)
            places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(4 * cut), pa.py_buffer(steps.astype("<u4").tobytes())])
            docs = pa.StructArray.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(firsts), pa.int64())], ["key", "n_words"])
            docs = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), docs)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.int64()), pa.array([j - i], pa.int32()), pa.array([firsts.astype("<u4").tobytes()], pa.binary()), docs], ["block", "term", "n", "places", "docs"])
            for a in range(0, n, 50_000):
                b = min(a + 50_000, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, block)), pa.array(signed(run[begin[a:b]])), pa.array(np.diff(cut[a : b + 1]), pa.int32()), places.slice(a, b - a), pa.nulls(b - a, docs.type)], ["block", "term", "n", "places", "docs"])


class PositionalIndex:
    """The postings of all tokens of ``docs``, written to a table.

    ``key`` may be of any type, null or repeated: every row is a document of its own. A
    null text has no words. Other columns aren't looked at. With ``path``, which must not
    exist, the table is written there and stays; otherwise it goes with the application.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None):
        self.key = key
        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        own = T.ArrayType(keyed_schema(rows, "key", "n_words bigint"))
        schema = T.StructType([*T.StructType.fromDDL("block bigint, term bigint, n int, places binary").fields, T.StructField("docs", own)])
        postings = rows.mapInArrow(_postings, schema)
        if path is None:
            self.table = Staging(docs.sparkSession, "postings").write(postings, "index", codec="zstd")
        else:
            postings.write.option("compression", "zstd").parquet(path)
            self.table = docs.sparkSession.read.schema(schema).parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str = "doc_id") -> PositionalIndex:
        """The index that was written to ``path``; searches name the documents' ids ``key``."""
        index = cls.__new__(cls)
        index.key, index.table = key, spark.read.parquet(path)
        return index

    def search(self, benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = 10, slop: int = 0, block: int = BLOCK_WINDOWS) -> DataFrame:
        """For every document: ``n_words``, ``spans`` (runs of hit words) and ``items`` (ids of items that occur, sorted as text).

        An item of fewer words than ``width`` is one window; one without words has none; a null
        id counts as the empty string; items of one id are one. An empty benchmark hits
        nothing. With ``slop`` 0 matches are exact phrases. Otherwise a window also matches at a
        place from which each of its terms stands at most so many words off; the words from that
        place on, as many as the window has, are hit.
        """
        tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        words = tests.agg(F.coalesce(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))), F.lit(0))).first()[0]
        parts = max(1, -(-words // block))
        found = None
        for b in range(parts):
            own = tests if parts == 1 else tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == b)
            one = self._hits(Windows([tuple(r) for r in own.collect()], width), slop)  # about ``block`` words
            found = one if found is None else found.unionByName(one)
        if parts > 1:
            found = _merged(found)
        docs = self.table.filter("term is null").select("block", F.posexplode("docs").alias("row", "doc")).select("block", "row", "doc.*")
        none = F.array().cast("array<struct<first:bigint,end:bigint>>")
        out = docs.join(found, ["block", "row"], "left")
        return out.select(F.col("key").alias(self.key), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def _hits(self, windows: Windows, slop: int) -> DataFrame:
        """(block, row, spans, items) of the documents in which a window occurs."""
        spark = self.table.sparkSession
        terms = lambda hashes: F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(signed(hashes), pa.int64()), "number": pa.array(np.arange(len(hashes), dtype=np.int32))})))  # noqa: E731  at most a block's words
        lists = self.table.filter("term is not null")
        if len(windows.vocabulary):
            counts = lists.select("term", "n").join(terms(windows.vocabulary), "term").groupBy("number").agg(F.sum("n").alias("n")).collect()
            windows.rank({r["number"]: r["n"] for r in counts})
        wanted = lists.join(terms(windows.vocabulary), "term").select("block", "number", "n", "places") if len(windows.vocabulary) else lists.filter("false").select("block", F.lit(0).alias("number"), "n", "places")
        rows = wanted.unionByName(self.table.filter("term is null").select("block", F.lit(-1).alias("number"), "n", "places"))
        shared = spark.sparkContext.broadcast(windows)  # BLOCK_WINDOWS windows, about

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                table = pa.concat_tables(held)
                b = table["block"].to_numpy()
                done = 0
                for cut in (np.flatnonzero(np.diff(b)) + 1).tolist():
                    yield shared.value.of_block(table.slice(done, cut - done), slop)
                    done = cut
                held = [table.slice(done)]
            if held and held[0].num_rows:
                yield shared.value.of_block(pa.concat_tables(held), slop)

        # a block's lists together: the row of null term comes first
        sorted_ = rows.repartition("block").sortWithinPartitions("block", "number")
        return sorted_.mapInArrow(run, "block bigint, row int, spans array<struct<first:bigint,end:bigint>>, items array<string>")


def _merged(found: DataFrame) -> DataFrame:
    """One row for each document from the finds of several parts of a benchmark."""
    flat = found.groupBy("block", "row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    join = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["first"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    return flat.withColumn("spans", F.when(F.size("spans") > 0, F.aggregate("spans", none, join)).otherwise(none))


# ---------------------------------------------------------------- windows


class Windows:
    """Distinct windows of benchmark items: term numbers (rows padded by -1), lengths, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        texts = pa.array([t for _, t in items], pa.string())
        data, offsets = text_buffers(texts)
        starts, ends, firsts = word_spans(data, offsets, WORD)
        words = hash_spans(LOWER[data], starts, ends)
        self.vocabulary, terms = np.unique(words, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        for (name, _), a, b in zip(items, firsts[:-1], firsts[1:], strict=True):
            own = terms[a:b]
            for i in range(max(1, len(own) - width + 1) if len(own) else 0):
                found.setdefault(tuple(own[i : i + width].tolist()), set()).add(name)
        self.terms = np.full((len(found), width), -1, np.int32)
        for k, w in enumerate(found):
            self.terms[k, : len(w)] = w
        self.lengths = (self.terms >= 0).sum(1)
        self.items = [sorted(x) for x in found.values()]
        self.order = np.argsort(self.terms < 0, axis=1, kind="stable")

    def rank(self, counts: dict[int, int]) -> None:
        """Order each window's terms by their counts over all training tokens; windows with a term that never occurs go."""
        total = np.zeros(len(self.vocabulary), np.int64)
        total[list(counts)] = list(counts.values())
        sizes = np.where(self.terms >= 0, total[np.maximum(self.terms, 0)], np.iinfo(np.int64).max)
        live = np.flatnonzero(sizes.min(1, initial=np.iinfo(np.int64).max) > 0) if len(sizes) else np.zeros(0, np.int64)
        used = np.unique(self.terms[live][self.terms[live] >= 0])
        number = np.full(len(self.vocabulary) + 1, -1, np.int32)
        number[used] = np.arange(len(used))
        self.vocabulary = self.vocabulary[used]
        order = np.argsort(sizes[live], axis=1, kind="stable")
        # windows stand together by their rarest terms, so that a block looks its own up
        lead = number[self.terms[live, order[:, 0]]]
        by = np.argsort(lead, kind="stable")
        live, self.order = live[by], order[by]
        self.first = np.searchsorted(lead[by], np.arange(len(used) + 1))
        self.terms, self.lengths, self.items = number[self.terms[live]], self.lengths[live], [self.items[k] for k in live.tolist()]

    def occurrences(self, numbers: np.ndarray, sizes: np.ndarray, places: np.ndarray, owner: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first word) of every occurrence, some windows at a time, from the lists of a block."""
        n = len(owner)
        if not len(self.lengths) or not len(numbers):
            return
        lists, begin = np.zeros(len(self.vocabulary), np.int64), np.zeros(len(self.vocabulary), np.int64)
        lists[numbers], begin[numbers] = sizes, np.cumsum(sizes) - sizes
        term = np.full(n, -1, np.int32)  # which list each place is on
        term[places] = np.repeat(numbers, sizes)
        most = self.first[numbers + 1] - self.first[numbers]
        live = np.repeat(self.first[numbers] - (np.cumsum(most) - most), most) + np.arange(most.sum())
        own = self.terms[live]
        live = live[((lists[np.maximum(own, 0)] > 0) | (own < 0)).all(1)]
        offset = self.order[live, 0]
        lead = self.terms[live, offset]
        shifts = np.arange(-slop, slop + 1)
        ends = np.cumsum(lists[lead] * len(shifts))
        for a, b in row_chunks(np.concatenate([[0], ends]), _CANDIDATES):
            counts = lists[lead[a:b]]
            window = np.repeat(np.arange(a, b), counts)
            within = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = places[begin[lead[window]] + within] - offset[window]
            if slop:
                base = self.terms.shape[1] + slop
                wide = n + 2 * base
                both = np.unique((window[:, None] * wide + start[:, None] + shifts + base).ravel())
                window, start = both // wide, both % wide - base
            last = self.lengths[live[window]] - 1
            ok = (start >= 0) & (start + last < n)
            window, start, last = window[ok], start[ok], last[ok]
            ok = owner[start] == owner[start + last]
            window, start = window[ok], start[ok]
            for step in range(0 if slop else 1, self.terms.shape[1]):
                off = self.order[live[window], step]
                need = self.terms[live[window], off]
                ok = need < 0  # beyond a short window
                for d in shifts:
                    at = start + off + d
                    inside = np.clip(at, 0, n - 1)
                    ok |= (term[inside] == need) & (at == inside) & (owner[inside] == owner[start])
                window, start = window[ok], start[ok]
            yield live[window], start

    def of_block(self, table: pa.Table, slop: int) -> pa.RecordBatch:
        """The finds of one block: its first row has the documents' first words, the others the terms' places."""
        table = table.combine_chunks()
        numbers, sizes = table["number"].to_numpy()[1:], table["n"].to_numpy()[1:].astype(np.int64)
        firsts = np.frombuffer(table["places"][0].as_py(), "<u4").astype(np.int64)
        steps = np.frombuffer(text_buffers(table["places"].slice(1))[0].tobytes(), "<u4").astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(steps)])
        places = sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
        rows = len(firsts) - 1
        owner = np.repeat(np.arange(rows), np.diff(firsts))
        marks = np.zeros(len(owner) + 1, np.int64)
        names: list[set[str]] = [set() for _ in range(rows)]
        for window, start in self.occurrences(numbers, sizes, places, owner, slop):
            np.add.at(marks, start, 1)
            np.add.at(marks, start + self.lengths[window], -1)
            both = np.unique(owner[start] * np.int64(len(self.lengths)) + window)
            for x in both.tolist():
                names[x // len(self.lengths)].update(self.items[x % len(self.lengths)])
        spans = _spans(np.cumsum(marks)[:-1] > 0, firsts)
        hit = pa.array([k for k, x in enumerate(names) if x], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), table["block"][0].as_py(), np.int64)), hit, spans.take(hit), pa.array([sorted(x) for x in names if x], pa.list_(pa.string()))], ["block", "row", "spans", "items"])


def _spans(marks: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Runs of marked words of each row, counted from the row's first word."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    # a run over the border of rows is one of each
    cut = firsts[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(marks))])
    cut = cut[marks[cut] & marks[cut - 1]] if len(cut) else cut
    begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    row = np.searchsorted(firsts, begin, "right") - 1
    base = firsts[row]
    per = np.searchsorted(begin, firsts).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], ["first", "end"]))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, slop: int = 0, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``n_words``, ``spans`` and ``items`` of every document, by an index made for this benchmark alone; see ``PositionalIndex``."""
    return PositionalIndex(docs, key, text).search(benchmark, item, item_text, width, slop, block)


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, in which no benchmark window occurs; rows repeated whole go or stay together."""
    rows = docs.select(whole_row(docs).alias("_row"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    keyed, _ = row_keys(rows, "_key", "_text")
    found = contamination(keyed, benchmark, "_rid", "_text", **options).filter(F.size("spans") > 0)
    # what is found grows with the corpus: the same join at any size
    return keyed.hint("merge").join(found.select("_rid").distinct().hint("merge"), "_rid", "left_anti").select("_row.*")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["first"])
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
