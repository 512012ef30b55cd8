"""Token-id output: best-fit-decreasing packing with a segment tree over remaining capacities.

Each task packs the documents of one stretch of its input at a time: pieces go, longest
first, to the open sequence with the least room that still fits. The tree's leaves are
room sizes and its inner nodes count the open sequences below, so the search takes a
step for each level. Overlong documents are split into whole windows and a rest. The
emptiest sequences of a stretch are packed again with the next one, so that only a task's
last stretch leaves part-empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_buffers
from .tokens import table

#: Tokens that are packed together, about; memory and the best fit's reach grow with it.
STRETCH = 4 << 20
#: Fills sequences up; beyond all token ids.
PAD = 65535


class RoomTree:
    """Open sequences by the room they have left."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()  # leaves 0 .. window
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Take out the sequence with the least room of at least ``need``: (room, sequence)."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = self.open[room].pop()
        self._add(room, -1)
        return room, sequence


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """The sequence of each piece and how many there are."""
    tree, out, n = RoomTree(window), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room, sequence = tree.best(need) or (window, n)
        n += sequence == n
        out[k] = sequence
        if room > need:
            tree.push(room - need, sequence)
    return out, n


def packed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, tokenizer: str = "word_bpe_49k.json", end: int = 49407, pad: int = PAD, stretch: int = STRETCH) -> DataFrame:
    """One row for each packed sequence.

    ``task``, ``sequence``: its name; ``input_ids``: ``window`` 16-bit little-endian ids, padded
    with ``pad``, which no text makes; ``cu_seqlens``: where segments begin, and the end of the
    last; ``resets``: the places at which position ids begin again at 0, which are those of
    segments and of the padding, if any; ``doc_ids`` and ``doc_starts``: the document of each
    segment and the ids before it there. A document is its text's ids and ``end``; null and
    empty texts are ``end`` alone. Joining a document's segments by ``doc_starts`` gives it back
    whole. Rows that repeat a key or a whole row, and rows without a key, are packed each for
    itself; other columns aren't looked at. An empty table gives no rows.
    """

    def pack(names: pa.Array, pieces: list[tuple[bytes, int]], first: int, last: bool) -> tuple[pa.RecordBatch, pa.Array, list[tuple[bytes, int]]]:
        """The sequences, without the emptiest ones if more text follows: their pieces are packed again with it."""
        sizes = np.array([len(x) // 2 for x, _ in pieces], np.int64)
        into, n = best_fit(sizes, window)
        filled = np.bincount(into, sizes, n).astype(np.int64)
        emptiest = np.argsort(filled, kind="stable")
        again = np.zeros(n, bool)
        again[emptiest] = (np.cumsum(filled[emptiest]) <= stretch // 4) & (filled[emptiest] < window) & (not last)
        number = np.cumsum(~again) - 1
        back = np.flatnonzero(again[into])
        order = np.argsort(into, kind="stable")
        order = order[~again[into[order]]]
        n = int((~again).sum())
        matrix = np.full((n, window), pad, "<u2")
        at, cu, who, began = [0] * n, [[0] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
        for k in order.tolist():
            s, (x, start) = int(number[into[k]]), pieces[k]
            size = len(x) // 2
            matrix[s, at[s] : at[s] + size] = np.frombuffer(x, "<u2")
            at[s] += size
            cu[s].append(at[s])
            who[s].append(k)
            began[s].append(start)
        flat = np.concatenate([np.asarray(x, np.int64) for x in who]) if n else np.zeros(0, np.int64)
        cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in who])]).astype(np.int32))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, TaskContext.get().partitionId() if TaskContext.get() else 0), pa.int64()),
                pa.array(np.arange(first, first + n), pa.int64()),
                pa.array([r.tobytes() for r in matrix], pa.binary()),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([x if x[-1] < window else x[:-1] for x in cu], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(cut, names.take(pa.array(flat))),
                pa.array(began, pa.list_(pa.int64())),
            ],
            ["task", "sequence", "input_ids", "cu_seqlens", "resets", "doc_ids", "doc_starts"],
        )
        return out, names.take(pa.array(back)), [pieces[k] for k in back.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, done = table(tokenizer), 0
        names, pieces, held = [], [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets):
                flat, bounds = t.ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                owner = []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for s in range(a, b, window):
                        owner.append(i + k)
                        pieces.append((flat[s : min(s + window, b)].astype("<u2").tobytes(), s - a))
                names.append(batch.column(0).take(pa.array(owner, pa.int64())))
                held += len(flat)
                if held >= stretch:
                    out, left, pieces = pack(pa.concat_arrays(names), pieces, done, False)
                    done, names, held = done + out.num_rows, [left], sum(len(x) for x, _ in pieces) // 2
                    yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))
        if pieces:
            out, _, _ = pack(pa.concat_arrays(names), pieces, done, True)
            yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"task bigint, sequence bigint, input_ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, doc_starts array<bigint>")


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed sequences as Parquet: a matrix row of ids, its segment bounds and position resets in each row."""
    packed_rows(docs, **options).write.parquet(path)


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    return packed_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
