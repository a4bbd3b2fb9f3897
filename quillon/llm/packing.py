"""Cost-balanced packing of documents into training sequences.

A piece of L tokens costs ``LINEAR * L + QUADRATIC * L * L`` (projections, and attention within the document). Every map
task packs windows of its own documents, so nothing is shuffled and a window's memory is bounded by bytes of text, not by
rows, keys or sources. In a window each document first gives off its full sequences. The tails, longest first, go to the
sequence of lowest cost that has room for the whole; only where none has, a tail is cut, at the cheapest. A window opens as many full sequences as its tokens fill; the rest, the end of its shortest tails, goes to the task's
next window. The rest of a task's last window goes to sequences whose lengths are the powers of two that sum to it. So
every sequence is exactly full or a power of two, at most eleven of a task are short, and none needs padding.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import loaded, slices, with_end
from .shared import map_batches, read_table

SEQUENCE, END_ID = 2048, 1
#: Cost per token and per token pair, in units of a token's projections.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Sequences that one task can number.
PER_TASK = 1 << 36
_NONE = (float("inf"), -1)


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Cheapest:
    """Sequences by free tokens, each number of free tokens with a heap of (cost, sequence), under a tree of minima."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least: list[tuple[float, int]] = [_NONE] * (2 * self.size)

    def _renew(self, free: int) -> None:
        k = self.size + free
        self.least[k] = self.heaps[free][0] if self.heaps[free] else _NONE
        while k > 1:
            k >>= 1
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def add(self, free: int, used: float, i: int) -> None:
        heapq.heappush(self.heaps[free], (used, i))
        if self.heaps[free][0] == (used, i):
            self._renew(free)

    def find(self, need: int) -> int:
        """The sequence of lowest cost among those with ``need`` free tokens or more; -1 where there is none."""
        k = self.size + need
        best = self.least[k]
        while k > 1:
            if not k & 1:
                best = min(best, self.least[k + 1])
            k >>= 1
        return best[1]

    def take(self, free: int) -> None:
        """Removes the cheapest sequence of ``free`` free tokens."""
        heapq.heappop(self.heaps[free])
        self._renew(free)


def assign(lengths: np.ndarray, sequence: int = SEQUENCE, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of a window as rows, and each sequence's cost.

    ``lengths``: tokens of each document; zero gives no piece. Ties go to the earlier document and sequence. Where the
    window is not the ``last``, there are full sequences only, and what they cannot hold has no piece.
    """
    rows, costs = [], []
    for d in np.flatnonzero(lengths >= sequence):
        for k in range(int(lengths[d]) // sequence):
            rows.append((d, k * sequence, sequence, len(costs), 0))
            costs.append(cost(sequence))
    tails = lengths % sequence
    total = int(tails.sum())
    room = [sequence] * (total // sequence) + [1 << b for b in reversed(range(sequence.bit_length())) if last and total % sequence >> b & 1]
    first, full = len(costs), total // sequence
    free, used = list(room), [0.0] * len(room)
    # the short sequences take what no full one can hold
    large, small = Cheapest(sequence), Cheapest(sequence)
    for i, n in enumerate(room):
        (large if i < full else small).add(n, 0.0, i)
    for d in np.argsort(-tails, kind="stable"):
        left, at = int(tails[d]), int(lengths[d] - tails[d])
        if not left:
            break
        while left:
            i = next((i for x, need in ((large, left), (small, left), (large, 1), (small, 1)) if (i := x.find(need)) >= 0), -1)
            if i < 0:
                break
            n = min(left, free[i])
            rows.append((d, at, n, first + i, room[i] - free[i]))
            among = large if i < full else small
            among.take(free[i])
            free[i] -= n
            used[i] += cost(n)
            at, left = at + n, left - n
            if free[i]:
                among.add(free[i], used[i], i)
    return np.array(rows, np.int64).reshape(-1, 5), np.array(costs + used)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost and, with
    ``with_ids``, the piece's ids.

    Every row counts as a document: a null or empty text is its end id alone, repeated rows are packed each, a null id
    is carried. Ties in length keep the order of the rows. A document longer than a window is a window of its own. An
    empty table gives no rows. Sequence ids are unique, not without gaps. Other columns are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        bpe, base = loaded(tokenizer), TaskContext.get().partitionId() * PER_TASK
        # tokens that go to the next window: documents, tokens before them, tokens, all tokens of the document, ids
        carried = None

        def window(docs, before, counts, doc_tokens, ids, last):
            nonlocal base, carried
            begins = np.cumsum(counts) - counts
            rows, costs = assign(counts, sequence, last)
            d, start, length, seq, offset = rows.T
            at = begins[d] + start
            flat = memoryview(ids.astype("<u4")).cast("B")
            columns = [
                docs.take(pa.array(d)),
                pa.array(before[d] + start),
                pa.array(length),
                pa.array([zlib.crc32(flat[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
                pa.array(doc_tokens[d]),
                pa.array(base + seq),
                pa.array(offset),
                pa.array(costs[seq]),
            ]
            if with_ids:
                whole = ids[np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(whole.astype(np.int32))))
            base += len(costs)
            done = np.bincount(d, length, len(counts)).astype(np.int64)
            rest = np.flatnonzero(done < counts)
            n = (counts - done)[rest]
            own = np.repeat(begins[rest] + done[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            carried = (docs.take(pa.array(rest)), (before + done)[rest], n, doc_tokens[rest], ids[own])
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches):
            ids, counts = with_end(*bpe.encode(batch.column(1)), end_id)
            new = (batch.column(0), np.zeros(len(counts), np.int64), counts, counts, ids)
            if carried:
                new = (pa.concat_arrays([carried[0], new[0]]), *(np.concatenate(x) for x in zip(carried[1:], new[1:], strict=True)))
            yield window(*new, last=False)
        if carried and len(carried[0]):
            yield window(*carried, last=True)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double" + ", ids array<int>" * with_ids
    names = [c.split(" ")[0] for c in schema.split(", ")]
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(docs, "byte-bpe", run, schema)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
