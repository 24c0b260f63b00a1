"""Packing tokens into sequences of at most 1024 by multiway differencing.

Each document's ids fill sequences of their own as far as they go; the remainders, cut into pieces of
at most ``PIECE`` ids, are shared out over windows. Karmarkar-Karp differencing starts from one
partial partition per piece and merges the two with the largest imbalance, the fullest window of one
with the emptiest of the other, until one partition is left whose windows are nearly equal. Their
number starts at the least that can hold the ids and rises whenever a window exceeds the capacity.

Windows are filled from the documents of one scan task, ``WINDOWS`` of them at a time, so nothing is
shuffled, memory is bounded and a lost task gives the same sequences again. Sequence ids are
unique over all tasks and stable for a given layout of the input.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are packed each for
itself, and a piece's ids always come from one row; an empty table gives an empty result; a very long
text fills many sequences; other columns of the input take no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import small_batches, whole_text
from hexloom.llm.tokens import Encoder, library

CAPACITY = 1024
PIECE = 256
WINDOWS = 256
END = 0
#: Ids left free in each window on average, so that near-equal windows rarely exceed the capacity.
MARGIN = 2

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in each of ``windows`` nearly equal windows."""
    if windows == 1:
        return [list(range(len(sizes)))]
    # A partial partition holds its window sums, largest first, less the smallest; a merge notes how
    # the windows of both parts are paired.
    heap, merges = [], {}
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        merges[new] = (a, b, order)
        heapq.heappush(heap, (-int(sums[0]), new, sums))
        new += 1
    out: list[list[int]] = [[] for _ in range(windows)]
    todo = [(heap[0][1], np.arange(windows))] if heap else []
    while todo:
        node, place = todo.pop()  # place[i]: final window of the node's i-th window
        if node < len(sizes):
            out[place[0]].append(node)
            continue
        a, b, order = merges.pop(node)
        own = np.empty(windows, np.int64)
        own[order] = place
        todo += [(a, own), (b, own[::-1])]
    return out


def balance(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows within ``capacity``: one more whenever differencing exceeds it."""
    windows = -(-sum(sizes) // capacity)
    while windows:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        windows += 1
    return []


class _Packer:
    def __init__(self, first: int):
        self.sequence, self.waiting, self.total, self.rows = first, [], 0, []

    def add(self, doc: int | None, ids: bytes) -> None:
        ids += END.to_bytes(4, "little")
        n = len(ids) // 4
        full = n // CAPACITY * CAPACITY
        for start in range(0, full, CAPACITY):
            self.emit(doc, ids, start, CAPACITY, n, 0)
            self.sequence += 1
        for start in range(full, n, PIECE):
            size = min(PIECE, n - start)
            self.waiting.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n))
            self.total += size
        if self.total >= WINDOWS * (CAPACITY - MARGIN):
            self.flush()

    def emit(self, doc, ids, start, size, n, offset) -> None:
        self.rows.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, self.sequence, offset))

    def flush(self, everything: bool = False) -> None:
        """Share out what is waiting; the last pieces that would need a window more stay for the next time."""
        pieces, later = self.waiting, []
        if not everything:
            while self.total > WINDOWS * (CAPACITY - MARGIN):
                later.append(pieces.pop())
                self.total -= later[-1][2]
        for window in balance([p[2] for p in pieces]):
            offset = 0
            for i in window:
                doc, start, size, crc, n = pieces[i]
                self.rows.append((doc, start, size, crc, n, self.sequence, offset))
                offset += size
            self.sequence += 1
        self.waiting, self.total = later[::-1], sum(p[2] for p in later)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])


_ENCODERS: dict[str, Encoder] = {}


def pack(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(*library(vocabulary))
        packer = _Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _ENCODERS[vocabulary].ids(batch.column(1).to_pylist()), strict=True):
                packer.add(doc, ids)
            yield packer.taken()
        packer.flush(everything=True)
        yield packer.taken()

    return docs.select(F.col(id).cast("long"), whole_text(text)).mapInArrow(run, SCHEMA)
