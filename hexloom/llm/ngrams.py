"""Hashed character n-gram counts of whole texts as dense rows, for the two text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are counted in pieces of so many bytes, so that a very long one needs no more memory.
PIECE = 1 << 20


def letters_table() -> np.ndarray:
    """Lower-cased ASCII letters and all bytes of other alphabets stay; the rest becomes a space."""
    table = np.full(256, 32, np.uint8)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    table[128:] = np.arange(128, 256)
    return table


def surface_table() -> np.ndarray:
    """Every byte as it is, but digits alike and white space alike."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("0") : ord("9") + 1] = ord("0")
    table[[9, 10, 11, 12, 13]] = 32
    return table


def _hashed(raw: np.ndarray, order: int, dims: int) -> np.ndarray:
    code = np.zeros(len(raw) - order + 1, np.uint32)
    for i in range(order):
        code = code * np.uint32(257) + raw[i : len(raw) - order + 1 + i]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - (dims.bit_length() - 1))).astype(np.int64)


def counts(text: str, table: np.ndarray, orders: tuple[int, ...], dims: int, out: np.ndarray) -> None:
    """Add the n-gram counts of one text to ``out``; runs of spaces count as one."""
    raw = table[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]]
    for order in orders:
        for at in range(0, len(raw) - order + 1, PIECE):
            out += np.bincount(_hashed(raw[at : at + PIECE + order - 1], order, dims), minlength=dims)[:dims]


def blocks(texts: list[str | None], table: np.ndarray, orders: tuple[int, ...], dims: int, rows: int = 128) -> Iterator[np.ndarray]:
    """Dense count blocks of at most ``rows`` texts each, in order."""
    for at in range(0, len(texts), rows):
        part = texts[at : at + rows]
        block = np.zeros((len(part), dims), np.float32)
        for i, text in enumerate(part):
            if text:
                counts(text, table, orders, dims, block[i])
        yield block


def weighted(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log(1 + tf) * idf scaled to length one; an empty row stays zero."""
    v = np.log1p(block) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def inverse_frequency(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.log((1 + documents) / (1 + frequency)).astype(np.float32) + np.float32(0.1)


MEASURED = "tag string, documents long, dims array<int>, values array<bigint>"


def measure(table: np.ndarray, orders: tuple[int, ...], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (text, tag): per task one row of document frequencies; one row of counts for each tagged text."""
    names = [f.split(" ")[0] for f in MEASURED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def row(data: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(dims, np.int64), 0
        for batch in batches:
            texts, tags, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for block in blocks(texts, table, orders, dims):
                total += (block > 0).sum(axis=0)
                documents += len(block)
                tagged = [(tags[at + i], np.flatnonzero(block[i]), block[i]) for i in range(len(block)) if tags[at + i] is not None]
                at += len(block)
                if tagged:
                    yield row([[t for t, _, _ in tagged], [0] * len(tagged), [w for _, w, _ in tagged], [c[w].astype(np.int64) for _, w, c in tagged]])
        yield row([[None], [documents], [np.flatnonzero(total)], [total[total > 0]]])

    return run


def frequencies(measured: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of documents and document frequencies; rows of tasks add up before they reach the driver."""
    totals = measured.filter("tag IS NULL")
    out = np.zeros(dims)
    for dim, n in totals.selectExpr("inline(arrays_zip(dims, values))").groupBy("dims").agg(F.sum("values")).collect():
        out[dim] = n
    return totals.agg(F.sum("documents")).first()[0] or 0, out


def dense(rows: DataFrame, dims: int) -> np.ndarray:
    """Count rows of a bounded sample as a matrix."""
    found = rows.select("dims", "values").toArrow()
    where, values = found.column("dims").combine_chunks(), found.column("values").combine_chunks()
    block = np.zeros((len(where), dims), np.float32)
    sizes = where.value_lengths().to_numpy(zero_copy_only=False)
    block[np.repeat(np.arange(len(where)), sizes), where.flatten().to_numpy()] = values.flatten().to_numpy()
    return block
