"""Hard negatives by a vertical scan: dimension after dimension, until bounds have decided every row.

Vectors are laid out in blocks, one array per dimension with its smallest and largest value. A block
meets a set of anchors at a time. An anchor reads the dimensions in the order of its own descending
magnitudes and keeps a partial score per candidate; the least and the most that the dimensions still
to come can add follow from their extremes. Candidates that can't get into any wanted score window any
more leave the candidate set, and a window's lower end rises to the k-th best score that is certain.
What is left at the last dimension is exact, so nothing is lost.

Two scans run over all rows. The first finds an anchor's nearest rows of the same label, its positives,
in one window without ends. The second finds the first rows of other labels in the windows that the
positives' scores give. Each starts on a sixteenth of the blocks; the k-th best score found there is a
proven lower end for all others, which then return hardly more than what is asked for.

Anchors are a share of all rows, so work is their number times all rows, whatever the plan. They go
through in sets of ``ANCHORS``; only one set at a time is broadcast and its scores collected, both of
fixed size. Blocks stay where they are and are read once per set and scan.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no part;
vectors of different lengths never meet; a row with the anchor's id is the anchor itself, and repeated
anchors are mined each for themselves; ties go to the smaller id; a negative positive score has no
window; an empty table gives an empty result; other columns take no part. Scaled components whose
products could leave 64 bits are an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.columns import BLOCK, arrived, bounded, scaled, usable
from hexloom.session import fresh_path, settle

SCALE = 256
ANCHORS = 4096
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: One block in so many is scanned first.
SEEDS = 16
#: Dimensions read between two looks at the bounds.
STRIDE = 8
LARGEST = 1 << 28
_END = 1 << 62

_LAYOUT = "number long, seed boolean, width int, ids binary, labels binary, cells binary"
_FOUND = "number long, anchor int, anchor_id long, base long, score long, vec_id long"


def _laid_out(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def finish(heads, matrix):
            nonlocal count
            bounded(matrix, LARGEST, "scores")
            ids = heads[0].astype("<i8").tobytes()
            number = (TaskContext.get().partitionId() << 24) + count
            count += 1
            yield pa.record_batch(
                [
                    pa.array([number]), pa.array([xxhash.xxh3_64_intdigest(ids) % SEEDS == 0]),
                    pa.array([matrix.shape[1]], pa.int32()), pa.array([ids], pa.binary()),
                    pa.array([heads[1].astype("<i8").tobytes()], pa.binary()), pa.array([matrix.T.astype("<i4").tobytes()], pa.binary()),
                ],
                names=[f.split(" ")[0] for f in _LAYOUT.split(", ")],
            )

        yield from arrived(batches, finish, size)

    return run


def scan(columns: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, windows: list[tuple[int, int, int]], k: int):
    """(window, candidate, score) with at least the ``k`` best of each window, ties included.

    ``columns`` has one row per dimension, ``low`` and ``high`` its extremes; ``windows`` are (base, low
    end, high end), ends included.
    """
    ends = np.array([w[1:] for w in windows], np.int64).reshape(-1, 2).copy()
    order = np.argsort(-np.abs(q), kind="stable")
    least, most = np.minimum(q * low, q * high)[order], np.maximum(q * low, q * high)[order]
    least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (least, most))

    def raise_ends(floor: np.ndarray, top: np.ndarray):
        for j, (a, b) in enumerate(ends):
            sure = floor[(floor >= a) & (top <= b)]
            if len(sure) >= k:
                ends[j, 0] = np.partition(sure, len(sure) - k)[len(sure) - k]

    # Whole scores of a few candidates give the windows' first lower ends.
    few = columns[:, : max(256, columns.shape[1] // 16)]
    raise_ends(*[q @ few] * 2)
    alive, partial = None, np.zeros(columns.shape[1], np.int64)
    for at in range(0, len(order), STRIDE):
        for d in order[at : at + STRIDE]:
            if q[d]:
                partial += columns[d] * q[d] if alive is None else columns[d][alive] * q[d]
        rest = min(at + STRIDE, len(order))
        floor, top = partial + least[rest], partial + most[rest]
        raise_ends(floor, top)
        keep = np.zeros(len(partial), bool)
        for a, b in ends:
            keep |= (top >= a) & (floor <= b)
        kept = int(keep.sum())
        if kept < len(keep) * 0.8 or rest == len(order):
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            partial = partial[keep]
        if not kept:
            return
    if alive is None:
        alive = np.arange(len(partial))
    for j, (a, b) in enumerate(ends):
        inside = np.flatnonzero((partial >= a) & (partial <= b))
        if len(inside) > k:
            last = np.partition(partial[inside], len(inside) - k)[len(inside) - k]
            inside = inside[partial[inside] >= last]
        yield windows[j][0], alive[inside], partial[inside]


def _scanned(windows: dict[int, list[tuple[int, int, int]]] | None, k: int, same: bool):
    """Every block with a set of anchors; without ``windows`` there is one for each anchor, without ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                width = row["width"]
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                cells = np.frombuffer(row["cells"], "<i4").reshape(width, len(ids)).astype(np.int64)
                a_ids, a_labels = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["a_labels"], "<i8")
                a_cells = np.frombuffer(row["a_cells"], "<i4").reshape(width, len(a_ids)).T.astype(np.int64)
                if width and len(ids) and len(a_ids):
                    if int(np.abs(cells).max()) * int(np.abs(a_cells).max()) * width >= _END:
                        raise ValueError("scores leave 64 bits")
                for label in np.unique(a_labels):
                    rows = np.flatnonzero((labels == label) == same)
                    if not len(rows):
                        continue
                    own, names = cells[:, rows], ids[rows]
                    low, high = own.min(axis=1), own.max(axis=1)
                    for i in np.flatnonzero(a_labels == label).tolist():
                        asked = [(0, -_END, _END)] if windows is None else windows.get(i, [])
                        if not asked:
                            continue
                        # One more than asked for, as the anchor itself may be among them.
                        more = int((names == a_ids[i]).sum()) if same else 0
                        for base, found, scores in scan(own, low, high, a_cells[i], asked, k + more):
                            others = found if not more else found[names[found] != a_ids[i]]
                            scores = scores if not more else scores[names[found] != a_ids[i]]
                            best = np.lexsort((names[others], -scores))[:k]
                            out.append((i, base, scores[best], names[others[best]]))
                lengths = [len(o[2]) for o in out]
                anchors = np.repeat(np.array([o[0] for o in out], np.int32), lengths)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(anchors), row["a_number"], np.int64)), pa.array(anchors, pa.int32()), pa.array(a_ids[anchors], pa.int64()),
                        pa.array(np.repeat(np.array([o[1] for o in out], np.int64), lengths)),
                        *(pa.array(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for c in (2, 3)),
                    ],
                    names=[f.split(" ")[0] for f in _FOUND.split(", ")],
                )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = "row_number() OVER (PARTITION BY number, anchor, base ORDER BY score DESC, vec_id) AS rank"
    return found.selectExpr("*", rank).filter(f"rank <= {k}")


def _search(blocks: DataFrame, one: DataFrame, windows: dict | None, k: int, same: bool, path: str) -> None:
    """Append what a set of anchors finds in all blocks to ``path``: first in the seeds, then in the rest."""
    spark, seeds = blocks.sparkSession, fresh_path(blocks.sparkSession, "seeds")

    def scanned(which: str, windows: dict | None) -> DataFrame:
        return blocks.filter(which).drop("seed", "number").join(F.broadcast(one), "width").mapInArrow(_scanned(windows, k, same), _FOUND)

    scanned("seed", windows).write.parquet(seeds)
    first = spark.read.schema(_FOUND).parquet(seeds)
    floors = _best(first, k).filter(f"rank = {k}").select("anchor", "base", "score").collect()
    if windows is None:
        raised = {r["anchor"]: r["score"] for r in floors}
        size = one.selectExpr("length(a_ids) div 8 AS n").first()["n"]
        windows = {i: [(0, raised.get(i, -_END), _END)] for i in range(size)}
    else:
        raised = {(r["anchor"], r["base"]): r["score"] for r in floors}
        windows = {i: [(b, max(lo, raised.get((i, b), lo)), hi) for b, lo, hi in w] for i, w in windows.items()}
    first.write.mode("append").parquet(path)
    scanned("NOT seed", windows).write.mode("append").parquet(path)


def mine(
    vectors: DataFrame, chosen: str, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    block: int = BLOCK, anchors: int = ANCHORS,
) -> DataFrame:
    """One row per anchor, positive and negative: ids, rank of the negative, both scores.

    ``chosen`` is a condition on ``id`` that picks the anchors.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = usable(named.filter("id IS NOT NULL AND label IS NOT NULL"), "v").selectExpr("id", "label", f"{scaled('v', SCALE)} AS v")

    def laid_out(some: DataFrame, size: int, name: str) -> DataFrame:
        # Full blocks, but enough of them to keep all cores busy; the layout decides no result.
        n, cores = some.count(), spark.sparkContext.defaultParallelism
        parts = max(-(-n // size), min(cores, -(-n // 2048)) if name == "blocks" else 1, 1)
        return settle(some.repartition(parts).mapInArrow(_laid_out(size), _LAYOUT), name)

    blocks = laid_out(rows, block, "blocks")
    sets = laid_out(rows.filter(chosen.format(id="id")), anchors, "anchors").selectExpr(
        "number AS a_number", "width", "ids AS a_ids", "labels AS a_labels", "cells AS a_cells"
    )
    numbers = sorted(r["a_number"] for r in sets.select("a_number").collect())
    near, hard = fresh_path(spark, "near"), fresh_path(spark, "hard")
    for path in (near, hard):
        spark.createDataFrame([], _FOUND).write.parquet(path)
    for number in numbers:
        _search(blocks, sets.filter(f"a_number = {number}"), None, POSITIVES, True, near)
    positives = settle(_best(spark.read.schema(_FOUND).parquet(near), POSITIVES), "positives")
    for number in numbers:
        windows = defaultdict(list)
        for r in positives.filter(f"number = {number} AND score >= 0").select("anchor", "score").distinct().collect():
            p = r["score"]
            windows[r["anchor"]].append((p, -(-LOW * p // 100), HIGH * p // 100))
        if windows:
            _search(blocks, sets.filter(f"a_number = {number}"), dict(windows), NEGATIVES, False, hard)
    negatives = _best(spark.read.schema(_FOUND).parquet(hard), NEGATIVES).selectExpr(
        "number", "anchor", "base", "rank", "vec_id AS negative_id", "score AS negative_score"
    )
    return positives.selectExpr("number", "anchor", "anchor_id", "vec_id AS positive_id", "score AS base").join(
        negatives, ["number", "anchor", "base"]
    ).selectExpr("anchor_id", "positive_id", "rank", "negative_id", "base AS positive_score", "negative_score")
