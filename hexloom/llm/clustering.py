"""K-means on integers with subvector dictionaries, exact in every round.

Vectors are laid out in blocks. In a block every run of dimensions is dictionary-encoded without loss:
a code per vector and the distinct subvectors. Runs start as single dimensions, and neighbours merge
as long as the merged dictionary holds at most ``1 / MERGE`` of the block's vectors, so vectors that
share parts or are copies get wide runs and short dictionaries, and unrelated ones narrow runs.

In a round each distinct subvector is compared once with every centroid, and a vector's distances are
sums of table entries picked by its codes. Sums of members come from the dictionaries, too: counts of
(cluster, code) times subvectors. Blocks never move: a round is one pass over them that returns a count
and 64 sums per task and cluster, which Spark adds up. Everything is 64-bit integer arithmetic.

Defined cases: vectors that are null, of another length, or with null or non-finite components take no
part; repeated rows and ids are vectors each; a null id hashes as an empty one; ties go to the smaller
cluster; fewer vectors than clusters give as many clusters as vectors; an empty table gives an empty
result; other columns take no part. A component beyond 2^27 after scaling is an error, as squares would
leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.columns import BLOCK, arrived, bounded, scaled, usable
from hexloom.session import settle

CLUSTERS, ROUNDS, SCALE, WIDTH = 8, 10, 1024, 64
SEED = "3:"
#: Runs merge while their dictionary holds at most this share of a block's vectors (one in ...).
MERGE = 4
LARGEST = 1 << 27

_ENCODED = "ids binary, missing binary, widths binary, sizes binary, words binary, codes binary"


def encoded(matrix: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes and distinct subvectors of each run of dimensions; ``words[r][codes[r]]`` gives the columns back."""
    n = len(matrix)
    runs = []
    for d in range(matrix.shape[1]):
        values, codes = np.unique(matrix[:, d], return_inverse=True)
        runs.append((codes.astype(np.int64), values[:, None]))
    merged = True
    while merged:
        merged, out, i = False, [], 0
        while i < len(runs):
            if i + 1 < len(runs):
                (a, left), (b, right) = runs[i], runs[i + 1]
                if len(left) <= n // MERGE and len(right) <= n // MERGE:
                    pairs, codes = np.unique(a * len(right) + b, return_inverse=True)
                    if len(pairs) <= max(n // MERGE, 1):
                        words = np.concatenate([left[pairs // len(right)], right[pairs % len(right)]], axis=1)
                        out.append((codes.astype(np.int64), words))
                        merged, i = True, i + 2
                        continue
            out.append(runs[i])
            i += 1
        runs = out
    return [c for c, _ in runs], [w for _, w in runs]


def _encode(block: int):
    def finish(heads, matrix):
        bounded(matrix, LARGEST, "squared distances")
        codes, words = encoded(matrix)
        values = (
            heads[0].astype("<i8").tobytes(), heads[1].astype("u1").tobytes(),
            np.array([w.shape[1] for w in words], "<i4").tobytes(), np.array([len(w) for w in words], "<i4").tobytes(),
            b"".join(w.astype("<i4").tobytes() for w in words),
            b"".join(c.astype("<u2" if len(w) <= 1 << 16 else "<u4").tobytes() for c, w in zip(codes, words, strict=True)),
        )
        yield pa.record_batch([pa.array([v], pa.binary()) for v in values], names=[f.split(" ")[0] for f in _ENCODED.split(", ")])

    return lambda batches: arrived(batches, finish, block)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, missing, codes, words) of each block."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, missing, widths, sizes, words, codes = (batch.column(c)[row].as_py() for c in range(6))
            ids = np.frombuffer(ids, "<i8")
            widths, sizes = np.frombuffer(widths, "<i4"), np.frombuffer(sizes, "<i4")
            all_words, own_codes, own_words, at, place = np.frombuffer(words, "<i4").astype(np.int64), [], [], 0, 0
            for width, size in zip(widths.tolist(), sizes.tolist(), strict=True):
                own_words.append(all_words[at : at + width * size].reshape(size, width))
                kind = "<u2" if size <= 1 << 16 else "<u4"
                own_codes.append(np.frombuffer(codes, kind, len(ids), place))
                at, place = at + width * size, place + len(ids) * int(kind[-1])
            yield ids, np.frombuffer(missing, "u1") > 0, own_codes, own_words


def nearest(codes: list[np.ndarray], words: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector: one table of partial distances per run, summed by code."""
    total, at = np.zeros((len(codes[0]), len(centroids)), np.int64), 0
    for code, word in zip(codes, words, strict=True):
        part = centroids[:, at : at + word.shape[1]]
        table = ((word[:, None, :] - part[None]) ** 2).sum(axis=2)
        total += table[code]
        at += word.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def _members(centroids: np.ndarray):
    """Counts and sums of the members of each cluster, one row per task and cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, centroids.shape[1]), np.int64)
        for ids, _, codes, words in _decoded(batches):
            cluster, _ = nearest(codes, words, centroids)
            counts += np.bincount(cluster, minlength=k)
            at = 0
            for code, word in zip(codes, words, strict=True):
                seen = np.bincount(cluster * len(word) + code, minlength=k * len(word)).reshape(k, len(word))
                sums[:, at : at + word.shape[1]] += seen @ word
                at += word.shape[1]
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, missing, codes, words in _decoded(batches):
            cluster, distance = nearest(codes, words, centroids)
            yield pa.record_batch(
                [pa.array(ids, pa.int64(), mask=missing), pa.array(cluster, pa.int32()), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def clusters(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter(f"size(v) = {WIDTH}")
    rows = usable(named, "v").selectExpr("id", f"{scaled('v', SCALE)} AS v")
    first = rows.orderBy(F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(CLUSTERS)
    centroids = np.array([r["v"] for r in first.select("v").collect()], np.int64)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    bounded(centroids, LARGEST, "squared distances")
    blocks = settle(
        rows.selectExpr("coalesce(id, 0) AS id", "bigint(id IS NULL) AS missing", "v").mapInArrow(_encode(block), _ENCODED), "blocks"
    )
    sums = [F.expr(f"sum(sums[{d}]) AS s{d}") for d in range(WIDTH)]
    for _ in range(ROUNDS):
        members = blocks.mapInArrow(_members(centroids), "cluster int, n bigint, sums array<bigint>")
        moved = centroids.copy()
        for r in members.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
            moved[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(WIDTH)]
        if (moved == centroids).all():
            break  # Nothing moves in any further round either.
        centroids = moved
    assigned = settle(blocks.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    parts = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(c, part, sum(parts.values()), digest[c]) for c, part in parts.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
