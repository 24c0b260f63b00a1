"""Nearest neighbours by largest inner product: a forest of random-projection trees, then exact scores.

A sample of at most ``SAMPLE`` vectors in expectation fixes the hyperplanes of all trees: directions are
random differences of two sample points of a node, cut at the node's median, so trees are balanced.
Every vector is then put into one leaf of each tree. A query searches all trees through one priority
queue, best first by the worst margin on the path, until it has opened a ``share`` of the leaves of the
forest. The vectors of the leaves it opened are all scored exactly, in double precision.

Leaves are opened in rounds: first as many as there are trees, then up to ``WIDEN`` times as many as so
far. The last of the best scores of the earlier rounds bounds what a later one reports, so a round
reports about ``WIDEN`` times the wanted neighbours of a query, however many vectors it scores, and
nothing is lost. There are three rounds at most, as the sample places at most 2048 leaves a tree.

Blocks hold neighbouring leaves of one tree, about ``BLOCK`` vectors; a query visits only blocks with
leaves it opened. By counts, a block with more vectors is sliced and one that more than ``QUERIES``
queries open is repeated. Equal vectors are one class in the index and one query: only the smallest ids
of a class can be among the nearest.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold a null or
a non-finite component take no part, as queries or as candidates; ties go to the smaller id; a repeated
id is taken once for each distinct vector it has; with fewer candidates than ``k`` all are returned; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import discard
from hexloom.llm.skew import join_groups
from hexloom.session import settle

SAMPLE = 16_384
TREES = 8
LEAF = 64
SHARE = 0.125
WIDEN = 16
BLOCK = 16_384
QUERIES = 16_384


@dataclass
class Forest:
    normals: np.ndarray  # tree, node, dimension
    offsets: np.ndarray  # tree, node
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, vectors: int, seed: int = 11) -> Forest:
        """Trees whose leaves hold ``LEAF`` to twice that of ``vectors``, as far as the sample can place their cuts."""
        draw = np.random.default_rng(seed)
        wanted = max(vectors, 1) / LEAF
        depth = max(0, min(int(np.log2(max(wanted, 1))), int(np.log2(max(len(sample) // 8, 1)))))
        nodes = 2**depth - 1
        normals, offsets = np.zeros((TREES, nodes, sample.shape[1])), np.zeros((TREES, nodes))
        for tree in range(TREES):
            members = {0: np.arange(len(sample))}
            for node in range(nodes):
                own = members.pop(node, np.arange(0))
                if len(own) >= 2:
                    a, b = draw.choice(own, 2, replace=False)
                    normal = sample[a] - sample[b]
                else:
                    normal = draw.standard_normal(sample.shape[1])
                normal = normal / max(np.linalg.norm(normal), 1e-12)
                side = sample[own] @ normal
                cut = float(np.median(side)) if len(own) else 0.0
                normals[tree, node], offsets[tree, node] = normal, cut
                members[2 * node + 1], members[2 * node + 2] = own[side <= cut], own[side > cut]
        return cls(normals, offsets, depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered over the whole forest."""
        out = np.zeros((len(vectors), TREES), np.int64)
        for tree in range(TREES):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.normals[tree, node]) > self.offsets[tree, node]
                node = 2 * node + 1 + side
            out[:, tree] = node - (2**self.depth - 1) + tree * 2**self.depth
        return out

    def probes(self, query: np.ndarray, count: int) -> list[int]:
        """The ``count`` leaves that one queue over all trees opens first."""
        margins = (self.normals @ query - self.offsets).tolist()
        inner, found = 2**self.depth - 1, []
        queue = [(0.0, tree, 0) for tree in range(TREES)]
        while queue and len(found) < count:
            worst, tree, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[tree][node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(worst, abs(margin)), tree, 4 * node + 3 - near))
                node = near
            found.append(node - inner + tree * 2**self.depth)
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def usable(table: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): vectors that take part, of one length; floats stay floats, which doubles hold exactly."""
    kept = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(kept).alias("v")).filter("id IS NOT NULL")
    fit = rows.filter(
        "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)"
    )
    common = fit.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fit.filter(F.size("v") == (common[0] if common else 0))


def nearest(
    table: DataFrame, is_query: str, k: int = 20, id: str = "vec_id", vector: str = "embedding", share: float = SHARE
) -> DataFrame:
    """For each row that ``is_query`` (SQL on ``id``) picks: query_id, rank, vec_id, score of its ``k`` nearest."""
    spark = table.sparkSession
    rows = settle(usable(table, id, vector), "vectors")
    # Of equal vectors only the k + 1 smallest ids can be among anyone's nearest.
    order = "ROW_NUMBER() OVER (PARTITION BY v ORDER BY id) AS place"
    firsts = settle(rows.distinct().selectExpr("*", order).filter(f"place <= {k + 1}"), "firsts")
    members = settle(
        firsts.groupBy("v").agg(F.min("id").alias("rep"), F.expr("array_sort(collect_list(id)) AS ids")), "members"
    )
    asked = rows.filter(is_query.format(id="id")).groupBy("v").agg(F.expr("count(1) AS askers"))
    queries = settle(members.join(asked, "v").select("rep", "v", "askers"), "queries")
    total = members.count()
    kept = members.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < min(1.0, SAMPLE / max(total, 1)) * (1 << 20))
    sample = _matrix(kept.orderBy("rep").select("v").toArrow().column("v").combine_chunks())
    forest = spark.sparkContext.broadcast(Forest.fit(sample if sample.size else np.zeros((0, 1)), total))
    leaves = 2**forest.value.depth
    # In a shallow forest a share is a handful of leaves; four from each tree are opened at least.
    count = max(4 * TREES, int(share * TREES * leaves))
    # Leaves of a block: neighbours in one tree.
    span = max(1, 2 ** int(np.log2(max(1, BLOCK * leaves // max(total, 1))))) if total > BLOCK else leaves

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per vector and tree."""
        for batch in batches:
            if len(batch):
                leaf = forest.value.leaves(_matrix(batch.column(1))).ravel()
                at = pa.array(np.repeat(np.arange(len(batch)), TREES))
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(leaf // span), pa.array(leaf)]
                yield pa.record_batch(columns, names=["rep", "v", "block", "leaf"])

    def open_leaves(start: int, stop: int):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row per query and block, with the leaves from ``start`` to ``stop`` in the queue's order."""
            for batch in batches:
                at, blocks, opened = [], [], []
                for i, q in enumerate(_matrix(batch.column(1))):
                    found = np.sort(forest.value.probes(q, stop)[start:])
                    for part in np.split(found, np.flatnonzero(np.diff(found // span)) + 1) if len(found) else []:
                        at.append(i)
                        blocks.append(part[0] // span)
                        opened.append(part)
                at = pa.array(at, pa.int64())
                columns = [batch.column(i).take(at) for i in range(3)]
                columns += [pa.array(blocks, pa.int64()), pa.array(opened, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["rep", "v", "bound", "block", "leaves"])

        return search

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Exact scores of one block's vectors for the queries that opened their leaves."""
        out: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_by("leaf")
            ids, who, bounds = left.column("rep").to_numpy(), right.column("rep").to_numpy(), right.column("bound").to_numpy()
            own, ask = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
            held, first = np.unique(left.column("leaf").to_numpy(), return_index=True)
            ends = np.append(first[1:], len(ids))
            opened = right.column("leaves").combine_chunks()
            sizes = opened.value_lengths().to_numpy()
            for at in range(0, len(who), 256):
                some = slice(at, at + 256)
                rows = np.repeat(np.arange(len(who[some])), sizes[some])
                wanted = opened[some].flatten().to_numpy()
                order = np.argsort(wanted, kind="stable")
                spans = zip(*(np.searchsorted(wanted[order], held, side) for side in ("left", "right")), strict=True)
                scores = np.full((len(who[some]), len(ids)), -np.inf)
                for (a, b), low, high in zip(spans, first, ends, strict=True):
                    if a < b:
                        askers = rows[order[a:b]]
                        scores[askers, low:high] = ask[at + askers] @ own[low:high].T
                for i in range(len(scores)):
                    near = np.flatnonzero((scores[i] >= bounds[at + i]) & (scores[i] > -np.inf))
                    if len(near):
                        near = near[_best(scores[i, near], ids[near], k + 1)]
                        out.append((np.full(len(near), who[at + i]), ids[near], scores[i, near]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": columns[0], "rep": columns[1], "score": columns[2]})

    type_v = dict(members.dtypes)["v"]
    places = members.select("rep", "v").mapInArrow(index, f"rep long, v {type_v}, block long, leaf long")
    slices = places.groupBy("block").agg(F.expr(f"cast(ceil(count(1) / {2 * BLOCK}) as int) AS slices"))
    slices = settle(slices.withColumnRenamed("block", "sliced"), "slices")
    best, start = None, 0
    while start < count:
        stop = min(count, WIDEN * start or TREES)
        if best is None:
            asking = queries.selectExpr("rep", "v", "double('-Infinity') AS bound")
        else:
            full = best.groupBy("query").agg(F.expr(f"if(count(1) > {k}, min(score), double('-Infinity')) AS bound"))
            asking = queries.join(full, queries["rep"] == full["query"], "left").selectExpr(
                "rep", "v", "coalesce(bound, double('-Infinity')) AS bound"
            )
        shape = f"rep long, v {type_v}, bound double, block long, leaves array<bigint>"
        probes = settle(asking.mapInArrow(open_leaves(start, stop), shape), "probes")
        parts = probes.groupBy("block").agg(F.expr(f"cast(ceil(count(1) / {QUERIES}) as int) AS parts"))
        parts = settle(parts.join(slices, parts["block"] == slices["sliced"]).select("block", "parts", "slices"), "parts")
        asked_parts = probes.join(parts, "block").selectExpr(
            "rep", "v", "bound", "block", "leaves", "cast(pmod(xxhash64(rep), parts) as int) AS part",
            "explode(sequence(0, slices - 1)) AS slice",
        )
        # Columns of its own, as both sides of the cogroup come from the same table.
        own = parts.selectExpr("block + 0 AS own_block", "parts AS own_parts", "slices AS own_slices")
        own_parts = places.join(own, places["block"] == own["own_block"]).selectExpr(
            "rep", "v", "leaf", "own_block", "cast(pmod(xxhash64(rep), own_slices) as int) AS own_slice",
            "explode(sequence(0, own_parts - 1)) AS own_part",
        )
        pairs = own_parts.groupBy("own_block", "own_part", "own_slice").cogroup(asked_parts.groupBy("block", "part", "slice"))
        found = pairs.applyInArrow(rerank, "query long, rep long, score double")
        merged = (found if best is None else found.unionByName(best)).groupBy("query", "rep").agg(F.max("score").alias("score"))
        top = merged.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, rep) AS place")
        earlier, best = best, settle(top.filter(f"place <= {k + 1}").drop("place"), "best")
        for done in (earlier, probes, parts):
            if done is not None:
                discard(done)
        start = stop
    top = best
    # Ids of the classes found, the k + 1 nearest of each query class: one more than needed, as a row isn't its own neighbour.
    named = top.join(members.select("rep", "ids"), "rep").selectExpr("query", "score", "explode(ids) AS id")
    ranked = named.selectExpr("*", "ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, id) AS place").filter(f"place <= {k + 1}")
    lists = ranked.groupBy("query").agg(F.expr("array_sort(collect_list(struct(place, id, score))) AS near"))
    lists = settle(queries.join(lists, queries["rep"] == lists["query"]).select("rep", "v", "askers", "near"), "lists")
    askers = rows.filter(is_query.format(id="id"))
    answers = join_groups(askers, lists, ["v"], "askers")
    others = answers.selectExpr("id AS query_id", f"slice(filter(near, n -> n.id != id), 1, {k}) AS near")
    return others.selectExpr("query_id", "posexplode(near) AS (at, n)").selectExpr(
        "query_id", "cast(at + 1 as int) AS rank", "n.id AS vec_id", "n.score AS score"
    )
