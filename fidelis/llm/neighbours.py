"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A node parts its vectors at the median rank of their distances to a vantage point, and keeps
the greatest distance on the near side and the least on the far side; the triangle
inequality tells which side can hold nothing nearer than the neighbours found so far. Ties
are parted by rank, so a tree is as deep as the logarithm of its rows whatever they are. The
bound is relaxed by a factor: a side is left out when its least distance times `factor` exceeds the present
k-th distance. Factor one prunes only what cannot matter and is exact.

Every row is indexed. Each shard, of bounded size, is met by the stated query set in the task
that makes its tree: vectors and queries come sorted, so a task holds one shard and one block
of queries at a time. The partial lists of a query are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fidelis.llm.common import cut_lineage

#: Production parameters: neighbours, pruning factor, rows in a shard (about), rows in a
#: query block, rows in a leaf.
K, FACTOR, SHARD_ROWS, BLOCK_ROWS, LEAF = 10, 1.0, 8192, 1024, 256


@dataclass
class Node:
    vantage: np.ndarray | None = None
    near: float = 0.0  # greatest distance inside
    far: float = 0.0  # least distance outside
    inside: Node | None = None
    outside: Node | None = None
    ids: np.ndarray | None = None
    vectors: np.ndarray | None = None


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over the vectors; a vantage point is the one farthest from the node's mean."""
    if len(ids) <= leaf:
        return Node(ids=ids, vectors=vectors)
    vantage = vectors[int(((vectors - vectors.mean(0)) ** 2).sum(1).argmax())]
    distance = np.sqrt(((vectors - vantage) ** 2).sum(1))
    order, half = np.argsort(distance, kind="stable"), len(ids) // 2
    sides = [build(ids[part], vectors[part], leaf) for part in (order[:half], order[half:])]
    return Node(vantage, float(distance[order[half - 1]]), float(distance[order[half]]), *sides)


class Search:
    """The k nearest found so far for a block of queries."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.query_ids, self.queries, self.k, self.factor = query_ids, queries, k, factor
        self.distances = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.ids is not None:
            for i in range(0, len(node.ids), 512):
                for j in range(0, len(rows), 256):
                    self._scan(node.ids[i : i + 512], node.vectors[i : i + 512], rows[j : j + 256])
            return
        d = np.sqrt(((self.queries[rows] - node.vantage) ** 2).sum(1))
        near_inside = d <= (node.near + node.far) / 2
        self.visit(node.inside, rows[near_inside])
        self.visit(node.outside, rows[~near_inside])
        # a side's vectors are at least this far away; rounding is left some room
        inner, outer = (np.maximum(x, 0) * self.factor * (1 - 1e-9) - 1e-9 for x in (d - node.near, node.far - d))
        limit = self.distances[rows, -1]
        self.visit(node.outside, rows[near_inside & (outer <= limit)])
        self.visit(node.inside, rows[~near_inside & (inner <= limit)])

    def _scan(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        """Merges a leaf's vectors. Products of matrices leave out all that cannot be among the
        k nearest, with room for their rounding; the rest gets its exact distance."""
        q, k = self.queries[rows], self.k
        sizes, own = (vectors * vectors).sum(1), (q * q).sum(1)
        rough = own[:, None] + sizes[None] - 2 * (q @ vectors.T)
        rough[self.query_ids[rows][:, None] == ids[None]] = np.inf
        limit = self.distances[rows, -1] ** 2
        if len(ids) > k:
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
        room = 1e-9 * (own + sizes.max() + 1e-300)
        at, which = np.nonzero((rough <= (limit + room)[:, None]) & np.isfinite(rough))
        if not len(at):
            return
        d = np.zeros(len(at))
        for x, y in zip(q[at].T, vectors[which].T, strict=True):  # component by component, in order
            d += (x - y) ** 2
        owner = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        all_d = np.concatenate([self.distances[rows].ravel(), np.sqrt(d)])
        all_ids = np.concatenate([self.ids[rows].ravel(), ids[which]])
        order = np.lexsort((all_ids, all_d, owner))
        firsts = np.searchsorted(owner[order], np.arange(len(rows)))
        best = order[firsts[:, None] + np.arange(k)]
        self.distances[rows], self.ids[rows] = all_d[best], all_ids[best]


def _clean(embeddings: DataFrame) -> DataFrame:
    """(_id, _v, _dim) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("_id"), vector.alias("_v"), bad.alias("_bad"), zero.alias("_zero"))
        .filter(F.col("_v").isNotNull() & F.col("_id").isNotNull() & ~F.col("_bad") & ~F.col("_zero"))
        .select("_id", "_v", F.size("_v").alias("_dim"))
    )


def nearest(
    embeddings: DataFrame, every: int = 100, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id `every` divides.

    Euclidean distance in double precision, nearest first, ties to the smaller vec_id. A
    query's candidates are all rows with another vec_id and as many components; vectors
    that are null, zero, without components, or hold nulls or non-finite components, and
    rows with a null vec_id, take no part. Candidates that repeat a vec_id with another
    vector are listed apart; wholly repeated rows count once. Fewer candidates give fewer
    rows, an empty table none. Columns beside vec_id and embedding are ignored.
    """
    rows = cut_lineage(_clean(embeddings).dropDuplicates(["_id", "_v"]))
    shards = max(1, -(-rows.count() // shard_rows))
    # hashes deal rows evenly whatever their ids
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_id", "_v"), F.lit(shards)).cast("int"))
    queries = rows.filter(F.pmod("_id", F.lit(every)) == 0).withColumn(
        "_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    tasks = min(shards, 20_000)  # a task takes whole shards, one after another
    streams = (
        dealt.withColumn("_asked", F.lit(False))
        .unionByName(queries.withColumn("_asked", F.lit(True)))
        .repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_dim", "_shard")
        .sortWithinPartitions("_dim", "_shard", "_asked", "_id")
    )
    parts = streams.mapInPandas(lambda it: _search_streams(it, k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_streams(frames: Iterator[pd.DataFrame], k: int, factor: float) -> Iterator[pd.DataFrame]:
    """Shard by shard: the shard's vectors, of which a tree is made, then all queries past it.

    A task holds the vectors of one shard and BLOCK_ROWS queries, whatever their number.
    """
    shard, held, tree = None, [], None
    for frame in frames:
        for key, part in frame.groupby(["_dim", "_shard"], sort=False):
            if key != shard:
                shard, held, tree = key, [], None
            asked = part["_asked"].to_numpy()
            mine = part[~asked]
            if len(mine):
                held.append((mine["_id"].to_numpy(np.int64), np.stack(mine["_v"].to_numpy()).astype(float)))
            rest = part[asked]
            if len(rest) and tree is None and held:
                ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                tree, held = build(ids, vectors), []
            if tree is None:
                continue
            for i in range(0, len(rest), BLOCK_ROWS):
                block = rest.iloc[i : i + BLOCK_ROWS]
                ids = block["_id"].to_numpy(np.int64)
                found = Search(ids, np.stack(block["_v"].to_numpy()).astype(float), k, factor)
                found.visit(tree, np.arange(len(ids)))
                real = np.isfinite(found.distances)
                yield pd.DataFrame(
                    {"query_id": np.repeat(ids, real.sum(1)), "vec_id": found.ids[real], "score": found.distances[real]}
                )
