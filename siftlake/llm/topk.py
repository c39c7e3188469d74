"""Exact k highest inner products with a KD-tree per shard.

Vectors become integers, so scores are exact and ties are ties. The candidates are dealt to shards; a task builds the
KD-tree of its shard by median splits along the widest side of the box, keeps the tight bounding box of every node, and
answers a block of queries by best-first traversal: the node with the highest bound is opened first, the bound of a box
being the inner product with its best corner, until no bound reaches the query's kth score. Ties go to the smaller id,
so a box is left only if its bound is below the kth score.

Products are taken in floating point where the largest components prove that every sum stays below 2 ** 53; elsewhere
bounds get the rounding error added, and scores are sums of Python's integers. Components and scores beyond the range of
a long are the nearest long, and tie there.

The kth score that a query has already reached is carried along: first each query meets one shard, dealt by a hash,
which gives a floor under its final kth score; then it meets the others with that floor, and most boxes never open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import NUMBER_BATCH_ROWS, text_batches
from siftlake.session import materialise

#: Vectors in a shard and in a leaf; queries that a shard's tree is built for at most, on average, and that it answers
#: at once.
SHARD_ROWS, LEAF_ROWS, PORTION_ROWS, BLOCK_ROWS = 16_384, 256, 8_192, 512
SCALE = 64

HITS = "query_id long, vec_id long, score long"
#: The floor of a query that has no kth score yet, and the range of a score.
NOTHING, MOST = -(1 << 63), (1 << 63) - 1
_HITS = pa.schema([(x.split()[0], pa.int64()) for x in HITS.split(", ")])


class KdTree:
    """Median splits down to leaves of at most leaf_rows vectors; nodes with tight boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int) -> None:
        self.ids, self.whole, self.vectors = ids, vectors, vectors.astype(np.float64)
        self.largest = np.abs(self.vectors).max(initial=0.0)
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._grow(order, leaf_rows)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, order: np.ndarray, leaf_rows: int) -> int:
        own = self.vectors[order]
        node = len(self.low)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.children.append(())
        self.rows.append(order)
        sides = self.high[node] - self.low[node]
        if len(order) > leaf_rows and sides.any():
            widest = int(sides.argmax())
            half = np.argpartition(own[:, widest], len(order) // 2)
            self.rows[node] = None
            left = self._grow(order[half[: len(order) // 2]], leaf_rows)
            right = self._grow(order[half[len(order) // 2 :]], leaf_rows)
            self.children[node] = (left, right)
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple]:
        """(query id, ids, scores) of the k best vectors of each query at or above its floor, its own id left out."""
        real = queries.astype(np.float64)
        limit = np.abs(real).max(initial=0.0) * self.largest * max(1, real.shape[1])
        exact = limit < 2.0**53
        bounds = np.maximum(real, 0) @ self.high.T + np.minimum(real, 0) @ self.low.T
        if not exact:
            bounds = np.maximum(bounds + limit * (real.shape[1] + 4) * 2.0**-52, float(NOTHING))
        for i, query_id in enumerate(query_ids.tolist()):
            floor, bound = int(floors[i]), bounds[i]
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                negative, node = heapq.heappop(heap)
                if -negative < floor:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        if bound[child] >= floor:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                rows = self.rows[node]
                scores = (self.vectors[rows] @ real[i]).astype(np.int64) if exact else self._products(rows, queries[i])
                good = (scores >= floor) & (self.ids[rows] != query_id)
                if good.any():
                    best_ids, best = np.append(best_ids, self.ids[rows][good]), np.append(best, scores[good])
                    if len(best) > k:
                        kept = np.lexsort((best_ids, -best))[:k]
                        best_ids, best = best_ids[kept], best[kept]
                    if len(best) == k:
                        floor = max(floor, int(best.min()))
            if len(best):
                yield query_id, best_ids, best

    def _products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        own = query.tolist()
        sums = (sum(a * b for a, b in zip(own, x, strict=True)) for x in self.whole[rows].tolist())
        return np.array([min(max(s, NOTHING), MOST) for s in sums], np.int64)


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double; rows with null or non-finite values left out."""
    wide = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite)
    return rows.select("vec_id", wide.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a table's column; the shards hold vectors of one length only."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy()
    return values.reshape(len(flat), len(values) // max(1, len(flat)))


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id is divisible by every.

    vectors is (vec_id, v). Only vectors of the same length are compared. A query has fewer rows if there are fewer
    candidates, and none if there is none; rows that repeat an id are candidates of their own but for the query of that
    id, and such queries are asked once, with the smallest of their vectors. Empty vectors score 0.
    """
    spark = vectors.sparkSession
    text_batches(spark, NUMBER_BATCH_ROWS)
    vectors = materialise(vectors.withColumn("n", F.size("v")), "vectors")
    sizes = {r["n"]: r["count"] for r in vectors.groupBy("n").count().collect()}  # a row per vector length
    shards = F.lit(1)
    for n, count in sizes.items():
        shards = F.when(F.col("n") == n, max(1, -(-count // shard_rows))).otherwise(shards)
    dealt = vectors.withColumn("shards", shards).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")))
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("n", "v", "shards")).alias("q"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "q.*")
    home = F.pmod(F.xxhash64("query_id", F.lit("home")), F.col("shards"))

    def answer(own: pa.Table, queries: pa.Table) -> pa.Table:
        if not own.num_rows or not queries.num_rows:
            return _HITS.empty_table()
        tree = KdTree(own.column("vec_id").to_numpy(), _matrix(own.column("v")), LEAF_ROWS)
        ids, floors = queries.column("query_id").to_numpy(), queries.column("floor").to_numpy()
        asked_for, parts = _matrix(queries.column("v")), []
        for begin in range(0, len(ids), BLOCK_ROWS):
            block = slice(begin, begin + BLOCK_ROWS)
            for query_id, found, scores in tree.search(ids[block], asked_for[block], floors[block], k):
                parts.append((np.full(len(found), query_id), found, scores))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_HITS)

    def meet(queries: DataFrame, portions: int) -> DataFrame:
        """Each shard with the queries for it, in portions that bound what a task holds; a portion has its own copy."""
        portion = F.pmod(F.xxhash64("query_id", F.lit("portion")), F.lit(portions)).cast("int").alias("portion")
        copies = F.explode(F.sequence(F.lit(0), F.lit(portions - 1))).alias("portion")
        left = dealt.select("n", "shard", "vec_id", "v", copies).groupBy("n", "shard", "portion")
        right = queries.select("n", "shard", "query_id", "v", "floor", portion).groupBy("n", "shard", "portion")
        return left.cogroup(right).applyInArrow(answer, HITS)

    nothing = F.lit(NOTHING).cast("long")
    at_home = materialise(meet(asked.withColumn("shard", home).withColumn("floor", nothing), 1), "home-hits")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = at_home.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    kth = kth.select("query_id", F.col("score").alias("floor"))
    others = asked.withColumn("home", home).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    others = others.withColumn("shard", F.col("shard").cast("long")).where(F.col("shard") != F.col("home"))
    others = others.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", nothing))
    hits = at_home.unionByName(meet(others, -(-max(1, asked.count()) // PORTION_ROWS)))
    ranked = hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
