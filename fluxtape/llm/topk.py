"""Exact top-k inner-product search by ball-tree branch and bound in every shard.

Queries are taken in blocks of fixed size, so the block that is sent to the
executors has a proven bound; each block meets every vector once.  A task cuts its
vectors into trees of bounded size.  A tree's nodes are visited in order of their
upper bound ``q . centre + |q| radius``, and a query leaves a node as soon as that
bound falls below its current k-th score.  The k-th score is shared: a few rows and then
one of EARLY parts of all rows are searched first, and what they give is the floor that
every other shard starts from; inside a task each tree starts from what the trees before
it found.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, release, scratch_path

#: Queries sent to the executors at a time.
BLOCK = 16384
#: One of so many parts of the rows is searched first.
EARLY = 16
#: Vectors in one tree, and in one of its leaves.
TREE, LEAF = 16384, 64
#: Vectors of the first pass, whose k-th scores are the floor for all shards.
FLOOR_ROWS = 4096


class BallTree:
    """Balls over the rows of ``points``, split at the median of the widest dimension."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self._build(0, len(points), leaf)

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        own = self.points[self.order[lo:hi]]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append((centre, radius, lo, hi, -1, -1))
        if hi - lo > leaf and radius > 0:
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, wide], mid)]
            left = self._build(lo, lo + mid, leaf)
            right = self._build(lo + mid, hi, leaf)
            self.nodes[at] = (centre, radius, lo, hi, left, right)
        return at


class Best:
    """The k best (score, id) of each query so far; ``floor`` is a score known to be reached."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``ids`` with ``scores[row, id]`` to the queries ``rows``; -inf is no offer."""
        keep = min(self.k, scores.shape[1])
        if keep < scores.shape[1]:
            edge = np.partition(scores, scores.shape[1] - keep, axis=1)[:, -keep]
            wide = int((scores >= edge[:, None]).sum(axis=1).max())  # ties at the edge stay in
            top = np.argpartition(-scores, wide - 1, axis=1)[:, :wide] if wide < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(rows), 1))
            scores, ids = np.take_along_axis(scores, top, axis=1), ids[top]
        else:
            ids = np.tile(ids, (len(rows), 1))
        both = np.hstack([self.scores[rows], scores])
        who = np.hstack([self.ids[rows], np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids)])
        order = np.lexsort((who, -both), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(both, order, axis=1)
        self.ids[rows] = np.take_along_axis(who, order, axis=1)
        self.floor[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])


def search(tree: BallTree, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, best: Best) -> int:
    """Offer a tree's rows to all queries; returns how many scores were computed."""
    lengths = np.sqrt((queries**2).sum(axis=1))
    slack = 1e-9 * (1.0 + lengths * max((np.sqrt((n[0] ** 2).sum()) + n[1] for n in tree.nodes[:1]), default=0.0))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        return queries[rows] @ centre + lengths[rows] * radius + slack[rows]

    everyone = np.arange(len(queries))
    first = bound(0, everyone)
    heap, tick, scored = [(-first.max(), 0, 0, everyone, first)], 1, 0
    while heap:
        _, _, node, rows, bounds = heapq.heappop(heap)
        rows = rows[bounds >= best.floor[rows]]
        if not len(rows):
            continue
        _, _, lo, hi, left, right = tree.nodes[node]
        if left < 0:
            at = tree.order[lo:hi]
            scores = queries[rows] @ tree.points[at].T
            scores[ids[at][None, :] == own[rows][:, None]] = -np.inf
            scored += scores.size
            scores[scores < best.floor[rows][:, None]] = -np.inf
            hit = ~np.isneginf(scores).all(axis=1)
            if hit.any():
                best.add(rows[hit], scores[hit], ids[at])
            continue
        for child in (left, right):
            upper = bound(child, rows)
            near = upper >= best.floor[rows]
            if near.any():
                heapq.heappush(heap, (-upper[near].max(), tick, child, rows[near], upper[near]))
                tick += 1
    return scored


def _scaled(column: str, scale: int):
    """floor(scale * x) of each component as double; null where a component is null or not finite."""
    values = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(F.col(column).isNotNull() & ~bad, values)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _search_block(vectors: DataFrame, sent, k: int) -> DataFrame:
    """Each shard's best rows for a block of queries (ids, matrix by width, floor by width)."""

    def run(batches):
        state, waiting = {}, {}

        def flush(width: int) -> None:
            ids = np.concatenate([x[0] for x in waiting[width]])
            points = np.concatenate([x[1] for x in waiting[width]])
            del waiting[width]
            own, queries, floor = sent.value[width]
            if width not in state:
                state[width] = Best(len(own), k, floor)
            for lo in range(0, len(ids), TREE):
                search(BallTree(points[lo : lo + TREE]), ids[lo : lo + TREE], own, queries, state[width])

        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                if int(width) in sent.value:
                    part = batch.filter(pa.array(sizes == width))
                    waiting.setdefault(int(width), []).append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), int(width))))
                    if sum(len(x[0]) for x in waiting[int(width)]) >= TREE:
                        flush(int(width))
        for width in list(waiting):
            flush(width)
        for width, best in state.items():
            q, r = np.nonzero(~np.isneginf(best.scores))
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[width][0][q]), pa.array(best.ids[q, r]), pa.array(best.scores[q, r].astype(np.int64))], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows but itself, ties to the smaller vec_id.

    ``vectors(vec_id, embedding)``; ``is_query`` is a condition over vec_id.  Components
    become floor(scale * x); the score is their inner product, exact while it stays
    below 2**53.  Vectors that are null, empty, or hold a null or non-finite component, and
    rows without a vec_id, take no part; vectors of different length are not compared.
    Rows repeated with one vec_id are one candidate each time they occur, but never for a query
    of the same vec_id, and a repeated query is answered once, with the smallest of
    its vectors.  Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), _scaled("embedding", scale).alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    asked = vectors.where(is_query).select(F.col("vec_id").cast("bigint").alias("vec_id"), _scaled("embedding", scale).alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    head = clean.limit(FLOOR_ROWS).toPandas()  # bounded: a floor for the k-th scores
    total = asked.count()
    blocks = -(-total // BLOCK)
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    path = scratch_path(spark, "topk") if blocks > 1 else ""
    early = F.pmod(F.xxhash64("vec_id", F.lit("early")), F.lit(EARLY)) == 0
    for b in range(blocks):
        own = asked.where(F.col("block") == b).select("vec_id", "v").toPandas()  # about BLOCK rows
        sent = _block(own, head, k)
        # the k-th scores of a share of the rows are a floor for all the other shards
        some = materialize(_ranked(_search_block(clean.where(early), spark.sparkContext.broadcast(sent), k), k), "early")
        floors = some.where(F.col("rank") == k).select("query_id", "score").toPandas()  # about BLOCK rows
        sent = _raised(sent, dict(zip(floors.query_id, floors.score)))
        rest = _search_block(clean.where(~early), spark.sparkContext.broadcast(sent), k)
        found = _ranked(rest.unionByName(some.drop("rank")), k)
        if blocks == 1:
            return found
        found.write.mode("append").parquet(path)
        release(some)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(path)


def _raised(block: dict, floors: dict) -> dict:
    """A block with floors as high as those of ``floors``, by query."""
    return {width: (ids, queries, np.maximum(floor, [floors.get(i, -np.inf) for i in ids.tolist()])) for width, (ids, queries, floor) in block.items()}


def _block(own: pd.DataFrame, head: pd.DataFrame, k: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    for width, part in own.groupby(own.v.map(len)):
        ids, queries = part.vec_id.to_numpy(np.int64), np.stack(part.v.to_numpy())
        floor = np.full(len(ids), -np.inf)
        seen = head[head.v.map(len) == width] if len(head) else head
        if len(seen):
            best = Best(len(ids), k, floor)
            search(BallTree(np.stack(seen.v.to_numpy())), seen.vec_id.to_numpy(np.int64), ids, queries, best)
            floor = best.floor
        out[int(width)] = (ids, queries, floor)
    return out
