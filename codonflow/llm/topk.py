"""Exact top-k inner-product search with a KD-tree in each shard."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.llm.common import parts, stored, tidy

SAFE = 2.0**52
LONG = (-(1 << 63), (1 << 63) - 1)
BLOCKS_A_TREE = 64
PARTIAL = "qrow long, query_id long, vec_id long, score long"


@dataclass
class KdTree:
    """Nodes in arrays; a leaf has child -1 and the rows start .. stop of ``points``."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, leaf: int = 64) -> KdTree:
    """Median splits on the widest side of each node's tight bounding box."""
    order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids))]
    child: list[int] = []
    while len(nodes) < len(todo):
        a, b = todo[len(nodes)]
        p = points[order[a:b]]
        low, high = p.min(0), p.max(0)
        nodes.append((low, high, a, b))
        if b - a <= leaf or not len(low) or (low == high).all():
            child.append(-1)
            continue
        axis, mid = int((high - low).argmax()), (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(p[:, axis], mid)]
        child.append(len(todo))
        todo += [(a, a + mid), (a + mid, b)]
    return KdTree(ids[order], points[order], np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array(child), np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes]))


def search(tree: KdTree, query_id: int, q: np.ndarray, bounds: np.ndarray, k: int, kth: int) -> list[tuple[int, int]]:
    """Best-first over nodes by their bound, down to the kth score so far; ``kth`` is one known from elsewhere. (score, id), best first.

    A node whose bound equals the kth score is still opened, since its ids may win the tie.
    """
    best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
    queue = [(-bounds[0], 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        floor = max(kth, best[0][0]) if len(best) == k else kth
        if -bound < floor:
            break
        first = tree.child[node]
        if first >= 0:
            for c in (first, first + 1):
                if bounds[c] >= floor:
                    heapq.heappush(queue, (-bounds[c], int(c)))
            continue
        a, b = tree.start[node], tree.stop[node]
        scores = clamped(tree.points[a:b] @ q)
        near = np.flatnonzero((scores >= floor) & (tree.ids[a:b] != query_id))
        for i in near:
            x = (int(scores[i]), -int(tree.ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, x)
            elif x > best[0]:
                heapq.heapreplace(best, x)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def clamped(x: np.ndarray) -> np.ndarray:
    """Python integers cut to the range of a long; doubles are within it by ``exact``."""
    return np.minimum(np.maximum(x, LONG[0]), LONG[1]) if x.dtype == object else x


def exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if every product sum is an exact double, else as Python integers."""
    top = (np.abs(points).max(initial=0) + 1.0) * (np.abs(queries).max(initial=0) + 1.0) * max(1, points.shape[1])
    if top < SAFE:
        return points, queries
    as_int = np.vectorize(int, otypes=[object])
    return (as_int(points) if points.size else points.astype(object)), (as_int(queries) if queries.size else queries.astype(object))


def search_block(tree: KdTree, block: tuple, k: int) -> pd.DataFrame:
    rows, ids, queries, kths = block
    width = max(queries.shape[1], tree.points.shape[1])
    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))  # noqa: E731  a shorter vector goes on with zeros
    points, queries = exact(wide(tree.points), wide(queries))
    low, high = wide(tree.low), wide(tree.high)
    if points.dtype == object:
        low, high = np.vectorize(int, otypes=[object])(low), np.vectorize(int, otypes=[object])(high)
    tree = KdTree(tree.ids, points, low, high, tree.child, tree.start, tree.stop)
    bounds = clamped(np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T)
    out = [(r, i, v, s) for r, i, q, b, kth in zip(rows, ids, queries, bounds, kths, strict=True) for s, v in search(tree, i, q, b, k, kth)]
    return pd.DataFrame(out, columns=["qrow", "query_id", "vec_id", "score"]).astype("int64")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v; without null ids, null vectors, and null or non-finite components."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


@tidy
def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_rows: int = 8192, block_rows: int = 256) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id.
    Ties go to the smaller id; fewer candidates than k give fewer rows. Vectors that are null or hold null
    or non-finite components, and rows without an id, take no part. Of vectors of different lengths the
    shorter goes on with zeros; empty vectors score 0. Repeated ids are separate candidates, and each
    repeated query row gets its own answer. Scores beyond a long are clamped to its range.

    Rows are hashed to shards of about ``shard_rows``; each is one task's KD-tree. Queries travel in
    blocks; a first pass over one shard finds each query's kth score so far, which then bounds the
    traversal in all other shards. A task loads a shard's tree once for up to ``BLOCKS_A_TREE`` blocks.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col).withColumn("qrow", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-n // (every * block_rows)))

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        width = max(map(len, pdf["v"]), default=0)
        out = np.zeros((len(pdf), width))
        for i, x in enumerate(pdf["v"]):
            out[i, : len(x)] = x
        with np.errstate(over="ignore"):
            return np.nan_to_num(np.floor(out * scale))

    def to_tree(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(build(pdf["vec_id"].to_numpy(), matrix(pdf)))]})

    trees = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "qrow"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(to_tree, "shard int, tree binary")
    trees = stored(trees, "trees")

    def to_block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kth = pdf["kth"].fillna(LONG[0]).astype("int64").tolist() if "kth" in pdf else [LONG[0]] * len(pdf)
        return pd.DataFrame({"block": [key[0]], "queries": [pickle.dumps((pdf["qrow"].tolist(), pdf["vec_id"].tolist(), matrix(pdf), kth))]})

    def answer(batches):
        tree = None
        for pdf in batches:
            for is_tree, data in zip(pdf["block"] < 0, pdf["data"], strict=True):
                if is_tree:
                    tree = pickle.loads(data)
                else:
                    yield search_block(tree, pickle.loads(data), k)

    def answers(asked: DataFrame) -> DataFrame:
        """Scores of ``asked`` (block, shard, queries): each tree goes before the blocks that ask it."""
        part = F.floor(F.col("block") / BLOCKS_A_TREE).cast("int")
        asked = asked.select("shard", part.alias("part"), "block", F.col("queries").alias("data"))
        copies = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_A_TREE)))
        both = asked.union(trees.select("shard", copies.alias("part"), F.lit(-1).alias("block"), F.col("tree").alias("data")))
        both = both.repartition(parts(spark), "shard", "part").sortWithinPartitions("shard", "part", "block")
        return both.select("block", "data").mapInPandas(answer, PARTIAL)

    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("qrow"), F.lit(blocks)).cast("int"))
    seeds = queries.groupBy("block").applyInPandas(to_block, "block int, queries binary").withColumn("shard", F.pmod("block", F.lit(shards)))
    first = stored(answers(seeds), "seeded")
    kth = first.groupBy("qrow").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select("qrow", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    known = queries.join(kth, "qrow", "left").groupBy("block").applyInPandas(to_block, "block int, queries binary")
    every_shard = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != F.pmod("block", F.lit(shards)))
    rest = answers(every_shard)
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return first.union(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
