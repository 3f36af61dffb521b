"""Exact top-k search by inner product: a ball tree in each shard, branch and bound, and waves of shards that share the k-th scores so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, table, written

K, SCALE, EVERY = 5, 256.0, 50
#: Vectors of a shard and of a leaf; queries of a block that a task searches together.
SHARD_ROWS, LEAF, QUERY_BLOCK = 8192, 64, 2048
#: A wave searches so many times as many shards as all waves before it; so there are few waves, and most shards know good scores.
WAVE = 3
#: Leaves that each query visits in an order of its own before all queries share one.
OWN_LEAVES = 3
#: Scores up to here are sums that doubles hold exactly; the largest double and long.
EXACT, MOST, LONG = float(1 << 53), 1.7976931348623157e308, (1 << 63) - 1


def quantised(vectors: DataFrame, *, scale: float = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double, of vectors without null or non-finite components; a product beyond
    the largest double is that double."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(c * F.lit(scale), F.lit(MOST)), F.lit(-MOST)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)).alias("v"))


class BallTree:
    """A binary tree of balls over rows of m, in arrays: node i has centre, radius, the range of its rows and its children."""

    def __init__(self, m: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(m))
        self.centre, self.radius, self.rows, self.children = [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            self._grow(m, 0, len(m), leaf)
        self.m = m[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, m: np.ndarray, a: int, b: int, leaf: int) -> int:
        part = m[self.order[a:b]]
        centre = part.mean(axis=0)
        apart = np.sqrt(((part - centre) ** 2).sum(axis=1))
        node = len(self.rows)
        self.centre.append(centre)
        self.radius.append(apart.max() * (1 + 1e-9))
        self.rows.append((a, b))
        self.children.append(None)
        if b - a > leaf and not apart.max() <= 0:
            one = part[apart.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            along = part @ (other - one)
            cut = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argsort(along, kind="stable")]
            left = self._grow(m, a, a + cut, leaf)
            self.children[node] = (left, self._grow(m, a + cut, b, leaf))
        return node

    def leaf_bounds(self, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, for each query and leaf the largest inner product that a vector of the leaf can have with it, with room for
        rounding): the least bound of the leaf and of all nodes above it."""
        best = q @ self.centre.T + length[:, None] * self.radius
        best = best + 1e-9 * (length[:, None] * (self.radius + np.sqrt((self.centre**2).sum(axis=1)))) + 1e-6
        best = np.where(np.isnan(best), np.inf, best)  # beyond doubles nothing is pruned
        for node, below in enumerate(self.children):  # a node comes before its children
            for child in below or ():
                np.minimum(best[:, child], best[:, node], out=best[:, child])
        leaves = np.array([i for i, below in enumerate(self.children) if below is None])
        return leaves, best[:, leaves]


def dot(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as int64, exact; one beyond a long is the largest or smallest long but one."""
    if not q.size or not m.size:
        return np.zeros((len(q), len(m)), np.int64)
    with np.errstate(over="ignore"):
        most = np.abs(q).max() * np.abs(m).max() * q.shape[1]
    if most < EXACT:
        return (q @ m.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in m], object).T
    return np.array([[max(-LONG, min(LONG, int(x))) for x in r] for r in whole], np.int64)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of each query's k best rows of the tree that reach least, ties to smaller ids.

    Each query visits the leaves with its OWN_LEAVES largest bounds in that order, together with the queries that are at the same leaf;
    then all leaves are gone through once, each by the queries whose bound there still reaches their k-th score.
    """
    ids = ids[tree.order]
    n = len(q)
    length = np.sqrt((q**2).sum(axis=1))
    score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
    found = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    kth = least.astype(np.float64).copy()

    def visit(leaf: int, alive: np.ndarray) -> None:
        a, b = tree.rows[leaf]
        at = np.broadcast_to(ids[a:b], (len(alive), b - a))
        own = at == q_ids[alive][:, None]
        got = dot(q[alive], tree.m[a:b])
        fit = (got >= kth[alive][:, None]) & ~own
        some = fit.any(axis=1)
        if not some.any():
            return
        alive, got, at = alive[some], np.where(fit, got, np.iinfo(np.int64).min)[some], np.where(fit, at, np.iinfo(np.int64).max)[some]
        every, place = np.concatenate([score[alive], got], 1), np.concatenate([found[alive], at], 1)
        best = np.lexsort((place, ~every), axis=1)[:, :k]
        score[alive], found[alive] = np.take_along_axis(every, best, 1), np.take_along_axis(place, best, 1)
        full = found[alive, -1] != np.iinfo(np.int64).max
        kth[alive[full]] = np.maximum(kth[alive[full]], score[alive[full], -1].astype(np.float64))

    if n and len(ids):
        with np.errstate(over="ignore", invalid="ignore"):
            leaves, bound = tree.leaf_bounds(q, length)
            first = np.argsort(-bound, axis=1, kind="stable")[:, :OWN_LEAVES]
            for t in range(first.shape[1]):
                for j in np.unique(first[:, t]):
                    mine = np.flatnonzero((first[:, t] == j) & (bound[:, j] >= kth))
                    if len(mine):
                        visit(int(leaves[j]), mine)
            np.put_along_axis(bound, first, -np.inf, 1)  # visited
            for j in np.argsort(-bound.max(axis=0), kind="stable"):
                mine = np.flatnonzero((bound[:, j] >= kth) & (bound[:, j] > -np.inf))
                if len(mine):
                    visit(int(leaves[j]), mine)
    row, column = np.nonzero(found != np.iinfo(np.int64).max)
    return row, found[row, column], score[row, column]


HITS = "query_id long, query_row long, vec_id long, score long"


def _searcher(k: int, leaf: int):
    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype=np.int64)
        out = []
        for size, part in shard.groupby(shard["v"].map(len)):
            mine = queries[queries["v"].map(len) == size]
            if not len(mine):
                continue
            ids = part["vec_id"].to_numpy(np.int64)
            tree = BallTree(np.stack(part["v"].to_numpy()).astype(np.float64).reshape(len(part), size), leaf)
            for i in range(0, len(mine), 256):
                few = mine.iloc[i : i + 256]
                row, vec, score = search(tree, ids, np.stack(few["v"].to_numpy()).astype(np.float64).reshape(len(few), size), few["vec_id"].to_numpy(np.int64), few["least"].fillna(-np.inf).to_numpy(np.float64), k)
                out.append(pd.DataFrame({"query_id": few["vec_id"].to_numpy(np.int64)[row], "query_row": few["query_row"].to_numpy(np.int64)[row], "vec_id": vec, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype=np.int64)

    return run


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query row, with their rank; a query's hits are at most k from each shard."""
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, scale: float = SCALE, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k vectors with the highest integer inner products for each query: query_id, rank, vec_id, score.

    vectors, queries: vec_id, embedding. Vectors (or queries) that are null or hold null or non-finite components, or
    that have no vec_id, take no part; only vectors of a query's dimension are candidates, and none with the query's
    own vec_id. Repeated rows are different candidates and different queries. With fewer than k candidates all are returned.
    A component whose product with scale is beyond a double counts as the largest double, a score beyond a long as the largest
    long (or its negative), and such scores tie. Empty tables give an empty table; other columns are ignored.

    Vectors are dealt by row into shards of about shard_rows, queries into blocks of about query_block. Each block has its own
    order of the shards and goes through them in waves: one shard, then WAVE times as many as before in each further wave,
    always from the k-th score that all waves before found. A task is a block of queries and a shard; the query set
    meets all rows, so a shard is copied once for each block of queries.
    """
    base = written(quantised(vectors, scale=scale), "vectors")
    asked = written(quantised(queries, scale=scale).withColumn("query_row", F.monotonically_increasing_id()), "queries")
    shards, blocks = parts_for(base.count(), shard_rows), parts_for(asked.count(), query_block)
    base = base.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)))
    run, number = _searcher(k, leaf), lambda x: F.lit(x).cast("long")
    found, first, last = None, 0, 1
    while first < shards:
        start = best(found, k).where(F.col("rank") == k).select("query_row", F.col("score").cast("double").alias("least")) if found is not None else None
        mine = asked.join(start, "query_row", "left") if start is not None else asked.withColumn("least", F.lit(None).cast("double"))
        mine = mine.withColumn("shard", F.explode(F.sequence(number(first), number(last - 1)))).withColumn("shard", F.pmod(F.col("block") + F.col("shard"), number(shards)))
        copies = base.withColumn("block", F.explode(F.sequence(number(0), number(blocks - 1)))).where(F.pmod(F.col("shard") - F.col("block"), number(shards)).between(first, last - 1))
        hits = copies.groupBy("shard", "block").cogroup(mine.groupBy("shard", "block")).applyInPandas(run, HITS)
        found = hits if found is None else best(found.unionByName(hits), k).drop("rank")
        first, last = last, min(shards, last * (WAVE + 1))
        if first < shards:
            found = written(found, "hits")
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
