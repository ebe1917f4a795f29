"""Exact top-k inner product search: ball trees per shard, branch and bound.

Method: vectors become integers; each shard holds a block of them under a ball
tree.  A query walks a shard's nodes in the order of the largest inner product
a ball allows (q.c + |q| r) and stops when that falls below its current kth
score.  That score starts from the query's home shard and goes with the query
to every other shard; a task that searches several shards carries the best found
so far from one to the next.  Trees are built once and written; queries go in
blocks of bounded size, tasks return their k best and the best of those are kept.

Sums are exact: products are summed in float64 while the largest possible sum
stays below 2^52, else in Python integers; what a long can't hold becomes its extreme.  Only vectors of a query's own
dimension are compared.

Defined cases: null vectors, and vectors with null or non-finite components,
take no part, nor do rows with a null id; a query's candidates are all rows but
its own, so other rows of its id are among them, and every row of an id is a
query and a candidate by itself; equal scores go to the smaller vec_id; fewer
candidates give fewer ranks; an empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.workspace import materialize

K = 10
SCALE = 1024
EVERY = 100
#: Vectors of a shard, about, and of a leaf at most.
SHARD_ROWS, LEAF = 8192, 64
#: Components of the queries that are broadcast at once: 16 MB.
BLOCK_VALUES = 1 << 21
_EXACT = float(1 << 52)


@dataclass
class Ball:
    center: np.ndarray
    radius: float
    rows: np.ndarray | None
    left: Ball | None = None
    right: Ball | None = None


@dataclass
class Shard:
    """A block of vectors with its tree; places tell rows apart."""

    tree: Ball
    points: np.ndarray
    ids: np.ndarray
    places: np.ndarray


def build(points: np.ndarray, rows: np.ndarray) -> Ball:
    """A ball tree: parts are split between two far points until they fit a leaf."""
    own = points[rows]
    center = own.mean(axis=0)
    radius = float(np.sqrt(((own - center) ** 2).sum(axis=1).max()))
    if len(rows) <= LEAF or radius == 0:
        return Ball(center, radius, rows)
    a = own[((own - center) ** 2).sum(axis=1).argmax()]
    b = own[((own - a) ** 2).sum(axis=1).argmax()]
    side = own @ (b - a)
    order = np.argsort(side, kind="stable")
    half = len(rows) // 2
    return Ball(center, radius, None, build(points, rows[order[:half]]), build(points, rows[order[half:]]))


def exact_scores(points: np.ndarray, query: np.ndarray) -> list[int]:
    """Integer inner products; points and query are float64 with whole values."""
    if np.abs(query).max(initial=0) * np.abs(points).max(initial=0) * max(1, len(query)) < _EXACT:
        return (points @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [sum(int(x) * y for x, y in zip(p, q, strict=True)) for p in points]


def search(shard: Shard, query: np.ndarray, place: int, k: int, floor: float, best: list[tuple[int, int]]) -> None:
    """Add to best, a heap of the k best (score, -id) so far, what of a shard reaches floor and beats it; ties to the smaller id."""
    tree, points, ids, places = shard.tree, shard.points, shard.ids, shard.places
    norm = float(np.sqrt((query**2).sum()))
    slack = 1e-9

    def bound(ball: Ball) -> float:
        value = float(query @ ball.center) + norm * ball.radius
        return value + slack * (abs(value) + norm * (float(np.abs(ball.center).max(initial=0)) + ball.radius) + 1)

    queue = [(-bound(tree), 0, tree)]
    tick = 1
    while queue:
        above, _, ball = heapq.heappop(queue)
        kth = best[0][0] if len(best) == k else -math.inf
        if -above < max(kth, floor):
            break
        if ball.rows is None:
            for child in (ball.left, ball.right):
                heapq.heappush(queue, (-bound(child), tick, child))
                tick += 1
            continue
        for i, score in zip(ball.rows, exact_scores(points[ball.rows], query), strict=True):
            if places[i] == place or score < floor:
                continue
            entry = (score, -int(ids[i]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, dim, v (floor(scale * x) as doubles), without rows that take no part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x")).where("vec_id is not null and x is not null and not exists(x, y -> y is null)")
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0)).alias("v"))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """vectors(vec_id, dim, v) -> query_id, rank, vec_id, score for the rows that are queries."""
    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("is_query", is_query).withColumn("place", F.monotonically_increasing_id()), "vectors")
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "place"), F.lit(shards)))
    out = None
    for dim in (r.dim for r in vectors.select("dim").distinct().collect()):  # a row for each dimension
        trees = materialize(placed.where(F.col("dim") == dim).groupBy("shard").applyInArrow(_planted(dim), "shard long, tree binary"), "trees")
        queries, after, most = vectors.where((F.col("dim") == dim) & F.col("is_query")), -1, max(1, BLOCK_VALUES // max(1, dim))
        while True:
            block = queries.where(F.col("place") > after).orderBy("place").limit(most).select("vec_id", "v", "place").toArrow()
            if not block.num_rows:
                break
            after = block.column(2)[-1].as_py()
            ids, places = block.column(0).to_numpy(), block.column(2).to_numpy()
            points = _stack(block.column(1).combine_chunks(), dim) if dim else np.empty((len(ids), 0))
            homes = _run(trees, spark, (ids, places, points, None), k, shards)
            kth = homes.groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).collect()  # at most a row for each query of the block
            floor = np.full(len(ids), -np.inf)
            for r in kth:
                floor[r["at"]] = r.kth
            found = _run(trees, spark, (ids, places, points, floor), k, shards)
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _planted(dim: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def plant(key: tuple, table: pa.Table) -> pa.Table:
        ids, places = table.column("vec_id").to_numpy(), table.column("place").to_numpy()
        points = _stack(table.column("v").combine_chunks(), dim) if dim else np.empty((len(ids), 0))
        shard = Shard(build(points, np.arange(len(ids))), points, ids, places)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(shard)], pa.binary())})

    return plant


def _run(trees: DataFrame, spark: SparkSession, block: tuple, k: int, shards: int) -> DataFrame:
    """Best candidates of each query of the block: from its home shard alone, or at the floors given from all shards of a task."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, points, floor = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            for number, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = pickle.loads(tree.as_buffer())
                for at in range(len(ids)) if floor is not None else range(number, len(ids), shards):
                    search(shard, points[at], places[at], k, -math.inf if floor is None else floor[at], best[at])
        rows = [(int(ids[at]), int(places[at]), at, -i, min(max(score, -(2**63)), 2**63 - 1)) for at, own in enumerate(best) for score, i in own]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "place", "at", "vec_id", "score"])

    return trees.select("shard", "tree").mapInArrow(run, "query_id long, place long, at long, vec_id long, score long")


def embedding_neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Each query's k highest integer inner products; queries are rows whose vec_id is divisible by every."""
    vectors = whole_vectors(embeddings)
    return top_k(vectors, F.col("vec_id") % every == 0, k)


NEIGHBOURS_SQL = f"""with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.r <> c.r where q.vec_id % {EVERY} = 0
), r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= {K}"""
