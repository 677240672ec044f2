"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Queries and candidates are cut into blocks of bounded size. A tile (query block by candidate
block) multiplies the int8 forms of its vectors; the products are exact integers, held in float32
so that the matrix product runs at full speed. With the quantisation errors they bound every
distance from both sides. The k-th smallest upper bound of a query is a threshold that no
neighbour's lower bound exceeds, so only pairs below it are computed again, in double precision
from the original vectors. Each query keeps a heap of its nearest; heaps of tiles are merged by a
ranking that is limited on both sides of the shuffle. Nothing is approximated away: the result is that of an exhaustive search.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

QUERY_BLOCK = 2048
#: Values (rows by dimensions) of a candidate block at most, and rows of a block before there are more blocks than needed.
BLOCK_VALUES = 1 << 22
LEAST_ROWS = 512
#: Distances that a tile holds at a time.
TILE_VALUES = 1 << 22
#: Dimensions whose int8 products still sum up exactly in float32.
EXACT_DIMS = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and for each row the length of what rounding left out."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q.astype(np.int8), scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows (as float32), a slice of dimensions at a time."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS] @ b[:, at : at + EXACT_DIMS].T
    return out


def tile(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``(query row, candidate id, distance)``: the k nearest of each query in one tile."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        return _tile(q_id, q, c_id, c, k)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows to a vector, summed in the order of the components; where the squares leave the range
    of doubles, of both scaled by a power of two."""
    d = np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1])
    odd = ~np.isfinite(d) | (d < 1e-140)
    if odd.any():
        most = np.maximum(np.abs(x[odd]).max(1), np.abs(y).max())
        scale = np.exp2(np.frexp(most)[1].astype(float) - 1)[:, None]  # differences fit in, too
        d[odd] = np.sqrt(np.cumsum((x[odd] / scale / 2 - y / scale / 2) ** 2, axis=1)[:, -1]) * scale[:, 0] * 2
    return d


def _tile(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    found = []
    step = max(1, TILE_VALUES // len(c))
    cq, c_scale, c_error = quantise(c)
    c_wide = cq.astype(np.float32)
    c_near = cq.astype(np.float64) * c_scale[:, None]
    c_square = (c_near**2).sum(1)
    for at in range(0, len(q), step):
        part, ids = q[at : at + step], q_id[at : at + step]
        qq, q_scale, q_error = quantise(part)
        q_square = ((qq.astype(np.float64) * q_scale[:, None]) ** 2).sum(1)
        square = q_square[:, None] + c_square[None, :] - 2 * products(qq.astype(np.float32), c_wide) * q_scale[:, None] * c_scale[None, :]
        near = np.sqrt(np.maximum(square, 0))
        # beside the quantisation errors, what double precision may lose in the sums above
        slack = q_error[:, None] + c_error[None, :] + 1e-7 * (np.sqrt(q_square)[:, None] + np.sqrt(c_square)[None, :]) + 1e-130
        other = ids[:, None] != c_id[None, :]
        upper = near + slack
        upper = np.where(other & ~np.isnan(upper), upper, np.inf)  # bounds beyond the range tell nothing
        kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(part), np.inf)
        for i, j in enumerate(~((near - slack) > kth[:, None]) & other):
            rows = np.flatnonzero(j)
            d = distances(c[rows], part[i])
            heap = heapq.nsmallest(k, zip(d.tolist(), c_id[rows].tolist()))
            found.extend((at + i, v, s) for s, v in heap)
    return found


def _usable(embedding: str) -> Column:
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``(query_id, rank int, vec_id, score double)``: of each query row its ``k`` nearest rows by
    Euclidean distance, ties to the smaller id; all candidates if there are fewer than ``k``.

    Candidates are all rows but those with the query's own id. Vectors that are null, zero, empty
    or hold null or non-finite components take no part, nor do null ids. Vectors are only compared
    with those of equal length. A row that repeats an id with another vector is a candidate of its
    own; query rows that repeat an id are one query, whose nearest are those of all its rows, each pair
    of rows counting for itself. An empty table gives an empty result.

    Blocks are dealt by hash, so groups of equal vectors spread. The candidates' tiles are shuffled
    once for each query block and the queries' once for each candidate block; block sizes bound
    what a task holds.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    slim = written(slim.where(F.col("id").isNotNull() & _usable("x")).withColumn("d", F.size("x")), "vectors")
    dims = [r.asDict() for r in slim.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("m")).collect()]
    dims = [r for r in dims if r["m"]]
    empty = slim.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    spread = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda r: max(math.ceil(r["n"] * r["d"] / block_values), min(spread, r["n"] // LEAST_ROWS), 1)
    blocks = [F.struct(F.lit(r["d"]).alias("d"), F.lit(count(r)).alias("cb"), F.lit(math.ceil(r["m"] / query_block)).alias("qb")) for r in dims]
    plan = F.try_element_at(F.filter(F.array(*blocks), lambda b: b["d"] == F.col("d")), F.lit(1))
    placed = slim.select("*", plan.alias("p"), F.xxhash64("id", "x").alias("h")).where("p is not null")
    own = lambda n: F.pmod("h", F.col(f"p.{n}")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"p.{n}") - 1))
    candidates = placed.select("d", "id", "x", F.lit(False).alias("query"), own("cb").alias("c"), all_of("qb").alias("b"))
    queries = placed.where("q").select("d", "id", "x", F.lit(True).alias("query"), all_of("cb").alias("c"), own("qb").alias("b"))
    dealt = candidates.unionByName(queries)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["query"].to_numpy(bool)
        found: list[tuple[int, int, float]] = []
        ids = group["id"].to_numpy(np.int64)
        if asks.any() and not asks.all():
            x = np.stack(group["x"].to_numpy())
            found = tile(ids[asks], x[asks], ids[~asks], x[~asks], k)
        row = np.array([i for i, _, _ in found], np.int64)
        return pd.DataFrame({"query_id": ids[asks][row], "vec_id": np.array([v for _, v, _ in found], np.int64), "score": np.array([s for _, _, s in found], float)})

    heaps = dealt.groupBy("d", "c", "b").applyInPandas(run, "query_id long, vec_id long, score double")
    # the best k of each task go on, and of those the best k: no query's heaps are gathered in one place
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
