"""Exact top-k inner products by no-random-access aggregation (NRA), block by block.

A block of candidates has one list per dimension, sorted by component. For a query, list d is
read from its top if the query's component d is positive, else from its bottom, so that its
contributions to the score descend. After reading to a depth, each candidate has a lower bound
(what was read of it, and the least a list can still give) and an upper bound (the list's
frontier instead). Candidates whose upper bound is below the k-th lower bound, or below the
k-th score found in earlier blocks, are out; reading stops when few are left, and only those
get their final scores. The bounds of all candidates and of a block of queries are computed
together, as products of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, table, written

CANDIDATES, QUERIES = 4096, 256
TILE = 4  # blocks of candidates, and of queries, that meet in one group
DEPTHS = (0.125, 0.5)
SCALE = 64
MOST_COMPONENT = 1 << 20  # components beyond +-2^20 would not be exact in the products of doubles
LEAST_SCORE = -(1 << 63)  # stands for a score that is no long


class SortedLists:
    """A block of candidates: one sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.n = rows, ids, len(ids)
        small = int(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < 1 << 23
        self.kind = np.float32 if small else np.float64
        self.x = x.astype(self.kind)
        order = np.argsort(-self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, order, 0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None], 0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (candidate, query) after `depth` entries of each list; up
        and down hold the queries' positive and negative components."""
        top, bottom = self.rank < depth, self.rank >= self.n - depth
        seen = (self.x * top) @ up.T + (self.x * bottom) @ down.T
        # out is 1 for what has not been read
        out_top, out_bottom = (~top).astype(self.kind), (~bottom).astype(self.kind)
        s = self.sorted
        low = seen + out_top @ (up * s[-1]).T + out_bottom @ (down * s[0]).T
        high = seen + out_top @ (up * s[depth - 1]).T + out_bottom @ (down * s[self.n - depth]).T
        return low, high

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of every candidate that may be among the query's k best, its
        own row left out; bar: the k-th score that the query has elsewhere."""
        big = int(np.abs(queries).max(initial=0)) * int(np.abs(self.x).max(initial=0)) * queries.shape[1] >= 1 << 23
        if big and self.kind is np.float32:
            self.kind, self.x, self.sorted = np.float64, self.x.astype(float), self.sorted.astype(float)
        q = queries.astype(self.kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        own = self.rows[:, None] == query_rows[None, :]
        bar = bar.copy()
        left = ~own
        for share in DEPTHS:
            depth = max(1, int(self.n * share))
            low, high = self.bounds(up, down, depth)
            low[own] = -np.inf
            if self.n > k:
                bar = np.maximum(bar, np.partition(low, self.n - k, axis=0)[self.n - k])
            left &= high >= bar
            if left.sum() <= 8 * k * len(q):
                break
        c, j = np.nonzero(left)
        if len(c) * 4 < left.size:
            score = np.concatenate([np.einsum("ij,ij->i", self.x[c[a : a + 65536]], q[j[a : a + 65536]]) for a in range(0, len(c), 65536)] or [np.zeros(0)])
        else:
            score = (self.x @ q.T)[c, j]
        keep = score >= bar[j]
        return j[keep], self.ids[c[keep]], np.rint(score[keep]).astype(np.int64)


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of raw components, as Python's integers; integers stay."""
    if x.dtype.kind == "i":
        return x.astype(object)
    return np.array([math.floor(v * SCALE) if abs(v) < 1 << 53 else int(v) * SCALE for v in x.ravel().tolist()], object).reshape(x.shape)


def exact_search(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As SortedLists.search, of all candidates, where components are large."""
    a, b, others = _integers(x), _integers(queries), rows[:, None] != query_rows[None, :]
    most_a, most_b = int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))
    if max(most_a, most_b, most_a * most_b * x.shape[1]) < 1 << 63:
        score = a.astype(np.int64) @ b.astype(np.int64).T
    else:
        score = a @ b.T
        if ((score >= 1 << 63) & others).any():
            raise OverflowError("a score among the best is no 64-bit integer")
        score = np.clip(score, LEAST_SCORE, (1 << 63) - 1).astype(np.int64)
    c, j = np.nonzero(others)
    return j, ids[c], score[c, j]


def best(j: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query number, ties to the smaller id, and their rank from 1."""
    order = np.lexsort((ids, -score, j))
    j, ids, score = j[order], ids[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])) if len(j) else np.zeros(0, np.int64)
    rank = np.arange(len(j)) - np.repeat(starts, np.diff([*starts, len(j)])) + 1
    keep = rank <= k
    return j[keep], ids[keep], score[keep], rank[keep]


def _blocks(vectors: DataFrame, block: str, width: int) -> DataFrame:
    """One row a block: its row numbers, ids and integer components, or large ones as they are, as bytes."""

    def pack(found):  # without hints: else all need them
        x = np.zeros((found.num_rows, width))
        v = found.column("_v").combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        row = np.repeat(np.arange(found.num_rows), sizes)
        x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
        if np.abs(x).max(initial=0) < MOST_COMPONENT / SCALE:  # else they stay raw
            x = np.floor(x * SCALE)
            x = x.astype(np.int8 if np.abs(x).max(initial=0) < 128 else np.int32)
        rows, ids = (found.column(c).to_numpy().astype(np.int64).tobytes() for c in ("_row", "_id"))
        return pa.table({block: pa.array([found.column(block)[0].as_py()], pa.int64()), "rows": [rows], "ids": [ids], "x": [x.tobytes()], "kind": [x.dtype.str]})

    return vectors.groupBy(block).applyInArrow(pack, f"{block} long, rows binary, ids binary, x binary, kind string")


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    Components become floor(SCALE * x). A row takes no part if its id or vector is null, or
    if its vector holds a null or non-finite component. Shorter vectors count as ending in
    zeros. Rows may share an id: each is a query of its own, with its own ranking, and a candidate
    of all the others. Vectors with components beyond
    +-MOST_COMPONENT after scaling are in blocks of their own, which go by exact integers; a
    score among the best that is no 64-bit integer is an error. A query with
    fewer than k gets all; equal scores go by id. An empty table gives no rows. `is_query` is
    a condition on the id column; further columns are not read.
    """
    spark = vectors.sparkSession
    importable(spark)
    real = F.transform(vector_col, lambda x: x.cast("double"))
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(ok, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), is_query.alias("_query"), real.alias("_v"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_large", F.exists("_v", lambda x: F.abs(x) >= MOST_COMPONENT / SCALE))
    rows = written(rows, "vectors")
    counts = F.count("*"), F.count_if("_large"), F.count_if("_query"), F.count_if(F.col("_query") & F.col("_large")), F.max(F.size("_v"))
    n, n_large, asking, large_asking, width = rows.agg(*counts).first()
    width = width or 1
    h = F.xxhash64("_row")  # ids may repeat

    def in_blocks(rows: DataFrame, name: str, n: int, n_large: int, size: int) -> tuple[DataFrame, int]:
        """The rows in blocks of some `size`, those of large components in blocks after the others, and the number of blocks."""
        plain, large = -(-(n - n_large) // size), -(-n_large // size)
        block = F.when(F.col("_large"), F.pmod(h, F.lit(large or 1)) + plain).otherwise(F.pmod(h, F.lit(plain or 1)))
        return _blocks(rows.withColumn(name, block), name, width), plain + large

    candidates, n_blocks = in_blocks(rows, "_cb", n, n_large, CANDIDATES)
    asked, n_asked = in_blocks(rows.where("_query"), "_qb", asking, large_asking, QUERIES)
    # the stated queries, in blocks, against all candidates, in blocks: tiles of TILE x TILE blocks meet
    tiles, asked_tiles = -(-n_blocks // TILE) or 1, -(-n_asked // TILE) or 1
    left = candidates.select(F.explode(F.expr(f"sequence(0L, {asked_tiles - 1}L)")).alias("_qt"), F.pmod("_cb", F.lit(tiles)).alias("_ct"), "_cb", "rows", "ids", "x", "kind")
    right = asked.select(F.pmod("_qb", F.lit(asked_tiles)).alias("_qt"), F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")).alias("_ct"), "_qb", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "x", "kind")])
    pairs = left.join(right.hint("shuffle_merge"), ["_qt", "_ct"]).select("_qb", "_cb", *[p + c for p in ("", "q_") for c in ("rows", "ids", "x", "kind")])

    def read(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, ids = (np.frombuffer(row[prefix + c], np.int64) for c in ("rows", "ids"))
        return rows, ids, np.frombuffer(row[f"{prefix}x"], np.dtype(row[f"{prefix}kind"])).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}  # of each block of queries: its rows and ids, and the k best so far of each
        last_block, lists = None, None  # a block of candidates meets the queries of a tile one after the other
        none = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                query_rows, query_ids, q = read(row, "q_")
                old = found.get(row["_qb"], (query_rows, query_ids, none, none, none))[2:]
                bar = np.full(len(query_rows), -np.inf)
                full = np.bincount(old[0], minlength=len(query_rows)) >= k
                last = np.full(len(query_rows), np.inf)
                np.minimum.at(last, old[0], old[2])
                bar[full] = last[full]
                rows, ids, x = read(row, "")
                if "f" in (x.dtype.kind, q.dtype.kind):
                    new = exact_search(rows, ids, x, query_rows, q)
                else:
                    if last_block != row["_cb"]:
                        last_block, lists = row["_cb"], SortedLists(rows, ids, x)
                    new = lists.search(query_rows, q, k, bar)
                found[row["_qb"]] = (query_rows, query_ids, *best(*(np.concatenate(c) for c in zip(old, new, strict=True)), k)[:3])
        for rows, ids, j, other, score in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(rows[j]), pa.array(ids[j]), pa.array(other), pa.array(score)], ["query_row", "query_id", "vec_id", "score"])

    best_of_tiles = pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    rank = F.expr("row_number() over (partition by query_row order by score desc, vec_id)")
    score = F.when(F.col("score") == LEAST_SCORE, F.raise_error(F.lit("a score among the best is no 64-bit integer")).cast("long")).otherwise(F.col("score")).alias("score")
    return best_of_tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def op9_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.i AS i, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.i <> q.i
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
