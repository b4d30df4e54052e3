"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries and candidates are cut into blocks; a task has the candidates of one block with, for each dimension,
their order, and answers a block of queries together. Rounds of sorted access go down every list from the end
a query's sign asks for, deeper each time by a factor; candidates seen for the first time get their whole
score (random access, for all queries of the block at once). The bound of what is unseen is the sum over
dimensions of the query's component times the value at the lists' depth. A query stops when the bound is
below its k-th score: equality goes on, since a smaller id may tie. The blocks' answers are then merged.

Components become floor(scale * x). Vectors that are null, empty, or hold null or non-finite components take
no part, nor do null ids. Vectors of different length are never compared. Rows that repeat an id are queries and
candidates of their own: a query leaves out its own row only, and each gives its k rows. Scores are exact while they
fit 63 bits. No query or no candidate: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CANDIDATES, QUERIES, TOGETHER = 16_384, 4_096, 128


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector is there and finite throughout."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class SortedLists:
    """A block of candidates in the order of their ids, and every dimension's order of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x = ids[order], rows[order], x[order]
        self.order = np.argsort(self.x, axis=0, kind="stable")  # ascending
        self.values = np.take_along_axis(self.x, self.order, axis=0)

    def bound(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Most that a candidate can score which is below `depth` in every list."""
        if depth >= len(self.ids):
            return np.full(len(q), -np.inf)
        return np.maximum(q, 0) @ self.values[-1 - depth] + np.minimum(q, 0) @ self.values[depth]

    def top(self, query_rows: np.ndarray, q: np.ndarray, k: int, first_depth: int = 32, factor: int = 4):
        """(query index, candidate index, score) of each query's k best, ties to the smaller id."""
        n, live = len(self.ids), np.arange(len(q))
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1] < 2**53
        x, qs = (self.x, q) if exact else (self.x.astype(np.int64), q.astype(np.int64))
        seen = np.zeros(n, dtype=bool)
        none = np.iinfo(np.int64).min + 1  # whose negative is a number too
        best = np.full((len(q), k), none, dtype=np.int64)
        index = np.full((len(q), k), n, dtype=np.int64)
        depth = first_depth
        while len(live):
            ups, downs = (qs[live] > 0).any(axis=0), (qs[live] < 0).any(axis=0)
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[-depth:, ups].ravel()] = True
            fresh[self.order[:depth, downs].ravel()] = True
            if depth >= n:
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            if len(new):
                score = (qs[live] @ x[new].T).astype(np.int64)
                score[query_rows[live][:, None] == self.rows[new][None, :]] = none
                if len(new) > k:  # all that reach the k-th score; equal ones are told apart below
                    edge = np.partition(score, len(new) - k, axis=1)[:, len(new) - k]
                    often = int((score >= edge[:, None]).sum(axis=1).max())
                    some = np.argpartition(-score, min(often, len(new) - 1), axis=1)[:, :often] if often < len(new) else np.tile(np.arange(len(new)), (len(live), 1))
                else:
                    some = np.tile(np.arange(len(new)), (len(live), 1))
                scores = np.concatenate((best[live], np.take_along_axis(score, some, axis=1)), axis=1)
                places = np.concatenate((index[live], np.where(np.take_along_axis(score, some, axis=1) == none, n, new[some])), axis=1)
                order = np.lexsort((places, -scores), axis=1)[:, :k]
                best[live], index[live] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(places, order, axis=1)
            if depth >= n:
                break
            live = live[(index[live, k - 1] == n) | (best[live, k - 1] <= self.bound(q[live], depth))]
            depth *= factor
        row, column = np.nonzero(index < n)
        return row, index[row, column], best[row, column]


def top_k(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", every=20, k=20, scale=64) -> DataFrame:
    """(query_id, rank, id, score): for every row whose id is divisible by `every`, its k best among all other rows."""
    rows = whole_vectors(vectors, id_col, vector_col).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written: the numbers stay
    n, asked = rows.count(), rows.where(F.col("id") % every == 0).count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    c = F.pmod(F.xxhash64("row"), F.lit(c_blocks)).alias("c")
    q = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(q_blocks)).alias("q")
    candidates = rows.select(F.size("v").alias("d"), c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("q"), F.lit(False).alias("asks"), "id", "row", "v")
    queries = rows.where(F.col("id") % every == 0).select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("c"), q, F.lit(True).alias("asks"), "id", "row", "v")

    def answer(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, numbers, x = table.column("id").to_numpy(), table.column("row").to_numpy(), matrix(table.column("v"))
        own, query_rows, query_ids, qx = SortedLists(ids[~asks], numbers[~asks], x[~asks]), numbers[asks], ids[asks], x[asks]
        out = []
        for at in range(0, len(query_rows), TOGETHER) if len(own.ids) else []:
            row, place, score = own.top(query_rows[at : at + TOGETHER], qx[at : at + TOGETHER], k)
            out.append((query_rows[at + row], query_ids[at + row], own.ids[place], own.rows[place], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, dtype=np.int64)] * 5
        return pa.table({name: pa.array(col, pa.int64()) for name, col in zip(("query_row", "query_id", "id", "row", "score"), columns)})

    found = candidates.unionByName(queries).groupBy("d", "c", "q").applyInArrow(answer, "query_row long, query_id long, id long, row long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
