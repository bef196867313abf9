"""Exact top-k inner products by no-random-access aggregation over sorted component lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are collected and broadcast at once.
QUERY_BLOCK = 4096
#: Candidates whose lists are sorted together, and queries that read them together.
ROWS, TOGETHER = 4096, 256
#: Shares of a list that have been read when bounds are compared.
DEPTHS = (0.2, 0.35, 0.5, 0.7)
#: Outsiders left per query row, as a share, at which their final scores are resolved.
FEW = 0.02


def whole_vectors(frame: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, x): components as floor(scale * x). Null ids, null vectors and vectors with null or
    non-finite components are left out; of rows with one id the smallest vector stays."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = frame.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    made = kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale).cast("long")).alias("x"))
    return made.groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(rows: list, width: int) -> np.ndarray:
    """Rows of any length as a matrix; a missing component counts as 0."""
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        row = np.asarray(row, float)[:width]
        out[k, : len(row)] = row
    return out


class Lists:
    """The components of a block of candidates as sorted lists.

    A query reads list j downwards if its component is positive, else upwards. After a share of
    every list is read, a component that was not met is at best the last one read (the frontier) and
    at worst the end of the list, so the bounds of all rows are two products with clipped matrices.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.ordered = x, np.sort(x, 0)

    def bounds(self, depth: float, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        read = min(n, max(1, math.ceil(n * depth)))
        top, bottom = self.ordered[n - read], self.ordered[read - 1]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        upper = np.maximum(self.x, top) @ up.T + np.minimum(self.x, bottom) @ down.T
        met_top = np.where(self.x >= top, self.x, self.ordered[0])
        met_bottom = np.where(self.x <= bottom, self.x, self.ordered[-1])
        return met_top @ up.T + met_bottom @ down.T, upper


def read_lists(lists: Lists, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the rows that may be among the k best; ``floor`` holds k-th scores known so far."""
    mine = ids[:, None] == own[None, :]
    for depth in DEPTHS:
        lower, upper = lists.bounds(depth, queries)
        lower[mine] = -np.inf
        if len(ids) >= k:
            floor = np.maximum(floor, np.partition(lower, len(ids) - k, 0)[len(ids) - k])
        open_ = (upper >= floor) & ~mine
        if open_.mean() <= FEW:
            break
    row, query = np.nonzero(open_)
    scores = np.einsum("ij,ij->i", lists.x[row], queries[query])
    order = np.lexsort((ids[row], -scores, query))
    row, query, scores = row[order], query[order], scores[order]
    starts = np.searchsorted(query, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        a, b = starts[q], min(starts[q] + k, starts[q + 1])
        if b > a:
            yield q, ids[row[a:b]], scores[a:b]


def _searcher(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        best_ids = [np.empty(0, np.int64) for _ in own]
        best = [np.empty(0) for _ in own]
        floor = np.full(len(own), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = np.asarray(part.column("vec_id"))
                lists = Lists(matrix(part.column("x").to_pylist(), queries.shape[1]))
                for q0 in range(0, len(own), TOGETHER):
                    some = slice(q0, q0 + TOGETHER)
                    for q, found, scores in read_lists(lists, ids, queries[some], own[some], k, floor[some]):
                        q += q0
                        all_ids, all_scores = np.append(best_ids[q], found), np.append(best[q], scores)
                        keep = np.lexsort((all_ids, -all_scores))[:k]
                        best_ids[q], best[q] = all_ids[keep], all_scores[keep]
                        if len(keep) == k:
                            floor[q] = best[q][-1]
        sizes = [len(b) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, sizes)), pa.array(np.concatenate(best_ids)), pa.array(np.concatenate(best).astype(np.int64))],
                names=["query_id", "vec_id", "score"],
            )

    return search


def top_k(frame: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k largest integer inner products.

    Candidates are all rows but those with the query's id; ties go to the smaller id; fewer than k
    candidates give fewer rows. ``whole_vectors`` says which rows take part; vectors of unequal
    length are compared as if filled with zeros. Queries are dealt into blocks of about
    ``query_block``, each broadcast in turn, and every task keeps k rows per query, so neither the
    driver nor a task holds more than a block. An empty table gives no rows.
    """
    spark = frame.sparkSession
    vectors = whole_vectors(frame, key, vector)
    queries = vectors.where(is_query)
    blocks = max(1, math.ceil(queries.count() / query_block))
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
        width = max((len(r["x"]) for r in rows), default=0)
        shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), matrix([r["x"] for r in rows], width)))
        part = vectors.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
