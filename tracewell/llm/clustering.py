"""Centroid clustering: Lloyd's rounds that rescan only the vectors whose bounds have expired."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.lineage import settle

#: Vectors of a block, whose heaps are kept together.
BLOCK = 4096
#: Components are held within this size, so that squared distances fit into a long.
MOST = 1 << 27
#: Bounds are square roots; a gap this near to the drift counts as expired.
SLACK = 1e-9

STATE = "ids array<bigint>, width int, x binary, cluster binary, at binary, gap binary, sums binary"


def whole_numbers(vector: Column, width: int, scale: int) -> Column:
    """The components as floor(scale * x); null for vectors of another length or with null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(wide, lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return F.when((F.size(vector) == width) & F.coalesce(sound, F.lit(False)), whole)


@dataclass
class Centroids:
    """The centroids of a round and, per cluster, how far bounds have drifted since the first round."""

    x: np.ndarray
    drift: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to all centroids."""
        out = np.empty((len(x), len(self.x)), np.int64)
        for k, c in enumerate(self.x):
            away = x - c
            out[:, k] = np.einsum("ij,ij->i", away, away)
        return out

    def moved(self, to: np.ndarray) -> Centroids:
        """The next round's centroids. A vector of cluster j may lose the distance that j has moved
        and the largest distance that any other centroid has moved."""
        steps = np.sqrt(((to - self.x).astype(float) ** 2).sum(1))
        if len(steps) < 2:
            return Centroids(to, self.drift + steps)
        second, first = np.sort(steps)[-2:]
        others = np.where(np.arange(len(steps)) == int(steps.argmax()), second, first)
        return Centroids(to, self.drift + steps + others)


class Heaps:
    """The vectors of a block: per cluster a heap of (gap, vector), the gap offset by the drift at entry.

    The gap of a vector is how much nearer its centroid is than any other one. While the drift of
    its cluster has not eaten that up, its centroid stays the nearest; only vectors whose gap has
    expired are popped, measured against all centroids and put into the heap of the nearest one.
    """

    def __init__(self, x: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.heaps = x, cluster, heaps

    @classmethod
    def new(cls, x: np.ndarray, k: int) -> Heaps:
        """No vector has a centroid yet: all have expired."""
        return cls(x, np.full(len(x), -1, np.int32), [[(-math.inf, v) for v in range(len(x))]] + [[] for _ in range(k - 1)])

    def expired(self, drift: np.ndarray) -> list[int]:
        out = []
        for heap, gone in zip(self.heaps, drift.tolist(), strict=True):
            limit = gone + SLACK * (1 + abs(gone))
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return out

    def reassign(self, centroids: Centroids) -> np.ndarray:
        """Rescan what has expired; per cluster, by how much the sums of its vectors and their number change."""
        k, width = centroids.x.shape
        change = np.zeros((k, width + 1), np.int64)
        again = np.array(sorted(self.expired(centroids.drift)), np.int64)
        if not len(again):
            return change
        squares = centroids.distances(self.x[again])
        nearest = squares.argmin(1)  # the smaller number of equals
        best = np.sqrt(squares[np.arange(len(again)), nearest].astype(float))
        if k > 1:
            squares[np.arange(len(again)), nearest] = np.iinfo(np.int64).max
            gaps = np.sqrt(squares.min(1).astype(float)) * (1 - 1e-12) - best * (1 + 1e-12)
        else:
            gaps = np.full(len(again), math.inf)
        for v, j, gap in zip(again.tolist(), nearest.tolist(), (gaps + centroids.drift[nearest]).tolist(), strict=True):
            heapq.heappush(self.heaps[j], (gap, v))
        before = self.cluster[again]
        self.cluster[again] = nearest
        moved = before != nearest
        full = np.concatenate([self.x[again[moved]], np.ones((int(moved.sum()), 1), np.int64)], 1)
        np.add.at(change, nearest[moved], full)
        left = before[moved] >= 0
        np.subtract.at(change, before[moved][left], full[left])
        return change

    def row(self, ids: list, change: np.ndarray) -> dict:
        """The block as one row; numbers in as few bytes as hold them."""
        small = np.abs(self.x).max(initial=0) < 1 << 15
        sizes = np.array([len(h) for h in self.heaps], np.int32)
        entries = [e for h in self.heaps for e in h]
        return {
            "ids": ids, "width": self.x.shape[1] * (1 if small else -1), "x": self.x.astype(np.int16 if small else np.int32).tobytes(), "cluster": self.cluster.tobytes(),
            "at": sizes.tobytes() + np.array([v for _, v in entries], np.int32).tobytes(),
            "gap": np.array([g for g, _ in entries], float).tobytes(), "sums": change.tobytes(),
        }

    @classmethod
    def of(cls, row: dict, k: int) -> Heaps:
        kind = np.int16 if row["width"] > 0 else np.int32
        x = np.frombuffer(row["x"], kind).reshape(-1, abs(row["width"])).astype(np.int64)
        held = np.frombuffer(row["at"], np.int32)
        gaps, heaps, at = np.frombuffer(row["gap"]).tolist(), [], 0
        vectors = held[k:].tolist()
        for size in held[:k].tolist():
            heaps.append(list(zip(gaps[at : at + size], vectors[at : at + size], strict=True)))
            at += size
        return cls(x, np.frombuffer(row["cluster"], np.int32).copy(), heaps)


FIELDS = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32())] + [(c, pa.binary()) for c in ("x", "cluster", "at", "gap", "sums")])


def _batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], FIELDS)


def _first(shared, block: int):
    """Blocks of vectors, assigned to their first centroids."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = np.asarray(part.column("x").flatten(), np.int64).reshape(part.num_rows, -1)
                heaps = Heaps.new(x, len(shared.value.x))
                yield _batch(heaps.row(part.column("vec_id").to_pylist(), heaps.reassign(shared.value)))

    return made


def _next(shared):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heaps = Heaps.of(row, len(shared.value.x))
                yield _batch(heaps.row(row["ids"], heaps.reassign(shared.value)))

    return made


def _changes(k: int):
    """Sums of the changes of a task's blocks: (cluster, place, change); place ``width`` counts vectors."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for held in batch.column("sums"):
                one = np.frombuffer(held.as_buffer(), np.int64).reshape(k, -1)
                total = one.copy() if total is None else total + one
        if total is not None:
            cluster, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(total[cluster, place])], names=["cluster", "place", "change"])

    return summed


def _unpacked(shared):
    """The vectors of the blocks with their cluster and exact distance."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heaps = Heaps.of(row, len(shared.value.x))
                away = heaps.x - shared.value.x[heaps.cluster]
                ids, distance = pa.array(row["ids"], pa.int64()), pa.array(np.einsum("ij,ij->i", away, away))
                yield pa.RecordBatch.from_arrays([ids, pa.array(heaps.cluster), distance], names=["vec_id", "cluster", "distance"])

    return rows


def cluster(
    frame: DataFrame, clusters: int = 40, rounds: int = 5, seed: str = "2", width: int = 64, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Assignments (vec_id, cluster, distance) and centroids (cluster, x, members, inertia, total).

    Vectors of ``width`` components, none null or non-finite, take part, as whole numbers
    floor(scale * component); other rows are left out. Components beyond 2**27 count as 2**27, so
    that every sum of squares fits into a long. The first centroids are the vectors with the smallest
    sha256 of ``seed``:id (equal ids by the vector; fewer vectors give fewer clusters); each round
    assigns every vector to its nearest centroid, the smaller number among equals, and replaces
    centroids by the floor of the mean; a last assignment follows. All numbers are exact.

    Each block of vectors is a row with its heaps and travels alone from round to round; a round
    moves between tasks only the changes of the sums, ``clusters`` times ``width`` + 1 numbers a
    task. Rows without id take part but are no first centroids; repeated rows are vectors of their
    own. Without any vector both results have no rows. Every round is stored in the checkpoint
    folder, so a lost executor repeats one round of its blocks.
    """
    spark = frame.sparkSession
    held = frame.select(F.col(key).cast("long").alias("vec_id"), whole_numbers(F.col(vector), width, scale).alias("x")).where(F.col("x").isNotNull())
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = held.where(F.col("vec_id").isNotNull()).select(order.alias("order"), "x").orderBy("order", "x").limit(clusters).collect()
    assigned = "vec_id long, cluster int, distance long"
    described = "cluster int, x array<bigint>, members long, inertia long, total long"
    if not starts:
        return spark.createDataFrame([], assigned), spark.createDataFrame([], described)
    now = Centroids(np.array([r["x"] for r in starts], np.int64), np.zeros(len(starts)))
    k, state = len(starts), None
    sums = np.zeros((k, width + 1), np.int64)
    for number in range(rounds + 1):
        shared = spark.sparkContext.broadcast(now)
        state = settle(held.mapInArrow(_first(shared, block), STATE) if state is None else state.mapInArrow(_next(shared), STATE))
        if number < rounds:
            changes = state.select("sums").mapInArrow(_changes(k), "cluster long, place long, change long")
            for c, place, change in changes.groupBy("cluster", "place").agg(F.sum("change")).collect():
                sums[c, place] += change
            means = sums[:, :-1] // np.maximum(sums[:, -1:], 1)
            now = now.moved(np.where(sums[:, -1:] > 0, means, now.x))
    rows = state.mapInArrow(_unpacked(shared), assigned)
    found = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("distance").alias("inertia")).collect()}
    total = sum(r["inertia"] for r in found.values())
    sizes = [(found[j]["members"], found[j]["inertia"]) if j in found else (0, 0) for j in range(k)]
    return rows, spark.createDataFrame([(j, x, *sizes[j], total) for j, x in enumerate(now.x.tolist())], described)
