"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import FOLD, labelled_sample, packed, slices, utf8, with_row
from tracewell.plans.lineage import settle

#: Lengths of the byte n-grams.
LENGTHS = (3, 4, 5, 6)
#: N-grams are hashed into 2**BITS cells.
BITS = 20
#: Labelled rows that are read for training, at most.
SAMPLE = 16_000
#: Documents of the sample that hold a cell of the linear model, at least.
LEAST = 3
#: Bytes of text that are turned into n-grams at once.
CHUNK = 1_500_000
#: Parts of the sample, whose size is bounded.
PARTS = 16
#: Stretches of the cells whose sums are added up by a task each.
STRETCHES = 4
#: Rows whose cells a task unpacks together.
BLOCK = 256
#: Passes of the fit over the sample, at most; steps that are remembered; and the gradient, relative
#: to the first one, that ends the fit.
PASSES, MEMORY, ENOUGH = 60, 5, 1e-4
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are not letters, and bytes of letters of other alphabets, told apart: the rest is a blank.
LETTERS = bytes(x if x in b"abcdefghijklmnopqrstuvwxyz" or x >= 0x80 else 0x20 for x in FOLD)


def normal(text: bytes) -> bytes:
    """Folded words between single blanks."""
    return b" " + b" ".join(text.translate(LETTERS).split()) + b" "


def cells(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, cells) for each n-gram length: the cell of the n-gram that starts at each byte of ``data``."""
    code = np.zeros(len(data), np.uint64)
    for length in range(1, max(LENGTHS) + 1):
        n = len(data) - length + 1
        if n <= 0:
            return
        code = (code[:n] << np.uint64(8)) | data[length - 1 :].astype(np.uint64)
        if length in LENGTHS:
            salted = (code + np.uint64(length * 0xD6E8FEB86659FD93 % 2**64)) * MIX
            yield length, (salted >> np.uint64(64 - BITS)).astype(np.int32)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, where each text begins and the last one ends) of runs of whole texts; a blank at each end parts them."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(normal(text))
        size += len(held[-1])
        if size >= CHUNK or k == len(texts) - 1:
            edges = np.cumsum([0, *map(len, held)])
            yield first, np.frombuffer(b"".join(held), np.uint8), edges
            first, held, size = k + 1, [], 0


def distinct(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The cells of each text, each once, in any order.

    Every place writes its number into the stamp of its cell; of the places with one cell the last
    one finds its own number there. A text above ``CHUNK`` marks its cells piece by piece instead.
    """
    stamp = np.zeros(1 << BITS, np.int32)
    for _, data, edges in chunks(texts):
        if len(data) > 2 * CHUNK and len(edges) == 2:
            marked = np.zeros(1 << BITS, bool)
            for at in range(0, len(data), CHUNK):
                for _, found in cells(data[at : at + CHUNK + max(LENGTHS) - 1]):
                    marked[found] = True
            yield np.flatnonzero(marked).astype(np.int32)
            continue
        found = list(cells(data))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            every = np.concatenate([np.empty(0, np.int32), *(x[a : max(b - length + 1, a)] for length, x in found)])
            places = np.arange(len(every), dtype=np.int32)
            stamp[every] = places
            yield every[stamp[every] == places]


@dataclass
class Model:
    """Weights of all cells (0 for those left out) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = self.intercept + np.fromiter((self.weights[cell].sum(dtype=float) for cell in distinct(texts)), float, len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def pressed(cell: np.ndarray) -> bytes:
    """Ascending cells in two bytes each, after how many have each value of the bits above."""
    return np.bincount(cell >> 16, minlength=1 << (BITS - 16)).astype(np.int32).tobytes() + (cell & 0xFFFF).astype(np.uint16).tobytes()


def unpressed(held: bytes) -> np.ndarray:
    tops = np.frombuffer(held, np.int32, 1 << (BITS - 16))
    return np.frombuffer(held, np.uint16, offset=tops.nbytes) + np.repeat(np.arange(len(tops), dtype=np.int32) << 16, tops)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each text of the sample, made once and packed."""
    for batch in slices(batches):
        held = [pressed(np.sort(cell)) for cell in distinct(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(held, pa.binary())], names=["label", "cells"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, cells of one row after the other, cells per row) of at most ``BLOCK`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            held = [unpressed(x) for x in part.column("cells").to_pylist()]
            yield np.asarray(part.column("label"), float), np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))


def _pieces(part: int, total: np.ndarray) -> pa.RecordBatch:
    """The sums of a task in ``STRETCHES`` pieces, each a row of its own."""
    held = np.array_split(total, STRETCHES, axis=-1)
    columns = [pa.array(range(STRETCHES), pa.int32()), pa.array([part] * STRETCHES, pa.int32()), pa.array([x.tobytes() for x in held], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["piece", "part", "total"])


PIECES = "piece int, part int, total binary"


def _added(kind, wide):
    """One stretch of the sums of all tasks, in the order of the tasks so that reruns agree."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")
        out = sum(np.frombuffer(x.as_py(), kind).astype(wide) for x in rows.column("total"))
        return pa.table({"piece": rows.column("piece")[:1].cast(pa.int32()), "total": pa.array([out.tobytes()], pa.binary())})

    return add


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a cell, per task."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for label, cell, sizes in blocks(batches):
        of = np.repeat(label, sizes)
        for side in (0, 1):
            counts[side] += np.bincount(cell[of == side], minlength=1 << BITS)
    yield _pieces(TaskContext.get().partitionId(), counts)


def _sums(frame: DataFrame, shape: tuple[int, ...], kind, wide) -> np.ndarray:
    """The sum of the tasks' arrays (piece, part, total); added up by tasks, so the driver gets it once."""
    found = frame.repartition(STRETCHES, "piece").groupBy("piece").applyInArrow(_added(kind, wide), "piece int, total binary").collect()
    held = [np.frombuffer(x, wide).reshape(*shape[:-1], -1) for _, x in sorted(map(tuple, found))]
    return np.concatenate(held, axis=-1)


@dataclass
class Loss:
    """Where a pass stands: the scaled weights of the kept cells, the intercept, and what a row of either class counts."""

    weights: np.ndarray
    intercept: float
    each: tuple[float, float]


def _pass(kept, shared):
    """The loss of a task's rows and its gradient: one number per kept cell, then that of the intercept and the loss."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, weights = shared.value, np.zeros(1 << BITS)
        weights[kept.value] = now.weights
        total, rest = np.zeros(1 << BITS), np.zeros(2)
        for label, cell, sizes in blocks(batches):
            raw = np.full(len(label), now.intercept)
            some = np.flatnonzero(sizes)
            if len(some):
                raw[some] += np.add.reduceat(weights[cell], (np.cumsum(sizes) - sizes)[some])
            count = np.where(label == 1, now.each[1], now.each[0])
            error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - label) * count
            total += np.bincount(cell, np.repeat(error, sizes), 1 << BITS)
            rest += error.sum(), (count * (np.logaddexp(0, raw) - label * raw)).sum()
        yield _pieces(TaskContext.get().partitionId(), np.concatenate([total[kept.value], rest]).astype(np.float32))

    return summed


def descent(loss, start: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Minimise ``loss(x) -> (value, gradient)`` by limited-memory BFGS with halved steps; each value is one pass."""
    x, (value, gradient) = start, loss(start)
    first, done, steps = float(np.abs(gradient).max()), 1, []
    while done < passes and np.abs(gradient).max() > ENOUGH * first:
        way, held = -gradient, []
        for s, y, rho in reversed(steps):
            held.append(rho * (s @ way))
            way = way - held[-1] * y
        if steps:
            way = way * ((steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]))
        for (s, y, rho), a in zip(steps, reversed(held), strict=True):
            way = way + s * (a - rho * (y @ way))
        length = 1.0 if steps else min(1.0, 1.0 / max(float(np.abs(gradient).sum()), 1e-12))
        slope = float(gradient @ way)
        while done < passes:
            new = x + length * way
            value_new, gradient_new = loss(new)
            done += 1
            if value_new <= value + 1e-4 * length * slope:
                s, y = new - x, gradient_new - gradient
                if s @ y > 1e-12:
                    steps = [*steps, (s.astype(np.float32), y.astype(np.float32), 1.0 / (s @ y))][-MEMORY:]
                x, value, gradient = new, value_new, gradient_new
                break
            length /= 2
            if length < 1e-9:  # nothing better within the precision of the sums
                return x
    return x


def fit(sample: DataFrame, strength: float = 1.0, passes: int = PASSES) -> Model:
    """Train on (text, label) over all cells that ``LEAST`` documents hold; constant if either class is missing.

    The n-grams of the sample are made once and stored; counting and the passes of the fit read
    them where they lie, and the tasks' sums are added up by tasks. A task holds the cells of ``BLOCK``
    rows, the driver and each task a few numbers per cell.
    """
    spark = sample.sparkSession
    rows = settle(sample.coalesce(PARTS).mapInArrow(_rows, "label int, cells binary"))  # each part makes a sum per cell
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(np.zeros(1 << BITS), 5.0 if n_toxic else -5.0)
    clean, toxic = _sums(rows.mapInArrow(_counter, PIECES), (2, 1 << BITS), np.int32, np.int32)
    ratios = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0))
    cell = np.flatnonzero((clean + toxic >= LEAST) & (ratios != 0))
    cell = cell.astype(np.int32)
    kept, ratios = spark.sparkContext.broadcast(cell), ratios[cell]
    n, decay = n_toxic + n_clean, strength * 1e-4
    each = tuple((0.5 + 0.5 * n / (2 * of)) / n for of in (n_clean, n_toxic))  # halfway to balanced classes

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(Loss((x[:-1] * ratios).astype(np.float32), float(x[-1]), each))
        total = _sums(rows.mapInArrow(_pass(kept, shared), PIECES), (len(cell) + 2,), np.float32, np.float64)
        shared.destroy()
        gradient = total[:-1].copy()
        gradient[:-1] = gradient[:-1] * ratios + decay * x[:-1]
        return float(total[-1] + 0.5 * decay * (x[:-1] @ x[:-1])), gradient

    start = np.zeros(len(cell) + 1)
    start[-1] = np.log(n_toxic / n_clean)
    found = descent(loss, start, passes)
    kept.destroy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[cell] = found[:-1] * ratios
    return Model(weights, float(found[-1]))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "score"])

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for every row of ``docs``; only the text is read, a null like an empty one.

    An empty text gets the score of the intercept. Repeated rows get equal scores; an empty table
    gives no rows. Texts are cut into n-grams whole, a run of texts at a time.
    """
    frame = packed(docs, utf8("text").alias("text"))
    return frame.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), with_row(frame, "score double"))


def train(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = SAMPLE) -> Model:
    """Fit on at most ``limit`` labelled documents (``labels.toxic``) whose labels are ``usable``."""
    return fit(labelled_sample(docs, labels, "toxic", usable, limit))
