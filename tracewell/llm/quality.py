"""Quality: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import FOLD, labelled_sample, packed, utf8, with_row

#: Words are hashed into so many columns, after those of the statistics.
WORD_COLUMNS = 1 << 14
#: Length of the factors.
RANK = 8
#: Labelled rows that are read for training, at most.
SAMPLE = 16_000
#: Edges that turn a statistic into one of several indicator columns.
EDGES = {
    "words": (1, 5, 10, 20, 50, 100, 200, 500, 2000),
    "chars": (1, 50, 200, 1000, 5000, 20000),
    "word_length": (2, 3, 4, 5, 6, 7, 9, 12, 20),
    "upper": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.0001, 0.005, 0.02, 0.1, 0.3),
    "marks": (0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "odd_marks": (0.0005, 0.002, 0.01, 0.03, 0.1),
    "lines": (0.0001, 0.001, 0.005, 0.02, 0.1),
    "other": (0.01, 0.05, 0.1, 0.2, 0.5),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "repeats": (0.001, 0.01, 0.05, 0.2, 0.5),
    "top_word": (0.02, 0.05, 0.1, 0.2, 0.4),
    "marked_words": (0.02, 0.1, 0.2, 0.3, 0.5, 0.8),
    "alone": (0.001, 0.01, 0.05, 0.2),
}
STARTS = np.cumsum([0] + [len(e) + 1 for e in EDGES.values()])
COLUMNS = int(STARTS[-1]) + WORD_COLUMNS
#: Classes of bytes: upper, lower, digit, usual marks, odd marks, line end, blank, other alphabets.
KIND = np.full(256, 4, np.uint8)
KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[ord("0") : ord("9") + 1] = 0, 1, 2
KIND[list(b".,;:?'\"()-")], KIND[[10, 13]], KIND[[9, 32]], KIND[128:] = 3, 5, 6, 7
ENDS = frozenset(b"!?*#$%&|@~^=+<>/\\_{}[]")


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, size = len(words), len(text)
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=8) / max(size, 1)
    per = max(n, 1)
    again = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(c for w, c in counts.items() if w[-1] in ENDS)
    alone = sum(c for w, c in counts.items() if len(w) == 1 and w[0] in ENDS)
    return [
        n, size, sum(map(len, words)) / per, kinds[0], kinds[2], kinds[3] + kinds[4], kinds[4], kinds[5], kinds[7],
        len(counts) / per, again / per, max(counts.values(), default=0) / per, marked / per, alone / per,
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of one text: an indicator per statistic, and hashed words with root counts of unit length."""
    words = text.split()
    folded = Counter(text.translate(FOLD).split())
    stats = statistics(text, words, folded)
    columns = [int(STARTS[k]) + int(np.searchsorted(edges, stats[k], "right")) for k, edges in enumerate(EDGES.values())]
    hashed = [int(STARTS[-1]) + xxhash.xxh3_64_intdigest(w.strip(b".,;:!?")) % WORD_COLUMNS for w in folded]
    weight = np.sqrt(np.fromiter(folded.values(), float, len(folded)))
    weight *= 1.0 / max(np.sqrt((weight**2).sum()), 1e-9)
    return np.array(columns + hashed, np.int64), np.concatenate([np.full(len(columns), 0.5), weight])


@dataclass
class Model:
    """Bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums: sum over pairs of <v_i, v_j> x_i x_j
        is half of (sum v x)^2 - sum (v x)^2, so a text costs its number of columns only."""
        parts = self.factors[columns] * values[:, None]
        sums = np.add.reduceat(parts, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(parts**2, starts)).sum(1)
        return self.bias + np.add.reduceat(self.linear[columns] * values, starts) + pairs, sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for k in range(0, len(texts), 256):
            made = [features(t) for t in texts[k : k + 256]]
            starts = np.cumsum([0] + [len(c) for c, _ in made[:-1]])
            raw, _ = self.raw(np.concatenate([c for c, _ in made]), np.concatenate([v for _, v in made]), starts)
            out[k : k + 256] = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
        return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> Model:
    """Adagrad over mini-batches of (label, columns, values); constant if either class is missing."""
    labels = np.array([r[0] for r in rows], float)
    draw = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(COLUMNS), draw.normal(0, 0.01, (COLUMNS, RANK)))
    if not len(rows) or labels.min() == labels.max():
        return Model(0.0 if not len(rows) else (5.0 if labels[0] else -5.0), np.zeros(COLUMNS), np.zeros((COLUMNS, RANK)))
    model.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    weight = np.where(labels == 1, 0.5 + 0.25 / labels.mean(), 0.5 + 0.25 / (1 - labels.mean()))
    g_bias, g_linear, g_factors = 1e-6, np.full(COLUMNS, 1e-6), np.full((COLUMNS, RANK), 1e-6)
    for _ in range(epochs):
        for part in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 128)):
            columns = np.concatenate([rows[i][1] for i in part])
            values = np.concatenate([rows[i][2] for i in part])
            sizes = np.array([len(rows[i][1]) for i in part])
            raw, sums = model.raw(columns, values, np.cumsum(sizes) - sizes)
            error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - labels[part]) * weight[part] / len(part)
            each = np.repeat(error, sizes) * values
            used, slot = np.unique(columns, return_inverse=True)
            d_linear = np.bincount(slot, each) + decay * model.linear[used]
            d_factors = np.empty((len(used), RANK))
            spread = np.repeat(sums, sizes, 0) - model.factors[columns] * values[:, None]
            for k in range(RANK):
                d_factors[:, k] = np.bincount(slot, each * spread[:, k])
            d_factors += decay * model.factors[used]
            d_bias = float(error.sum())
            g_bias += d_bias**2
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            model.bias -= rate * d_bias / np.sqrt(g_bias)
            model.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= 0.3 * rate * d_factors / np.sqrt(g_factors[used])
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([c.astype(np.int32) for c, _ in made], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32())),
            ],
            names=["label", "columns", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = SAMPLE) -> Model:
    """Fit on at most ``limit`` labelled documents (``labels.quality``) whose labels are ``usable``."""
    made = labelled_sample(docs, labels, "quality", usable, limit).mapInArrow(_rows, "label int, columns array<int>, values array<float>")
    got = made.toArrow()
    rows = []
    for batch in got.to_batches():
        for label, columns, values in zip(batch.column("label").to_pylist(), batch.column("columns"), batch.column("values"), strict=True):
            rows.append((label, columns.values.to_numpy().astype(np.int64), values.values.to_numpy().astype(float)))
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return fit(rows)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "score"])

    return score


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for every row of ``docs``; only the text is read, a null like an empty one.

    The metadata used are length and line structure; id, source and language never are. Repeated
    rows get equal scores; an empty table gives no rows. Cost is linear in the words of a text.
    """
    frame = packed(docs, utf8("text").alias("text"))
    return frame.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), with_row(frame, "score double"))
