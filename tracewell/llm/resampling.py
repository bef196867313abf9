"""Importance resampling towards a target distribution: scored by an array of gains, ranked by a radix sort."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import FOLD, utf8
from tracewell.plans.lineage import settle

#: Buckets of hashed features, and words of the longest feature.
BUCKETS, LONGEST = 10_000, 1
#: Words a document needs to be drawn.
LEAST_WORDS = 20
#: Bits of a digit, at most, and records of a block: at least, at most, and the share of all records.
DIGIT = 12
FEWEST, MOST, SHARE = 16_384, 1_000_000, 4_000
#: Copies of a row that are written together.
STEP = 10_000
#: Words and features whose buckets a task remembers.
REMEMBERED = 500_000
#: Bytes that are not part of a word become blanks.
WORD = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in FOLD)


class Features:
    """Buckets of the features of texts: runs of 1 to ``longest`` words, joined by a blank."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """The number of words and the bucket of every feature, repeats included."""
        words = text.translate(WORD).split()
        runs = list(words)
        for n in range(2, self.longest + 1):
            runs += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for run in set(runs).difference(known):
            known[run] = zlib.crc32(run) % self.buckets
        return len(words), np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))


def _counter(buckets: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(features.of(text.as_py())[1], minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    counted = texts.select(utf8("text").alias("text")).mapInArrow(_counter(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log ratio of its smoothed shares, rounded down."""
    b, t_all, s_all = len(source), float(target.sum()), float(source.sum())
    ratio = [(t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)) for t, s in zip(target.tolist(), source.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weigher(shared, longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        features = Features(len(gain), longest)
        for batch in batches:
            rows = [(n, len(at), int(gain[at].sum())) for n, at in (features.of(t.as_py()) for t in batch.column("text"))]
            n_words, n_features, weight = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: str) -> Column:
    """A Gumbel number from the sha256 of seed and id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# The radix sort. A record is a key of two whole numbers (high, low) and a number of copies. Records
# lie in blocks of equal size; a pass sorts each block stably by one digit, and prefix sums over
# (digit, block) say where each run of equal digits goes. So all blocks stay equally full, however
# often a digit occurs.

RUN = "block long, digit long, n long, high binary, low binary, each binary"


def _digits(high: int, low: int) -> list[tuple[str, int, int]]:
    """(column, shift, bits) from the least significant digit on, enough for keys up to ``high`` and ``low``."""
    out = []
    for column, top in (("low", low), ("high", high)):
        bits = top.bit_length()
        for number in range(passes := -(-bits // DIGIT)):
            width = -(-bits // passes)
            out.append((column, number * width, width))
    return out


def _runs(column: str, shift: int, bits: int):
    """One pass over a block: its records in the order of their places, sorted stably by a digit."""

    def sort(block: pa.Table) -> pa.Table:
        order = np.argsort(block["start"].to_numpy(), kind="stable")
        held = {c: [block[c][int(k)].as_py() for k in order] for c in ("high", "low", "each")}
        record = {c: np.concatenate([np.frombuffer(x, np.uint64) for x in held[c]]) for c in held}
        digit = (record[column] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        # counting sort: the place of a record is the number of smaller digits plus that of equal ones before it
        by = np.argsort(digit, kind="stable")
        counts = np.bincount(digit.astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(counts)
        ends = np.cumsum(counts[used])
        record = {c: x[by] for c, x in record.items()}
        cuts = list(zip((ends - counts[used]).tolist(), ends.tolist(), strict=True))
        columns = {"block": pa.array(np.full(len(used), block["block"][0].as_py(), np.int64)), "digit": pa.array(used), "n": pa.array(counts[used])}
        for c in ("high", "low", "each"):
            columns[c] = pa.array([record[c][a:b].tobytes() for a, b in cuts], pa.binary())
        return pa.table(columns)

    return sort


def _dealt(size: int):
    """Runs cut where a block of the next order ends."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, end = row["start"], row["start"] + row["n"]
                while a < end:
                    b = min(end, (a // size + 1) * size)
                    part = slice(8 * (a - row["start"]), 8 * (b - row["start"]))
                    out.append((a // size, a, *(row[c][part] for c in ("high", "low", "each"))))
                    a = b
            if out:
                block, start, high, low, each = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), pa.array(start, pa.int64()), *(pa.array(x, pa.binary()) for x in (high, low, each))],
                    names=["block", "start", "high", "low", "each"],
                )

    return deal


PIECE = "block long, start long, high binary, low binary, each binary"


def _packed(size: int, high: int, low: int):
    """Records of a task as runs of at most ``size``; keys count from the smallest ones, ``high`` and ``low``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                columns = {"n": pa.array([part.num_rows], pa.int64())}
                for c, base in (("high", high), ("low", low), ("each", 0)):
                    held = np.asarray(part.column(c)).view(np.uint64) - np.uint64(base % 2**64)
                    columns[c] = pa.array([held.tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return pack


def _upto(column: str, order: str, *within: str) -> Column:
    """The sum of a column over all rows before this one."""
    window = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _placed(runs: DataFrame, size: int) -> DataFrame:
    """Runs of a pass with their destinations, cut into the blocks of the next order.

    The offset of (digit, block) is the number of records with smaller digits plus those with the
    same digit in earlier blocks. Totals per digit are at most 2**DIGIT rows.
    """
    counts = runs.select("digit", "block", "n")
    base = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", _upto("n", "digit").alias("base"))
    offsets = counts.withColumn("earlier", _upto("n", "block", "digit")).join(F.broadcast(base), "digit")
    offsets = offsets.select("digit", "block", (F.col("base") + F.col("earlier")).alias("start"))
    moved = runs.join(offsets, ["digit", "block"])
    return moved.select("start", "n", "high", "low", "each").mapInArrow(_dealt(size), PIECE)


def _ranked(high: int, low: int):
    def rank(block: pa.Table) -> pa.Table:
        """The records of a sorted block, and how many copies stand before each of them there."""
        order = np.argsort(block["start"].to_numpy(), kind="stable")
        record = {c: np.concatenate([np.frombuffer(block[c][int(k)].as_py(), np.uint64) for k in order]) for c in ("high", "low", "each")}
        each = record["each"].view(np.int64)
        columns = {"block": np.full(len(each), block["block"][0].as_py(), np.int64), "before": np.cumsum(each) - each, "each": each}
        for c, base in (("high", high), ("low", low)):
            columns[c] = (record[c] + np.uint64(base % 2**64)).view(np.int64)
        return pa.table(columns)

    return rank


def radix_sort(records: DataFrame, block: int | None = None) -> DataFrame:
    """(high, low, each, before) for longs (high, low, each), each key (high, low) once.

    ``each`` says how many copies a key stands for, ``before`` how many copies have smaller keys.
    Keys count from the smallest on, least significant digits come first, and digits that no key
    needs are left out. Every pass is stored, so a lost executor repeats at most one.
    """
    bounds = [f(c).alias(f"{c}_{name}") for c in ("high", "low") for name, f in (("least", F.min), ("most", F.max))]
    top = records.agg(F.count(F.lit(1)).alias("n"), *bounds).first()
    size = block or max(FEWEST, min(MOST, top["n"] // SHARE))
    high, low = top["high_least"] or 0, top["low_least"] or 0
    packed = records.select("high", "low", "each").mapInArrow(_packed(size, high, low), "n long, high binary, low binary, each binary")
    # the first order is that in which tasks hold the records
    held = settle(packed.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nr"), "*"))
    tasks = held.groupBy("task").agg(F.sum("n").alias("n")).select("task", _upto("n", "task").alias("base"))
    starts = held.select("task", "nr", _upto("n", "nr", "task").alias("up")).join(tasks, "task")
    starts = starts.select("nr", (F.col("base") + F.col("up")).alias("start"))
    now = held.join(starts, "nr").select("start", "n", "high", "low", "each").mapInArrow(_dealt(size), PIECE)
    for column, shift, bits in _digits((top["high_most"] or 0) - high, (top["low_most"] or 0) - low):
        now = _placed(settle(now.groupBy("block").applyInArrow(_runs(column, shift, bits), RUN)), size)
    ranked = settle(now.groupBy("block").applyInArrow(_ranked(high, low), "block long, before long, each long, high long, low long"))
    blocks = ranked.groupBy("block").agg(F.sum("each").alias("n")).select("block", _upto("n", "block").alias("base"))
    return ranked.join(F.broadcast(blocks), "block").select("high", "low", "each", (F.col("base") + F.col("before")).alias("before"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: str = "2024", buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``.

    A document's weight is the sum of the gains of its features: log ratios of the smoothed shares
    of their buckets in ``target`` and in ``docs``. Its score adds a Gumbel number drawn from its id,
    so that the highest scores are a sample without replacement in proportion to the weights. Of the
    documents with an id and at least ``least_words`` words, ``percent`` of a hundred (rounded down)
    are drawn; ``rank`` counts them from 1 by falling score, ties to the smaller id, and is null for
    all others.

    Null and empty texts have no features and weight 0. A row without doc_id has no score and is not
    drawn. Rows with equal id and score are ranked one after the other, by words and features; an
    empty ``target`` gives all of its buckets the same share; an empty table gives no rows. doc_id is
    read as a long; other columns than doc_id and text are not read. Gains are an array of
    ``buckets`` numbers that every task holds; scores are sorted in blocks that no key can fill.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    gain = spark.sparkContext.broadcast(gains(bucket_counts(target, buckets, longest), bucket_counts(texts, buckets, longest)))
    weighed = texts.mapInArrow(_weigher(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    # equal rows are one record with copies
    alike = weighed.groupBy("doc_id", "n_words", "n_features", "weight").agg(F.count(F.lit(1)).alias("rows"))
    alike = settle(alike.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = (alike.where(able).agg(F.sum("rows")).first()[0] or 0) * percent // 100
    keys = alike.where(able).groupBy((-F.col("score")).alias("high"), F.col("doc_id").alias("low")).agg(F.sum("rows").alias("each"))
    places = radix_sort(settle(keys)).select((-F.col("high")).alias("score"), F.col("low").alias("doc_id"), "before")
    turn = Window.partitionBy("doc_id", "score").orderBy("n_words", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.where(able).join(places, ["doc_id", "score"]).withColumn("first", F.col("before") + F.coalesce(F.sum("rows").over(turn), F.lit(0)))
    every = ranked.unionByName(alike.where(~able), allowMissingColumns=True)
    # copies come back in steps, so that no task writes all copies of one row
    stepped = every.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / STEP)))).repartition("doc_id", "step")
    left = F.least(F.col("rows") - F.col("step") * STEP, F.lit(STEP))
    single = stepped.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    rank = F.col("first") + F.col("step") * STEP + F.col("turn")
    return single.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
