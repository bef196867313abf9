"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.plans.lineage import settle

#: ASCII case folding for byte strings; all other letters stay as they are.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def remainder(column: str, divisor: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def is_remainder(column: str, divisor: int, value: int) -> Column:
    """Whether crc32 of the column as text leaves ``value``; false for a null."""
    return F.coalesce(remainder(column, divisor) == value, F.lit(False))


def utf8(column: str) -> Column:
    """A text as bytes, empty for a null: what the Python stages read without decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, so that no name can clash, and ``more``."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *more)


def with_row(frame: DataFrame, fields: str) -> T.StructType:
    """Schema of ``row`` followed by the fields written in ``fields``."""
    return T.StructType([frame.schema["row"], *T.StructType.fromDDL(fields).fields])


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, types[k]) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents, chosen by a hash of the id and stored.

    The ids are limited before the join, so the broadcast side is bounded by ``limit``. Rows without
    id or label are left out; an id with several labels counts with the largest, an id with several
    texts with the smallest.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.lit(11), F.col("doc_id")), "doc_id")
        .limit(limit)
    )
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chosen = found.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return settle(chosen.select(F.col("text").cast("binary").alias("text"), "label"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
