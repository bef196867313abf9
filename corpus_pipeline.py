"""The corpus pipeline: filter, dedup, decontaminate and mix ``documents``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, jaccard, lines, mixing, toxicity
from tracewell.llm.common import is_remainder, table
from tracewell.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    It learns from labels of ids outside the held-out fifth. Every row of ``docs`` is scored by its
    text alone; null and empty texts and rows without id are scored like any other.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~is_remainder("doc_id", 5, 0))
    return toxicity.toxicity(docs, model).where(F.col("score") < 0.5).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds; a document of which nothing is left goes.

    ``n_chars`` is brought up to date where text was deleted. Untouched rows stay as they are, also
    those with a null or empty text or without id.
    """
    edited = lines.dedup(docs).where((F.col("n_deleted") < F.col("n_words")) | (F.col("n_words") == 0))
    touched = F.col("n_deleted") > 0
    new = {"text": F.when(touched, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(touched, size).otherwise(F.col("row.n_chars"))
    return edited.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows without words or without id are in no group and stay; rows that repeat a kept id stay with it.
    """
    groups = jaccard.join(docs)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than one word in twenty stands in a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row per document in it: doc_id, source, size, source_size, target, copies, taken.

    Documents that the mix does not take have no row; ``copies`` says how often a document is repeated.
    """
    mixed = mixing.mix(docs).where(F.col("copies") > 0)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", keep_clean),
    ("line_dedup", cut_repeats),
    ("jaccard_join", keep_one),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier and the alignment are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    shared = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
