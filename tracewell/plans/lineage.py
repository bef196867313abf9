"""Cutting lineage of iterative jobs in reliable storage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracewell.session import ensure_checkpoint_dir


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the stored copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
