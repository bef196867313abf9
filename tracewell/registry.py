"""Extension points: named value generators, extractors and SQL functions of the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Generator = Callable[..., Column]
Extractor = Callable[[DataFrame], DataFrame]


class Generators:
    """Name → column builder; a later registration replaces an earlier one."""

    def __init__(self, builtin: dict[str, Generator] | None = None):
        self._known: dict[str, Generator] = dict(builtin or {})

    def register(self, name: str, generator: Generator) -> None:
        self._known[name] = generator

    def get(self, name: str) -> Generator:
        return self._known.get(name) or self._known["text"]

    def names(self) -> list[str]:
        return sorted(self._known)


class Extractors:
    """Named extractors over (file, text) tables; their entities are merged."""

    def __init__(self):
        self._known: dict[str, Extractor] = {}

    def register(self, name: str, extractor: Extractor) -> None:
        self._known[name] = extractor

    def names(self) -> list[str]:
        return sorted(self._known)

    def extract(self, files: DataFrame) -> DataFrame:
        """(file, extractor, entity, mentions) of all extractors."""
        merged = None
        for name, extractor in sorted(self._known.items()):
            part = extractor(files).select("file", F.lit(name).alias("extractor"), "entity").where(F.col("entity") != "")
            merged = part if merged is None else merged.unionByName(part)
        if merged is None:
            raise ValueError("no extractor registered")
        return merged.groupBy("file", "extractor", "entity").agg(F.count(F.lit(1)).alias("mentions"))


def register_function(spark: SparkSession, name: str, function, return_type: str) -> None:
    """Make a user function callable from SQL text (vectorised functions preferred)."""
    if hasattr(function, "evalType"):
        spark.udf.register(name, function)
    else:
        spark.udf.register(name, function, return_type)
