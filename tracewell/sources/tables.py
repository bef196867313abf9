"""Stored operational tables: scan with a fixed schema, upsert, file inventories, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A stored table read with its declared columns."""
    return spark.read.schema(schema).format(fmt).load(path)


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """An operational table over JDBC, read in ranges of its numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def latest_by_key(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or update by key: of equal keys the row with the highest version stays.

    A ``max_by`` over the row needs no sort and combines before the shuffle.
    """
    rest = [c for c in new.columns if c not in keys and c != version]
    return (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(F.max(version).alias(version), F.max_by(F.struct(*rest), version).alias("__row"))
        .select(*keys, version, *[F.col(f"__row.{c}").alias(c) for c in rest])
    )


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str, target: str) -> None:
    """Merge ``new`` into the table at ``path`` and write the result to ``target``."""
    latest_by_key(spark.read.schema(new.schema).parquet(path), new, keys, version).write.mode("overwrite").parquet(target)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of each file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))
    )


def file_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files per module (first folder) and extension."""
    tail = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(tail, r"\.([A-Za-z0-9]+)$", 1))
    module = F.regexp_extract(path, r"^/?([^/]+)/", 1)
    return (
        paths.select(
            F.when(module == "", "(root)").otherwise(module).alias("module"),
            F.when(extension == "", "(none)").otherwise(extension).alias("extension"),
        )
        .groupBy("module", "extension")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def long_form(section: str, wide: DataFrame) -> DataFrame:
    """One row per named value of a report: section, name, value."""
    names = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in wide.columns]
    return wide.select(F.explode(F.array(*names)).alias("v")).select(F.lit(section).alias("section"), "v.name", "v.value")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def evidence_manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of the contents of ``files`` (path, content), by path; a null content has no hash."""
    return files.select("path", F.sha2(F.col("content"), 256).alias("sha256")).orderBy("path")
