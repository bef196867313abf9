"""Audit-log files: lenient and strict scans, part facts, sealing."""

from __future__ import annotations

import hashlib
import hmac as hmac_lib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.plans import ordered
from tracewell.schemas import AUDIT_EVENT

PART_GLOB = "audit-*.jsonl"


def read_lines(spark: SparkSession, log_dir: str) -> DataFrame:
    """Raw lines of all parts with the part name."""
    return (
        spark.read.option("pathGlobFilter", PART_GLOB)
        .option("recursiveFileLookup", "true")
        .text(log_dir)
        .select(F.col("_metadata.file_name").alias("part"), F.col("value").alias("line"))
    )


def read_events(spark: SparkSession, log_dir: str) -> DataFrame:
    """Events of a capture; blank, malformed and non-object lines are dropped."""
    return parse_lines(read_lines(spark, log_dir))


def _is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def _is_object(line: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT")


def parse_lines(lines: DataFrame, schema: T.StructType = AUDIT_EVENT) -> DataFrame:
    """Lenient parse of (part, line, ...) rows into typed events."""
    clean = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & _is_object(F.col("line")))
    others = [c for c in lines.columns if c != "line"]
    return clean.select(*others, F.from_json("line", schema).alias("e")).select(*others, "e.*")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Strict scan of (part, line_no, line) rows: one row per line that must not occur."""
    line = F.trim("line")
    version = F.get_json_object(line, "$.v")
    reason = (
        F.when(line == "", None)
        .when(~_is_json(line), "invalid JSON")
        .when(~_is_object(line), "JSON not object")
        .when(version.isNull() | ~version.isin("v1", "v2"), "unexpected v")
    )
    return lines.select("part", "line_no", reason.alias("reason")).where(F.col("reason").isNotNull())


def part_facts(events: DataFrame) -> DataFrame:
    """Manifest facts per part: range of sequence numbers, border hashes, size.

    Expects part, seq_global, hash and line_bytes; rows with sequence 0 only count for the size.
    """
    seq = F.when(F.col("seq_global") != 0, F.col("seq_global"))
    return events.groupBy("part").agg(
        F.sum("line_bytes").alias("bytes"),
        F.min(seq).alias("seq_start"),
        F.max(seq).alias("seq_end"),
        F.min_by("hash", seq).alias("first_hash"),
        F.max_by("hash", seq).alias("last_hash"),
    )


def file_digests(spark: SparkSession, log_dir: str, pattern: str = PART_GLOB) -> DataFrame:
    """SHA-256 and size of each file; parts are rotated by size, so one fits a task."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(log_dir)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("part"),
            F.sha2("content", 256).alias("file_sha256"),
            F.col("length").alias("bytes"),
        )
        .orderBy("part")
    )


def counters(events: DataFrame) -> DataFrame:
    """Sessions (counted as parts) and events of each capture."""
    return events.groupBy("capture_id").agg(
        F.count_distinct("part").alias("session_count"), F.count(F.lit(1)).alias("event_count")
    )


# Field order of the v1 payload.
V1_FIELDS = (
    "v seq_global ts_ms type actor session_id seq_session capture_id capture_session_uuid dir n "
    "data_b64 sig norm_sha256 norm_len screen_sig screen_sample key_b64 key_text key_kind input_len "
    "contains_newline contains_escape is_probable_paste is_probable_command logical_parts "
    "screen_raw_b64 screen_source screen_snapshot_ts_ms screen_snapshot_age_ms source prev_hash "
    "rows cols term encoding geometry_source"
).split()


def payload_v1(fields: dict[str, Column]) -> Column:
    """``key=value`` lines in fixed order; a missing value is empty, booleans read True/False."""
    parts = []
    for name in V1_FIELDS:
        value = fields.get(name, F.lit(None).cast("string"))
        text = F.initcap(value.cast("string")) if name.startswith(("contains_", "is_probable_")) else value.cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(text, F.lit("")), F.lit("\n")))
    return F.concat(*parts)


def _lower_escapes(json_text: Column) -> Column:
    """Write control-character escapes with lower-case hex digits."""

    def lowered(text: Column) -> Column:
        out = text
        for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
        return F.when(text.rlike(r"\\u00[01][A-F]"), out).otherwise(text)

    # a one-element array names the text, so it is built once
    return F.transform(F.array(json_text), lowered)[0]


def payload_v2(fields: dict[str, Column]) -> Column:
    """JSON of the whole event but hash and hmac, keys sorted, nulls kept."""
    known = {f.name: f.dataType for f in AUDIT_EVENT.fields if f.name not in ("hash", "hmac")}
    columns = [
        fields[name].cast(known[name]).alias(name) if name in fields else F.lit(None).cast(known[name]).alias(name)
        for name in sorted(known)
    ]
    return _lower_escapes(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def payload(fields: dict[str, Column]) -> Column:
    """Payload form by the version of the event."""
    return F.when(fields["v"] == "v2", payload_v2(fields)).otherwise(payload_v1(fields))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 from built-in hashes (keys up to one block are padded)."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def seal(events: DataFrame, capture: str, key: bytes) -> DataFrame:
    """Number and chain the events of every capture in order of ``seq_global``.

    Each hash covers the one before it, so a single chain is sequential by
    definition.  Captures run in parallel; inside one, rows stream through the task
    in batches after an external sort, and only the previous hash is held.
    """
    fields = {c: F.col(c) for c in events.columns if c in AUDIT_EVENT.fieldNames()}
    numbered = ordered.scan(events, [capture], ["seq_global"], __no=ordered.row_number())
    fields.update(
        v=F.lit("v2"),
        seq_global=F.col("__no"),
        timestamp_ms=F.coalesce(fields.get("timestamp_ms", F.lit(None)), F.col("ts_ms")).cast("long"),
        prev_hash=F.lit("@"),
    )
    text = payload_v2(fields)
    cut = F.locate('"prev_hash":"@"', text)
    mark = len('"prev_hash":"')
    ready = numbered.select(
        F.col(capture).alias("capture"),
        F.col("__no").alias("seq_global"),
        F.substr(text, F.lit(1), cut + mark - 1).alias("head"),
        F.substr(text, cut + mark + 1).alias("rest"),
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, prev = None, ""
        for pdf in batches:
            prevs, hashes, macs = [], [], []
            for cap, head, rest in zip(pdf["capture"], pdf["head"], pdf["rest"]):
                if cap != current:
                    current, prev = cap, ""
                data = f"{head}{prev}{rest}".encode()
                prevs.append(prev)
                prev = hashlib.sha256(data).hexdigest()
                hashes.append(prev)
                macs.append(hmac_lib.new(key, data, hashlib.sha256).hexdigest())
            yield pdf[["capture", "seq_global"]].assign(prev_hash=prevs, hash=hashes, hmac=macs)

    return (
        ready.repartition("capture")
        .sortWithinPartitions("capture", "seq_global")
        .mapInPandas(chain, "capture string, seq_global bigint, prev_hash string, hash string, hmac string")
    )


def write_events(events: DataFrame, path: str) -> None:
    """Write events as JSON lines, one folder per capture."""
    events.write.mode("append").partitionBy("capture_id").json(path)
