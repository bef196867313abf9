"""Integrity of an event log: gaps, links, payload hashes, manifests, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import ordered
from tracewell.sources.audit_log import hmac_sha256


def sequence_breaks(events: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Where the numbering of a capture is not 1, 2, 3 …: gaps with bounds, duplicates with copies."""
    counted = events.groupBy(capture, "seq_global").agg(F.count(F.lit(1)).alias("copies"))
    walked = ordered.scan(counted, [capture], ["seq_global"], before=ordered.lag(F.col("seq_global")))
    expected = F.coalesce("before", F.lit(0)) + 1
    found = F.array_compact(
        F.array(
            F.when(
                F.col("seq_global") != expected,
                F.struct(
                    F.lit("gap").alias("violation"),
                    expected.alias("seq_from"),
                    (F.col("seq_global") - 1).alias("seq_to"),
                    (F.col("seq_global") - expected).alias("events"),
                ),
            ),
            F.when(
                F.col("copies") > 1,
                F.struct(
                    F.lit("duplicate").alias("violation"),
                    F.col("seq_global").alias("seq_from"),
                    F.col("seq_global").alias("seq_to"),
                    (F.col("copies") - 1).alias("events"),
                ),
            ),
        )
    )
    return walked.select(capture, F.explode(found).alias("f")).select(capture, "f.*")


def broken_links(events: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Events whose ``prev_hash`` is not the stored hash of the event before them."""
    walked = ordered.scan(events, [capture], ["seq_global"], want=ordered.lag(F.col("hash")))
    want = F.coalesce("want", F.lit(""))
    return walked.where(~F.col("prev_hash").eqNullSafe(want)).select(
        capture, "seq_global", "prev_hash", want.alias("expected_prev_hash")
    )


def payload_violations(events: DataFrame, payload: Column, key: bytes) -> DataFrame:
    """Events whose stored hash or HMAC is not that of their payload."""
    checked = events.select(
        "seq_global",
        F.coalesce("hash", F.lit("")).alias("hash"),
        F.coalesce("hmac", F.lit("")).alias("hmac"),
        payload.alias("payload"),
    )
    text = F.col("payload")
    return checked.select(
        "seq_global",
        (F.col("hash") != F.sha2(text, 256)).alias("hash_mismatch"),
        (F.col("hmac") != hmac_sha256(key, text)).alias("hmac_mismatch"),
    ).where("hash_mismatch OR hmac_mismatch")


def session_sequence_breaks(events: DataFrame, order: tuple[str, ...] = ("seq_global",)) -> DataFrame:
    """Per-session numbering: each break is reported once, the expectation follows the event.

    ``order`` names the columns that put the events of a session in order.
    """
    walked = ordered.scan(
        events.where(F.coalesce("session_id", F.lit("")) != ""),
        ["session_id"],
        list(order),
        before=ordered.lag(F.col("seq_session")),
    )
    expected = F.coalesce(F.col("before") + 1, F.lit(1))
    return walked.where(F.col("seq_session") != expected).select(
        "session_id", "seq_global", "seq_session", expected.alias("expected_seq_session")
    )


MANIFEST_FIELDS = ("bytes", "seq_start", "seq_end", "first_hash", "last_hash", "file_sha256")


def manifest_mismatches(manifests: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored manifests against recomputed part facts: one row per differing field."""
    fields = [f for f in MANIFEST_FIELDS if f in manifests.columns and f in facts.columns]
    renamed = facts.select("part", *[F.col(f).cast("string").alias(f"now_{f}") for f in fields], F.lit(True).alias("here"))
    joined = manifests.join(renamed, "part", "left")
    missing = F.when(
        F.col("here").isNull(),
        F.struct(F.lit("missing log").alias("field"), F.lit(None).cast("string").alias("stored"),
                 F.lit(None).cast("string").alias("found")),
    )
    checks = [
        F.when(
            F.col("here") & ~F.col(f).cast("string").eqNullSafe(F.col(f"now_{f}")),
            F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stored"), F.col(f"now_{f}").alias("found")),
        )
        for f in fields
    ]
    return joined.select("part", F.explode(F.array_compact(F.array(missing, *checks))).alias("m")).select("part", "m.*")


def run_fingerprints(runs: DataFrame, last_hashes: DataFrame) -> DataFrame:
    """Fingerprint of each run and whether another open run holds the same one.

    ``runs`` has run_id, status, log_dir, target_host, target_user, target_command, mode;
    ``last_hashes`` has log_dir and last_hash.
    """
    text = F.concat_ws(
        "|",
        *[F.coalesce(c, F.lit("")) for c in ("log_dir", "target_host", "target_user", "target_command", "mode")],
        F.coalesce("last_hash", F.lit("")),
    )
    marked = runs.join(last_hashes, "log_dir", "left").select("run_id", "status", F.sha2(text, 256).alias("fingerprint"))
    is_open = F.col("status").isin("queued", "running", "paused")
    clashes = marked.groupBy("fingerprint").agg(F.count_if(is_open).alias("open_runs"))
    return marked.join(clashes, "fingerprint").select(
        "run_id", "fingerprint", (is_open & (F.col("open_runs") > 1)).alias("duplicate_open")
    )
