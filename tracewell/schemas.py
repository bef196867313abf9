"""Explicit schemas of the stored records."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def struct(ddl: str) -> T.StructType:
    """Schema from ``name type`` pairs, without a running session."""
    pairs = [p.split() for p in ddl.replace("`", "").split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])

AUDIT_EVENT = struct(
    """
    v string, seq_global bigint, ts_ms bigint, type string, actor string, session_id string,
    seq_session bigint, timestamp_ms bigint, capture_id bigint, capture_session_uuid string,
    logname string, uid int, gid int, dir string, data_b64 string, n int, sig string,
    norm_sha256 string, norm_len int, screen_sig string, screen_sample string, key_b64 string,
    key_text string, key_kind string, input_len int, contains_newline boolean,
    contains_escape boolean, is_probable_paste boolean, is_probable_command boolean,
    logical_parts int, screen_raw_b64 string, screen_source string, screen_snapshot_ts_ms bigint,
    screen_snapshot_age_ms bigint, source string, text_sig string, visual_sig string,
    semantic_sig string, snapshot_version string, signature_version string, engine_version string,
    snapshot_compact string, diff string, base_seq_global bigint, checkpoint_seq_global bigint,
    expected_text_sig string, expected_visual_sig string, expected_semantic_sig string,
    comparison_mode string, entry_mode string, via_gateway boolean, gateway_session_id string,
    gateway_endpoint string, source_host string, source_user string, source_command string,
    `rows` int, cols int, term string, encoding string, geometry_source string,
    prev_hash string, hash string, hmac string
    """
)

MANIFEST = struct(
    "path string, bytes bigint, seq_start bigint, seq_end bigint, first_hash string, "
    "last_hash string, file_sha256 string, generated_at string"
)

SAMPLE = struct(
    """
    experiment_id string, environment_id string, iteration int, concurrency int,
    virtual_user_id string, journey_id string, step_id string, phase string,
    started_ns bigint, finished_ns bigint, latency_ms double, success boolean, timeout boolean,
    functional_divergence boolean, error_code string, expected_screen_sig string,
    observed_screen_sig string, screen_sig_checked boolean, screen_check_kind string,
    screen_check_basis string, segmentation_skew boolean, checkpoint_lag boolean
    """
)
