"""Queries over the audit log: scans, integrity, sessions, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import integrity, sessions
from tracewell.plans import ordered
from tracewell.queries import tables as t
from tracewell.queries.registry import query
from tracewell.schemas import AUDIT_EVENT
from tracewell.sources import audit_log

KEY = b"audit-key"

# ---------------------------------------------------------------- log scans

_LINE = """
lines AS (
  SELECT part, seq_global,
         row_number() OVER (PARTITION BY part ORDER BY seq_global) AS line_no,
         CASE WHEN seq_global % 97 = 0 THEN 'broken' WHEN seq_global % 89 = 0 THEN 'blank'
              WHEN seq_global % 83 = 0 THEN 'array' WHEN seq_global % 79 = 0 THEN 'v9'
              ELSE 'good' END AS form, type, session_id, ts_ms, n, dir, sig
  FROM ae)"""


def _lines(spark, sf):
    """The log as text lines of day parts, with damaged, blank, array and wrong-version lines."""
    ev = t.audit_events(spark, sf)
    seq = F.col("seq_global")
    fields = ["seq_global", "ts_ms", "type", "actor", "session_id", "dir", "n", "data_b64", "sig"]
    body = F.to_json(F.struct(F.when(seq % 79 == 0, "v9").otherwise("v2").alias("v"), *fields))
    line = (
        F.when(seq % 97 == 0, F.concat(body, F.lit('"')).substr(F.lit(1), F.length(body) - 4))
        .when(seq % 89 == 0, F.lit("  "))
        .when(seq % 83 == 0, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return ev.select("part", "seq_global", F.to_date("part", "'audit-'yyyyMMdd'.jsonl'").alias("d"), line.alias("line"))


@query(
    "src01_lenient_log_scan",
    t.with_tables(t.AUDIT_SQL, _LINE)
    + """SELECT part, CASE WHEN form = 'v9' THEN 'v9' ELSE 'v2' END AS v, seq_global, ts_ms, type, session_id, dir,
       CAST(n AS INTEGER) AS n, sig FROM lines WHERE form IN ('good', 'v9')""",
)
def lenient_scan(spark, sf):
    parsed = audit_log.parse_lines(_lines(spark, sf).select("part", "line"))
    return parsed.select("part", "v", "seq_global", "ts_ms", "type", "session_id", "dir", "n", "sig")


@query(
    "src02_strict_log_scan",
    t.with_tables(t.AUDIT_SQL, _LINE)
    + """SELECT part, line_no, CASE form WHEN 'broken' THEN 'invalid JSON' WHEN 'array' THEN 'JSON not object'
       ELSE 'unexpected v' END AS reason FROM lines WHERE form IN ('broken', 'array', 'v9')""",
)
def strict_scan(spark, sf):
    numbered = ordered.scan(_lines(spark, sf), ["part"], ["seq_global"], line_no=ordered.row_number())
    return audit_log.rejected_lines(numbered)


@query(
    "src03_newest_events",
    t.with_tables(t.AUDIT_SQL)
    + "SELECT seq_global, session_id, type, ts_ms FROM ae ORDER BY seq_global DESC LIMIT 40",
)
def newest(spark, sf):
    return sessions.tail(t.audit_events(spark, sf).select("seq_global", "session_id", "type", "ts_ms"), 40)


_CHAIN = """
chained AS (
  SELECT *, octet_length(encode(concat_ws(':', seq_global, session_id, type, coalesce(CAST(n AS VARCHAR), '')))) AS line_bytes,
         coalesce(lag(hash) OVER (ORDER BY seq_global), '') AS prev_hash
  FROM (SELECT *, sha256(concat_ws(':', seq_global, session_id, type, coalesce(CAST(n AS VARCHAR), ''))) AS hash FROM ae))"""


def _chained(spark, sf):
    """A log whose hash covers the event's own fields, linked by ``prev_hash``."""
    ev = t.audit_events(spark, sf).withColumn("capture_id", F.lit("cap"))
    text = F.concat_ws(
        ":", F.col("seq_global").cast("string"), "session_id", "type", F.coalesce(F.col("n").cast("string"), F.lit(""))
    )
    ev = ev.withColumn("hash", F.sha2(text, 256)).withColumn("line_bytes", F.octet_length(text).cast("long"))
    return ordered.scan(ev, ["capture_id"], ["seq_global"], prev_hash=ordered.lag(F.col("hash"))).withColumn(
        "prev_hash", F.coalesce("prev_hash", F.lit(""))
    )


_FACTS = """SELECT part, CAST(sum(line_bytes) AS BIGINT) AS bytes, min(seq_global) AS seq_start,
  max(seq_global) AS seq_end, arg_min(hash, seq_global) AS first_hash, arg_max(hash, seq_global) AS last_hash
  FROM chained GROUP BY part"""


@query("src04_part_manifest", t.with_tables(t.AUDIT_SQL, _CHAIN) + _FACTS)
def part_manifest(spark, sf):
    return audit_log.part_facts(_chained(spark, sf))


def _v2_payload_sql() -> str:
    """The v2 payload of the sealed test log as SQL text, up to and after ``prev_hash``."""
    texts = {
        "actor": "'\"' || a.actor || '\"'",
        "session_id": "'\"' || a.session_id || '\"'",
        "type": "'\"' || a.type || '\"'",
        "sig": "coalesce('\"' || a.sig || '\"', 'null')",
        "dir": "coalesce('\"' || a.dir || '\"', 'null')",
        "n": "coalesce(CAST(a.n AS VARCHAR), 'null')",
        "seq_global": "a.no",
        "ts_ms": "a.ts_ms",
        "timestamp_ms": "a.ts_ms",
        "v": "'\"v2\"'",
        "prev_hash": "'\"' || PREV || '\"'",
    }
    names = sorted(f for f in AUDIT_EVENT.fieldNames() if f not in ("hash", "hmac"))
    return "'{' || " + " || ',' || ".join(f"'\"{n}\":' || " + texts.get(n, "'null'") for n in names) + " || '}'"


@query(
    "src05_seal_chain",
    t.with_tables(
        t.AUDIT_SQL,
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq_global) AS no FROM ae)",
        "chain AS (SELECT a.part, a.no, '' AS prev_hash, sha256("
        + _v2_payload_sql().replace("PREV", "''")
        + ") AS hash FROM a0 a WHERE a.no = 1 UNION ALL SELECT a.part, a.no, c.hash, sha256("
        + _v2_payload_sql().replace("PREV", "c.hash")
        + ") FROM chain c JOIN a0 a ON a.part = c.part AND a.no = c.no + 1)",
    )
    + "SELECT part AS capture, no AS seq_global, prev_hash, hash FROM chain",
)
def seal_chain(spark, sf):
    ev = t.audit_events(spark, sf).select("part", "seq_global", "ts_ms", "type", "actor", "session_id", "dir", "n", "sig")
    return audit_log.seal(ev, "part", KEY).drop("hmac")


@query(
    "src07_keyed_upsert",
    """SELECT o_custkey AS entity_key, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status,
       arg_max(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY o_custkey""",
)
def keyed_upsert(spark, sf):
    from tracewell.sources import tables as store

    o = t.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_key"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )
    old, new = o.where(F.col("version") % 2 == 0), o.where(F.col("version") % 2 == 1)
    return store.latest_by_key(old, new, ["entity_key"], "version")


@query(
    "agg10_capture_counters",
    t.with_tables(t.AUDIT_SQL)
    + "SELECT 'u' || (user_id % 7) AS capture_id, count(DISTINCT part) AS session_count, count(*) AS event_count FROM ae GROUP BY 1",
)
def capture_counters(spark, sf):
    return audit_log.counters(t.audit_events(spark, sf).withColumn("capture_id", F.col("actor")))


# ---------------------------------------------------------------- integrity

_BROKEN = """
broken AS (
  SELECT * FROM ae WHERE event_id % 101 <> 0
  UNION ALL SELECT * FROM ae WHERE event_id % 503 = 0 AND event_id % 101 <> 0)"""


def _broken(spark, sf):
    """The log with missing and repeated events."""
    ev = t.audit_events(spark, sf, seq_session=True).withColumn("capture_id", F.lit("cap"))
    kept = ev.where(F.col("event_id") % 101 != 0)
    copies = F.when(F.col("event_id") % 503 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return kept.withColumn("copy", F.explode(copies))


@query(
    "chn01_sequence_breaks",
    t.with_tables(
        t.AUDIT_SQL,
        _BROKEN,
        """w AS (SELECT seq_global, copies, coalesce(lag(seq_global) OVER (ORDER BY seq_global), 0) + 1 AS expected
           FROM (SELECT seq_global, count(*) AS copies FROM broken GROUP BY 1))""",
    )
    + """SELECT 'cap' AS capture_id, 'gap' AS violation, expected AS seq_from, seq_global - 1 AS seq_to,
         seq_global - expected AS events FROM w WHERE seq_global <> expected
       UNION ALL SELECT 'cap', 'duplicate', seq_global, seq_global, copies - 1 FROM w WHERE copies > 1""",
)
def sequence_breaks(spark, sf):
    return integrity.sequence_breaks(_broken(spark, sf).select("capture_id", "seq_global"))


_BAD_LINK = "CASE WHEN seq_global % 307 = 0 THEN repeat('0', 64) ELSE prev_hash END"


@query(
    "chn02_hash_links",
    t.with_tables(
        t.AUDIT_SQL, _CHAIN,
        f"""w AS (SELECT seq_global, {_BAD_LINK} AS prev_hash,
              coalesce(lag(hash) OVER (ORDER BY seq_global), '') AS expected_prev_hash FROM chained)""",
    )
    + "SELECT 'cap' AS capture_id, * FROM w WHERE prev_hash <> expected_prev_hash",
)
def hash_links(spark, sf):
    log = _chained(spark, sf).withColumn("prev_hash", F.expr(_BAD_LINK))
    return integrity.broken_links(log.select("capture_id", "seq_global", "hash", "prev_hash"))


@query(
    "chn03_payload_hash",
    t.with_tables(t.AUDIT_SQL)
    + """SELECT seq_global, seq_global % 211 = 0 OR seq_global % 409 = 0 AS hash_mismatch,
          seq_global % 211 = 0 OR seq_global % 401 = 0 AS hmac_mismatch
         FROM ae WHERE seq_global % 211 = 0 OR seq_global % 401 = 0 OR seq_global % 409 = 0""",
)
def payload_hash(spark, sf):
    ev = t.audit_events(spark, sf)
    seq = F.col("seq_global")
    version = F.when(seq % 2 == 0, "v1").otherwise("v2")
    names = ["seq_global", "ts_ms", "type", "actor", "session_id", "dir", "n", "data_b64", "sig"]
    fields = {c: F.col(c) for c in names} | {"v": F.col("v"), "prev_hash": F.lit("")}
    sealed = ev.select(*names, version.alias("v")).withColumn("payload", audit_log.payload(fields))
    flip = F.concat(F.lit("x"), F.col("payload"))
    sealed = sealed.withColumn("hash", F.sha2(F.when(seq % 409 == 0, flip).otherwise(F.col("payload")), 256))
    sealed = sealed.withColumn(
        "hmac", audit_log.hmac_sha256(KEY, F.when(seq % 401 == 0, flip).otherwise(F.col("payload")))
    ).drop("payload")
    edited = sealed.withColumn("ts_ms", F.when(seq % 211 == 0, F.col("ts_ms") + 1).otherwise(F.col("ts_ms")))
    return integrity.payload_violations(edited, audit_log.payload(fields), KEY)


@query(
    "chn04_session_sequence",
    t.with_tables(
        t.AUDIT_SQL, _BROKEN,
        """w AS (SELECT session_id, seq_global, seq_session,
              coalesce(lag(seq_session) OVER (PARTITION BY session_id ORDER BY seq_global, copy) + 1, 1) AS expected_seq_session
            FROM (SELECT *, row_number() OVER (PARTITION BY seq_global) AS copy FROM broken))""",
    )
    + "SELECT * FROM w WHERE seq_session <> expected_seq_session",
)
def session_sequence(spark, sf):
    log = _broken(spark, sf).select("session_id", "seq_global", "seq_session", "copy")
    return integrity.session_sequence_breaks(log, order=("seq_global", "copy"))


@query(
    "chn05_manifest_check",
    t.with_tables(
        t.AUDIT_SQL, _CHAIN, f"facts AS ({_FACTS})",
        """stored AS (SELECT part, bytes, CASE WHEN seq_start % 2 = 0 THEN seq_start + 1 ELSE seq_start END AS seq_start,
             seq_end, first_hash, CASE WHEN seq_end % 3 = 0 THEN 'x' ELSE last_hash END AS last_hash FROM facts)""",
    )
    + """SELECT s.part, 'seq_start' AS field, CAST(s.seq_start AS VARCHAR) AS stored, CAST(f.seq_start AS VARCHAR) AS found
         FROM stored s JOIN facts f USING (part) WHERE s.seq_start <> f.seq_start
         UNION ALL SELECT s.part, 'last_hash', s.last_hash, f.last_hash
         FROM stored s JOIN facts f USING (part) WHERE s.last_hash <> f.last_hash
         UNION ALL SELECT 'audit-gone-' || part, 'missing log', NULL, NULL FROM facts WHERE seq_end % 5 = 0""",
)
def manifest_check(spark, sf):
    facts = audit_log.part_facts(_chained(spark, sf))
    stored = facts.select(
        "part", "bytes",
        F.when(F.col("seq_start") % 2 == 0, F.col("seq_start") + 1).otherwise(F.col("seq_start")).alias("seq_start"),
        "seq_end", "first_hash",
        F.when(F.col("seq_end") % 3 == 0, "x").otherwise(F.col("last_hash")).alias("last_hash"),
    )
    gone = facts.where(F.col("seq_end") % 5 == 0).withColumn("part", F.concat(F.lit("audit-gone-"), "part"))
    return integrity.manifest_mismatches(stored.unionByName(gone), facts)


@query(
    "chn06_run_fingerprint",
    t.with_tables(
        t.AUDIT_SQL, _CHAIN, t.RUNS_SQL,
        "hints AS (SELECT actor AS log_dir, arg_max(hash, seq_global) AS last_hash FROM chained GROUP BY 1)",
        """fp AS (SELECT run_id, status, sha256(concat_ws('|', 'u' || (scenario_id % 9), environment, 'op',
              'c' || (scenario_id % 50), mode, coalesce(last_hash, ''))) AS fingerprint
            FROM runs LEFT JOIN hints ON hints.log_dir = 'u' || (scenario_id % 9))""",
    )
    + """SELECT run_id, fingerprint, status = 'running' AND
           count(*) FILTER (status = 'running') OVER (PARTITION BY fingerprint) > 1 AS duplicate_open FROM fp""",
)
def run_fingerprint(spark, sf):
    hints = _chained(spark, sf).groupBy(F.col("actor").alias("log_dir")).agg(
        F.max_by("hash", "seq_global").alias("last_hash")
    )
    runs = t.runs(spark, sf).select(
        "run_id", "status", "mode",
        F.concat(F.lit("u"), (F.col("scenario_id") % 9).cast("string")).alias("log_dir"),
        F.col("environment").alias("target_host"),
        F.lit("op").alias("target_user"),
        F.concat(F.lit("c"), (F.col("scenario_id") % 50).cast("string")).alias("target_command"),
    )
    return integrity.run_fingerprints(runs, hints)


# ---------------------------------------------------------------- sessions

_SUMMARY = """
facts AS (
  SELECT session_id, arg_min(actor, seq_global) AS actor, min(ts_ms) AS started_at_ms, max(ts_ms) AS last_ts_ms,
    arg_max(ts_ms, seq_global) FILTER (type = 'session_end') AS ended_at_ms, count(*) AS event_count,
    count(*) FILTER (type = 'checkpoint') AS checkpoint_count,
    count(*) FILTER (type = 'deterministic_input') AS deterministic_input_count,
    CAST(coalesce(sum(n) FILTER (dir = 'in'), 0) AS BIGINT) AS bytes_in,
    CAST(coalesce(sum(n) FILTER (dir = 'out'), 0) AS BIGINT) AS bytes_out,
    max(seq_global) AS last_seq_global, string_agg(DISTINCT type, ',' ORDER BY type) AS event_types,
    bool_or(type = 'session_start') AS session_start_observed,
    CASE WHEN bool_or(type = 'session_end') THEN 'closed' ELSE 'open' END AS status,
    coalesce(arg_max(coalesce(via_gateway, TRUE), seq_global) FILTER (type = 'session_start'), FALSE) AS via_gateway,
    coalesce(arg_max(gateway_endpoint, seq_global) FILTER (gateway_endpoint <> ''), '') AS gateway_endpoint,
    coalesce(arg_max(source_command, seq_global) FILTER (source_command <> ''), '') AS source_command,
    coalesce(arg_min(sig, seq_global) FILTER (type = 'checkpoint'), '') AS first_checkpoint_sig,
    coalesce(arg_min(text, seq_global) FILTER (dir = 'out'), '') AS first_output_excerpt
  FROM ae GROUP BY session_id),
summary AS (
  SELECT *, CASE WHEN session_start_observed OR via_gateway THEN 'gateway_ssh' ELSE 'direct' END AS entry_mode,
    contains(first_checkpoint_sig, 'login') OR contains(first_output_excerpt, 'login') AS login_sequence_observed
  FROM facts),
policy AS (
  SELECT *, CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 3 = 0 THEN TRUE ELSE FALSE END AS gateway_required,
    CASE CAST(substr(session_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'strict' WHEN 2 THEN 'off'
      ELSE CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 3 = 0 THEN 'strict' ELSE 'off' END END AS capture_compliance_mode
  FROM summary),
reasons AS (
  SELECT *, concat_ws('; ',
     CASE WHEN gateway_required AND NOT via_gateway THEN 'target exige gateway e a sessão não confirmou entrada via gateway' END,
     CASE WHEN NOT gateway_required AND NOT session_start_observed THEN 'captura sem evento session_start desde o primeiro estado' END,
     CASE WHEN gateway_required AND source_command <> '' THEN 'captura iniciou com source_command e não no login shell' END,
     CASE WHEN gateway_required AND source_command = '' AND NOT login_sequence_observed
          THEN 'não houve evidência de tela inicial de login na sessão capturada' END) AS r
  FROM policy),
judged AS (
  SELECT *, CASE WHEN capture_compliance_mode = 'off' AND NOT gateway_required THEN 'not_applicable'
       WHEN r = '' THEN 'compliant' WHEN capture_compliance_mode = 'warn' THEN 'warning'
       ELSE 'non_compliant' END AS compliance_status,
     CASE WHEN capture_compliance_mode = 'off' AND NOT gateway_required THEN 'target não exige compliance de captura'
       WHEN r = '' THEN 'sessão compatível com a policy do target' ELSE r END AS compliance_reason
  FROM reasons)"""

_SUMMARY_COLUMNS = (
    "session_id actor started_at_ms last_ts_ms ended_at_ms event_count checkpoint_count "
    "deterministic_input_count bytes_in bytes_out last_seq_global event_types session_start_observed "
    "status via_gateway entry_mode gateway_endpoint source_command first_checkpoint_sig "
    "first_output_excerpt login_sequence_observed"
).split()


@query(
    "agg01_session_summary",
    t.with_tables(t.AUDIT_SQL, _SUMMARY) + f"SELECT {', '.join(_SUMMARY_COLUMNS)} FROM summary",
)
def session_summary(spark, sf):
    return sessions.summarize_sessions(t.audit_events(spark, sf)).select(*_SUMMARY_COLUMNS)


def _judged(spark, sf):
    user = F.substring("session_id", 2, 20).cast("long")
    summary = sessions.summarize_sessions(t.audit_events(spark, sf))
    raw = summary.select(
        "*",
        F.when(user % 3 == 0, " Yes ").otherwise("0").alias("gateway_required"),
        F.lit("?").alias("direct_ssh_policy"),
        F.lit(None).cast("string").alias("capture_start_mode"),
        F.element_at(F.array(F.lit("WARN "), F.lit("strict"), F.lit("off"), F.lit("")), (user % 4 + 1).cast("int")).alias(
            "capture_compliance_mode"
        ),
        F.lit("sim").alias("allow_admin_direct_access"),
    )
    return sessions.session_compliance(sessions.normalize_policy(raw))


@query(
    "fn12_session_compliance",
    t.with_tables(t.AUDIT_SQL, _SUMMARY) + "SELECT session_id, compliance_status, compliance_reason FROM judged",
)
def session_status(spark, sf):
    return _judged(spark, sf).select("session_id", "compliance_status", "compliance_reason")


_CAPTURE = """
cap AS (
  SELECT actor, capture_compliance_mode, count(*) AS total_sessions,
    count(*) FILTER (compliance_status = 'compliant') AS compliant_sessions,
    count(*) FILTER (compliance_status = 'warning') AS warning_sessions,
    count(*) FILTER (compliance_status = 'non_compliant') AS non_compliant_sessions,
    bool_and(via_gateway) AS via_gateway, max(last_ts_ms) AS validated_at_ms
  FROM judged GROUP BY 1, 2)"""


@query(
    "agg02_capture_compliance",
    t.with_tables(t.AUDIT_SQL, _SUMMARY, _CAPTURE)
    + """, run AS (SELECT *, CASE WHEN non_compliant_sessions > 0 THEN
             CASE WHEN capture_compliance_mode = 'strict' THEN 'rejected' ELSE 'warning' END
             WHEN warning_sessions > 0 THEN 'warning' ELSE 'compliant' END AS summary_status,
           concat_ws('; ', CASE WHEN non_compliant_sessions > 0 THEN non_compliant_sessions || ' sessão(ões) não conformes na origem' END,
             CASE WHEN warning_sessions > 0 THEN warning_sessions || ' sessão(ões) com alerta de origem' END,
             CASE WHEN actor IN ('u1', 'u2') THEN 'replay usa transporte direto ssh para target com política gateway_only; é obrigatório informar rota via gateway/bastion' END) AS r
         FROM cap)
       SELECT actor, capture_compliance_mode, total_sessions, compliant_sessions, warning_sessions, non_compliant_sessions,
         via_gateway, validated_at_ms, summary_status,
         CASE WHEN r = '' THEN 'compliant' WHEN capture_compliance_mode = 'strict' THEN 'rejected'
              WHEN capture_compliance_mode = 'warn' THEN 'warning' ELSE 'non_compliant' END AS compliance_status,
         CASE WHEN r = '' THEN 'origem da captura e rota do run compatíveis com a policy' ELSE r END AS compliance_reason,
         CASE WHEN via_gateway THEN 'gateway_ssh' ELSE 'mixed' END AS entry_mode FROM run""",
)
def capture_status(spark, sf):
    captures = sessions.capture_compliance(_judged(spark, sf), "actor")
    routed = captures.select(
        "*",
        F.col("actor").isin("u1", "u2", "u3").alias("gateway_required"),
        F.lit("ssh").alias("transport"),
        F.lit("gateway_only").alias("direct_ssh_policy"),
        (F.col("actor") == "u3").alias("has_gateway_route"),
    )
    return sessions.run_compliance(routed).drop("gateway_required", "transport", "direct_ssh_policy", "has_gateway_route")


_ATTENTION = "regexp_matches(lower(event_type || props), 'error|fail|warning|unknown_screen')"


@query(
    "agg03_event_summary",
    t.with_tables(t.AUDIT_SQL)
    + f"""SELECT count(*) AS window_events, count(DISTINCT session_id) AS unique_sessions,
        count(DISTINCT actor) AS unique_actors, count(*) FILTER (type = 'checkpoint') AS checkpoints,
        count(*) FILTER (type = 'deterministic_input') AS deterministic_inputs,
        count(*) FILTER ({_ATTENTION}) AS attention_events, arg_max(ts_ms, seq_global) AS last_ts_ms FROM ae""",
)
def event_summary(spark, sf):
    return sessions.event_summary(t.audit_events(spark, sf), sessions.attention("event_type", "props"))


@query(
    "srt02_top_event_types",
    t.with_tables(t.AUDIT_SQL) + "SELECT type, count(*) AS events FROM ae GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def top_event_types(spark, sf):
    return sessions.top_types(t.audit_events(spark, sf))


@query(
    "prj01_payload_decode",
    t.with_tables(t.AUDIT_SQL)
    + """SELECT seq_global, CASE WHEN seq_global % 53 = 0 THEN 0 ELSE octet_length(encode(text)) END AS actual_bytes,
         CASE WHEN seq_global % 53 = 0 THEN 'invalid_base64'
              WHEN n IS NOT NULL AND n <> octet_length(encode(text)) THEN 'byte_count_mismatch' END AS integrity_error
         FROM ae WHERE type = 'bytes'""",
)
def payload_decode(spark, sf):
    ev = t.audit_events(spark, sf).where(F.col("type") == "bytes")
    damaged = ev.withColumn("data_b64", F.when(F.col("seq_global") % 53 == 0, "?*?").otherwise(F.col("data_b64")))
    return sessions.decode_payload(damaged).select("seq_global", "actual_bytes", "integrity_error")


@query(
    "prj02_replay_window",
    t.with_tables(t.AUDIT_SQL)
    + """SELECT seq_global, session_id, type FROM ae WHERE seq_global <= 9000 AND seq_global >=
         greatest(50, (SELECT min(seq_global) FROM ae WHERE type = 'checkpoint' AND sig = 'k42'))""",
)
def replay_window(spark, sf):
    part = sessions.replay_window(t.audit_events(spark, sf), seq_from=50, seq_to=9000, from_sig="k42")
    return part.select("seq_global", "session_id", "type")


@query(
    "prj03_replay_inputs",
    t.with_tables(t.AUDIT_SQL)
    + """SELECT seq_global, 'raw' AS mode FROM ae WHERE type = 'bytes' AND dir = 'in'
         UNION ALL SELECT seq_global, 'deterministic' FROM ae WHERE type = 'deterministic_input'""",
)
def replay_inputs(spark, sf):
    ev = t.audit_events(spark, sf)
    raw = sessions.replay_inputs(ev).select("seq_global", F.lit("raw").alias("mode"))
    return raw.union(sessions.replay_inputs(ev, "deterministic").select("seq_global", F.lit("deterministic")))


@query(
    "prj04_attention_flag",
    t.with_tables(t.AUDIT_SQL) + f"SELECT seq_global, {_ATTENTION} AS attention FROM ae",
)
def attention_flag(spark, sf):
    return t.audit_events(spark, sf).select("seq_global", sessions.attention("event_type", "props").alias("attention"))


@query(
    "prj05_session_search",
    t.with_tables(t.AUDIT_SQL, _SUMMARY)
    + """SELECT session_id, actor, last_ts_ms, event_count, logname, uid, gid FROM (
           SELECT *, 'log' || (u % 12) AS logname, CAST(1000 + u % 4 AS INTEGER) AS uid, CAST(100 + u % 2 AS INTEGER) AS gid
           FROM (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS u FROM summary))
         WHERE contains(actor, 'u') AND len(list_intersect(string_split(event_types, ','), ['session_end', 'session_start'])) > 0
           AND contains(session_id, '1') AND started_at_ms >= 1704067200000 AND contains(logname, 'g1') AND uid = 1001 AND gid = 101""",
)
def session_search(spark, sf):
    """Sessions by part of actor, name and id, by user and group id and by either of two event types."""
    user = F.col("user_id")
    events = t.audit_events(spark, sf).withColumns({
        "logname": F.concat(F.lit("log"), (user % 12).cast("string")), "uid": (1000 + user % 4).cast("int"), "gid": (100 + user % 2).cast("int")
    })
    found = sessions.search_sessions(
        sessions.summarize_sessions(events), actor="U", session_id="1", event_type=("session_end", "Session_Start "), started_from=1704067200000,
        logname="G1", uid="1001", gid=" 101",
    )
    return found.select("session_id", "actor", "last_ts_ms", "event_count", "logname", "uid", "gid")


@query(
    "prj06_session_timeline",
    t.with_tables(t.AUDIT_SQL)
    + """SELECT seq_global, seq_session, ts_ms, type FROM ae WHERE session_id = 's8' AND seq_global >= 100""",
)
def session_timeline(spark, sf):
    one = t.audit_events(spark, sf, seq_session=True)
    return sessions.timeline(one, "s8", seq_from=100).select("seq_global", "seq_session", "ts_ms", "type")


@query(
    "prj11_policy_normalisation",
    """SELECT c_custkey, c_custkey % 3 = 0 AS gateway_required,
       CASE WHEN c_custkey % 5 = 0 THEN 'admin_only' WHEN c_custkey % 3 = 0 THEN 'gateway_only' ELSE 'unrestricted' END AS direct_ssh_policy,
       CASE WHEN c_custkey % 7 = 0 THEN 'session_start_required' WHEN c_custkey % 3 = 0 THEN 'login_required'
            ELSE 'session_start_required' END AS capture_start_mode,
       CASE WHEN c_custkey % 11 = 0 THEN 'warn' WHEN c_custkey % 3 = 0 THEN 'strict' ELSE 'off' END AS capture_compliance_mode,
       c_custkey % 2 = 0 AS allow_admin_direct_access FROM customer""",
)
def policy_normalisation(spark, sf):
    key = F.col("c_custkey")
    raw = t.read(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 3 == 0, F.when(key % 2 == 0, " SIM").otherwise("on")).otherwise("no").alias("gateway_required"),
        F.when(key % 5 == 0, " Admin_Only ").otherwise("other").alias("direct_ssh_policy"),
        F.when(key % 7 == 0, "session_start_required").alias("capture_start_mode"),
        F.when(key % 11 == 0, "WARN").otherwise("").alias("capture_compliance_mode"),
        F.when(key % 2 == 0, "1").otherwise("0").alias("allow_admin_direct_access"),
    )
    return sessions.normalize_policy(raw)


_INDEX = """
idx AS (
  SELECT session_id, seq_global, row_number() OVER w - 1 AS position,
    CASE WHEN type = 'bytes' THEN count(*) FILTER (type = 'bytes') OVER w - 1 END AS byte_ordinal, dir AS direction,
    octet_length(encode(text)) AS decoded_len,
    CAST(coalesce(sum(octet_length(encode(text))) FILTER (dir = 'in') OVER w, 0) AS BIGINT) AS bytes_in_so_far,
    CAST(coalesce(sum(octet_length(encode(text))) FILTER (dir = 'out') OVER w, 0) AS BIGINT) AS bytes_out_so_far,
    coalesce(ts_ms >= lag(ts_ms) OVER w, TRUE) AS monotonic
  FROM ae WINDOW w AS (PARTITION BY session_id ORDER BY seq_global))"""


@query("win01_session_index", t.with_tables(t.AUDIT_SQL, _INDEX) + "SELECT * FROM idx")
def session_index(spark, sf):
    return sessions.session_index(t.audit_events(spark, sf))


@query(
    "win02_playback_page",
    t.with_tables(
        t.AUDIT_SQL, _INDEX,
        """b AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total_byte_events,
             CAST(coalesce(sum(decoded_len) FILTER (direction = 'in') OVER (PARTITION BY session_id), 0) AS BIGINT) AS total_in,
             CAST(coalesce(sum(decoded_len) FILTER (direction = 'out') OVER (PARTITION BY session_id), 0) AS BIGINT) AS total_out,
             coalesce(max(byte_ordinal) FILTER (byte_ordinal < 5 AND direction = 'out') OVER (PARTITION BY session_id), -1) AS base_out_ordinal
           FROM idx WHERE byte_ordinal IS NOT NULL)""",
    )
    + """SELECT session_id, seq_global, byte_ordinal, direction, decoded_len, total_byte_events, total_in, total_out,
         base_out_ordinal, TRUE AS windowed FROM b WHERE byte_ordinal >= 5 AND byte_ordinal < 25""",
)
def playback_page(spark, sf):
    return sessions.playback_page(t.audit_events(spark, sf), 5, 20)


@query(
    "jn04_timeline_failures",
    t.with_tables(
        t.AUDIT_SQL,
        """f AS (SELECT 's' || (l_partkey % 150) AS session_id, l_orderkey % 10000 AS seq_global, count(*) AS n,
             min(CASE l_returnflag WHEN 'R' THEN 'timeout' WHEN 'A' THEN 'screen_divergence' ELSE 'checkpoint_mismatch' END) AS ft
           FROM lineitem GROUP BY 1, 2)""",
    )
    + """SELECT ae.session_id, ae.seq_global, CASE WHEN f.n IS NOT NULL THEN 'failure' WHEN type = 'bytes' THEN 'io' ELSE type END AS event_kind,
         coalesce(f.n, 0) AS linked_failures, f.ft AS first_failure_type
         FROM ae LEFT JOIN f ON f.session_id = ae.session_id AND f.seq_global = ae.seq_global""",
)
def timeline_failures(spark, sf):
    fails = t.failures(spark, sf).select(
        F.concat(F.lit("s"), (F.col("part_key") % 150).cast("string")).alias("session_id"),
        (F.col("run_id") % 10000).alias("seq_global"),
        "failure_type",
    )
    return sessions.annotate_timeline(t.audit_events(spark, sf), fails)


_SEGMENTS = """
seg0 AS (SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq_global
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_sig FROM ae),
seg AS (SELECT *, sum(CASE WHEN sig IS NOT NULL AND (type = 'checkpoint' OR prev_sig IS NULL OR sig <> prev_sig)
            THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq_global) AS screen_no FROM seg0)"""


@query(
    "win09_screen_segments",
    t.with_tables(t.AUDIT_SQL, _SEGMENTS)
    + """SELECT session_id, CAST(screen_no AS BIGINT) AS screen_no, arg_min(sig, seq_global) AS sig,
         min(seq_global) AS first_seq, count(*) FILTER (type = 'deterministic_input') AS inputs,
         min(seq_global) FILTER (type = 'deterministic_input') AS first_input_seq
         FROM seg WHERE screen_no > 0 GROUP BY 1, 2""",
)
def screen_segments(spark, sf):
    return sessions.screens_with_inputs(t.audit_events(spark, sf))


_STEPS = """
steps AS (SELECT * FROM (SELECT session_id, seq_global, sig AS from_sig,
    lead(sig) OVER (PARTITION BY session_id ORDER BY seq_global) AS to_sig FROM ae WHERE sig IS NOT NULL)
  WHERE to_sig IS NOT NULL)"""


@query(
    "win10_screen_transitions",
    t.with_tables(t.AUDIT_SQL, _STEPS) + "SELECT from_sig, to_sig, count(*) AS transitions FROM steps GROUP BY 1, 2",
)
def screen_transitions(spark, sf):
    return sessions.screen_transitions(t.audit_events(spark, sf))


@query(
    "win10_start_screen_journeys",
    t.with_tables(t.AUDIT_SQL, _STEPS)
    + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_sig ORDER BY seq_global) AS step_order FROM steps)
         WHERE step_order <= 10""",
)
def start_screen_journeys(spark, sf):
    return sessions.start_screen_journeys(t.audit_events(spark, sf))


@query(
    "win11_recorded_journey",
    t.with_tables(
        t.AUDIT_SQL,
        """sc AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq) AS step_order FROM (
             SELECT session_id, sig, min(seq_global) AS first_seq FROM ae WHERE type = 'checkpoint' GROUP BY 1, 2))""",
        """inp AS (SELECT session_id, sig AS input_template,
             row_number() OVER (PARTITION BY session_id ORDER BY seq_global) AS step_order FROM ae WHERE type = 'deterministic_input')""",
    )
    + "SELECT session_id, step_order, sig, first_seq, input_template FROM sc LEFT JOIN inp USING (session_id, step_order)",
)
def recorded_journey(spark, sf):
    return sessions.recorded_journey(t.audit_events(spark, sf))


@query(
    "win12_pacing_plan",
    t.with_tables(
        t.AUDIT_SQL,
        """w AS (SELECT session_id, seq_global, coalesce(greatest(ts_ms - lag(ts_ms) OVER s, 0) // 4
                 + CASE WHEN lag(ts_ms) OVER s IS NULL THEN 0 ELSE CAST('0x' || substr(sha256('seven|' || session_id || '|' || seq_global), 1, 8) AS BIGINT) % 251 END, 0) AS wait_ms
             FROM ae WHERE type = 'deterministic_input' WINDOW s AS (PARTITION BY session_id ORDER BY seq_global))""",
        """st AS (SELECT session_id, (row_number() OVER (ORDER BY session_id) - 1) / 2.0 * 1000 AS start_ms,
             CAST(list_reduce(list_transform(string_split(sha256(session_id), ''),
                lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, d: (a * 16 + d) % 7) AS BIGINT) AS user_slot
             FROM (SELECT DISTINCT session_id FROM w))""",
    )
    + """SELECT session_id, seq_global, wait_ms, CAST(start_ms + sum(wait_ms) OVER (PARTITION BY session_id ORDER BY seq_global) AS DOUBLE) AS send_at_ms,
         user_slot FROM w JOIN st USING (session_id)""",
)
def pacing_plan(spark, sf):
    inputs = sessions.replay_inputs(t.audit_events(spark, sf), "deterministic")
    return sessions.pacing_plan(inputs.select("session_id", "seq_global", "ts_ms"), speed=4, ramp_per_sec=2.0, users=7, jitter_ms=250, seed="seven")
