"""Session views of an audit log: summaries, compliance, windows, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import ordered

# Words that mark a login screen.
LOGIN_HINTS = ("login", "username", "usuario", "usuário", "senha", "password", "signon")

# Accepted policy settings.
DIRECT_POLICIES = ("gateway_only", "admin_only", "unrestricted", "disabled")
START_MODES = ("login_required", "session_start_required")
COMPLIANCE_MODES = ("strict", "warn", "off")
TRUE_WORDS = ("1", "true", "yes", "sim", "on")

# Reason texts of the compliance rules.
REASON_NO_GATEWAY = "target exige gateway e a sessão não confirmou entrada via gateway"
REASON_NO_START = "captura sem evento session_start desde o primeiro estado"
REASON_COMMAND = "captura iniciou com source_command e não no login shell"
REASON_NO_LOGIN = "não houve evidência de tela inicial de login na sessão capturada"
REASON_OK = "sessão compatível com a policy do target"
REASON_NOT_APPLICABLE = "target não exige compliance de captura"


def looks_like_login(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(LOGIN_HINTS)), F.lit(False))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def normalize_policy(df: DataFrame) -> DataFrame:
    """Policy columns with unknown settings replaced by the default of ``gateway_required``."""
    required = truthy(F.col("gateway_required"))

    def setting(name: str, allowed: tuple[str, ...], strict: str, loose: str) -> Column:
        clean = F.lower(F.trim(F.col(name)))
        return F.when(clean.isin(*allowed), clean).when(required, strict).otherwise(loose).alias(name)

    kept = [c for c in df.columns if c not in _POLICY_COLUMNS]
    return df.select(
        *kept,
        required.alias("gateway_required"),
        setting("direct_ssh_policy", DIRECT_POLICIES, "gateway_only", "unrestricted"),
        setting("capture_start_mode", START_MODES, "login_required", "session_start_required"),
        setting("capture_compliance_mode", COMPLIANCE_MODES, "strict", "off"),
        truthy(F.col("allow_admin_direct_access")).alias("allow_admin_direct_access"),
    )


_POLICY_COLUMNS = {
    "gateway_required",
    "direct_ssh_policy",
    "capture_start_mode",
    "capture_compliance_mode",
    "allow_admin_direct_access",
}


def _filled(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


#: Columns that say who is at the terminal.
WHO = ("logname", "uid", "gid")


def summarize_sessions(events: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row per session: times, counters, entry facts, first screen, login evidence, and the first
    known logname, uid and gid where the events carry them.

    Every aggregate combines on the map side, so a huge session costs no more than
    its share of the scan.
    """
    typ, direction, seq = F.col("type"), F.col("dir"), F.col("seq_global")
    is_start = typ == "session_start"
    size = F.coalesce(F.col("n"), F.lit(0))
    text = F.make_valid_utf8(F.expr("try_to_binary(data_b64, 'base64')").cast("string"))
    out_text = F.when((typ == "bytes") & (direction == "out") & (text != ""), F.substring(text, 1, 240))
    sig = F.when(typ == "checkpoint", _filled("sig"))

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), seq))

    def latest_start(name: str) -> Column:
        value = F.when(is_start, _filled(name))
        return F.max_by(value, F.when(value.isNotNull(), seq))

    facts = (
        events.where(F.coalesce(F.trim("session_id"), F.lit("")) != "")
        .groupBy(*keys)
        .agg(
            F.min_by("actor", "seq_global").alias("actor"),
            F.min("ts_ms").alias("started_at_ms"),
            F.max("ts_ms").alias("last_ts_ms"),
            F.max_by(F.col("ts_ms"), F.when(typ == "session_end", seq)).alias("ended_at_ms"),
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(typ == "checkpoint").alias("checkpoint_count"),
            F.count_if(typ == "deterministic_input").alias("deterministic_input_count"),
            F.sum(F.when((typ == "bytes") & (direction == "in"), size).otherwise(0)).alias("bytes_in"),
            F.sum(F.when((typ == "bytes") & (direction == "out"), size).otherwise(0)).alias("bytes_out"),
            F.max("seq_global").alias("last_seq_global"),
            F.max(F.when(typ == "session_end", 1).otherwise(0)).alias("__ended"),
            F.array_join(F.array_sort(F.collect_set(F.coalesce(typ, F.lit("unknown")))), ",").alias("event_types"),
            F.max(is_start).alias("session_start_observed"),
            F.max_by(F.coalesce(F.col("via_gateway"), F.lit(True)), F.when(is_start, seq)).alias("__via"),
            latest_start("gateway_endpoint").alias("__endpoint"),
            latest_start("source_command").alias("__command"),
            first(sig).alias("__sig"),
            first(out_text).alias("__out"),
            *[first(F.col(who)).alias(who) for who in WHO if who in events.columns],
        )
    )
    via = F.coalesce("__via", F.col("session_start_observed"))
    return facts.select(
        *[c for c in facts.columns if not c.startswith("__")],
        F.when(F.col("__ended") == 1, "closed").otherwise("open").alias("status"),
        via.alias("via_gateway"),
        F.when(F.col("session_start_observed") | via, "gateway_ssh").otherwise("direct").alias("entry_mode"),
        F.coalesce("__endpoint", F.lit("")).alias("gateway_endpoint"),
        F.coalesce("__command", F.lit("")).alias("source_command"),
        F.coalesce("__sig", F.lit("")).alias("first_checkpoint_sig"),
        F.coalesce("__out", F.lit("")).alias("first_output_excerpt"),
        (looks_like_login(F.col("__sig")) | looks_like_login(F.col("__out"))).alias("login_sequence_observed"),
    )


def session_compliance(sessions: DataFrame) -> DataFrame:
    """Add status and reasons; the normalised policy columns must be on each row."""
    required = F.col("gateway_required")
    mode, start = F.col("capture_compliance_mode"), F.col("capture_start_mode")
    login = start == "login_required"
    command = F.col("source_command") != ""
    reasons = F.concat_ws(
        "; ",
        F.when(required & ~F.col("via_gateway"), REASON_NO_GATEWAY),
        F.when((start == "session_start_required") & ~F.col("session_start_observed"), REASON_NO_START),
        F.when(login & command, REASON_COMMAND),
        F.when(login & ~command & ~F.col("login_sequence_observed"), REASON_NO_LOGIN),
    )
    exempt = (mode == "off") & ~required
    return (
        sessions.withColumn("__reasons", reasons)
        .withColumn(
            "compliance_status",
            F.when(exempt, "not_applicable")
            .when(F.col("__reasons") == "", "compliant")
            .when(mode == "warn", "warning")
            .otherwise("non_compliant"),
        )
        .withColumn(
            "compliance_reason",
            F.when(exempt, REASON_NOT_APPLICABLE)
            .when(F.col("__reasons") == "", REASON_OK)
            .otherwise(F.col("__reasons")),
        )
        .drop("__reasons")
    )


def capture_compliance(sessions: DataFrame, capture: str) -> DataFrame:
    """Roll the session statuses of a capture up to one status."""
    status = F.col("compliance_status")
    totals = sessions.groupBy(capture, "capture_compliance_mode").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(status == "compliant").alias("compliant_sessions"),
        F.count_if(status == "warning").alias("warning_sessions"),
        F.count_if(~status.isin("compliant", "warning", "not_applicable")).alias("non_compliant_sessions"),
        F.every("via_gateway").alias("via_gateway"),
        F.max("last_ts_ms").alias("validated_at_ms"),
    )
    return totals.withColumn(
        "summary_status",
        F.when(
            F.col("non_compliant_sessions") > 0,
            F.when(F.col("capture_compliance_mode") == "strict", "rejected").otherwise("warning"),
        )
        .when(F.col("warning_sessions") > 0, "warning")
        .otherwise("compliant"),
    )


def run_compliance(captures: DataFrame) -> DataFrame:
    """Run gate over captures with columns of ``capture_compliance`` plus policy, transport and route."""
    direct = (
        F.col("gateway_required")
        & F.col("transport").isin("ssh", "telnet")
        & F.col("direct_ssh_policy").isin("gateway_only", "admin_only", "disabled")
        & ~F.col("has_gateway_route")
    )
    reasons = F.concat_ws(
        "; ",
        F.when(
            F.col("non_compliant_sessions") > 0,
            F.concat(F.col("non_compliant_sessions").cast("string"), F.lit(" sessão(ões) não conformes na origem")),
        ),
        F.when(
            F.col("warning_sessions") > 0,
            F.concat(F.col("warning_sessions").cast("string"), F.lit(" sessão(ões) com alerta de origem")),
        ),
        F.when(
            direct,
            F.concat(
                F.lit("replay usa transporte direto "),
                F.col("transport"),
                F.lit(" para target com política "),
                F.col("direct_ssh_policy"),
                F.lit("; é obrigatório informar rota via gateway/bastion"),
            ),
        ),
    )
    mode = F.col("capture_compliance_mode")
    return (
        captures.withColumn("__r", reasons)
        .withColumn(
            "compliance_status",
            F.when(F.col("__r") == "", "compliant")
            .when(mode == "strict", "rejected")
            .when(mode == "warn", "warning")
            .otherwise("non_compliant"),
        )
        .withColumn(
            "compliance_reason",
            F.when(F.col("__r") == "", "origem da captura e rota do run compatíveis com a policy").otherwise(
                F.col("__r")
            ),
        )
        .withColumn("entry_mode", F.when(F.col("via_gateway"), "gateway_ssh").otherwise("mixed"))
        .drop("__r")
    )


def search_sessions(
    sessions: DataFrame,
    actor: str = "",
    session_id: str = "",
    event_type: str | tuple[str, ...] = "",
    text: str = "",
    started_from: int = 0,
    last_to: int = 0,
    limit: int | None = None,
    logname: str = "",
    uid: str = "",
    gid: str = "",
) -> DataFrame:
    """Matching sessions; the newest ``limit`` of them, or all.

    Names match anywhere and in any case, ids as a whole; of several event types a session has at
    least one.  A session without a value that is asked for does not match.
    """
    found = sessions
    for name, wanted in (("actor", actor), ("logname", logname), ("session_id", session_id)):
        if wanted.strip():
            found = found.where(F.contains(F.lower(name), F.lit(wanted.strip().lower())))
    for name, wanted in (("uid", uid), ("gid", gid)):
        if wanted.strip():
            found = found.where(F.col(name).cast("string") == wanted.strip())
    kinds = [k.strip().lower() for k in ((event_type,) if isinstance(event_type, str) else event_type) if k.strip()]
    if kinds:
        found = found.where(F.arrays_overlap(F.split(F.lower("event_types"), ","), F.array(*[F.lit(k) for k in kinds])))
    if text.strip():
        found = found.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.strip().lower())))
    if started_from > 0:
        found = found.where(F.col("started_at_ms") >= started_from)
    if last_to > 0:
        found = found.where(F.col("last_ts_ms") <= last_to)
    return found if limit is None else found.orderBy(F.desc("last_ts_ms"), "session_id").limit(max(1, limit))


def attention(*fields: str) -> Column:
    """True where the serialised event mentions trouble."""
    return F.lower(F.to_json(F.struct(*fields))).rlike("error|fail|warning|unknown_screen")


def tail(events: DataFrame, limit: int = 40) -> DataFrame:
    """The newest events of the log, oldest first."""
    return events.orderBy(F.desc("seq_global")).limit(limit).orderBy("seq_global")


def event_summary(events: DataFrame, attention_flag: Column) -> DataFrame:
    """Counters of an event window in one pass."""
    return events.agg(
        F.count(F.lit(1)).alias("window_events"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("actor").alias("unique_actors"),
        F.count_if(F.col("type") == "checkpoint").alias("checkpoints"),
        F.count_if(F.col("type") == "deterministic_input").alias("deterministic_inputs"),
        F.count_if(attention_flag).alias("attention_events"),
        F.max_by("ts_ms", "seq_global").alias("last_ts_ms"),
    )


def top_types(events: DataFrame, k: int = 5) -> DataFrame:
    return (
        events.groupBy("type").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "type").limit(k)
    )


def timeline(
    events: DataFrame, session_id: str, seq_from: int = 0, seq_to: int = 0, ts_from: int = 0, ts_to: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Slice of one session: its first ``limit`` events in order, or all."""
    part = events.where(F.col("session_id") == session_id)
    for name, low, high in (("seq_global", seq_from, seq_to), ("ts_ms", ts_from, ts_to)):
        if low:
            part = part.where(F.col(name) >= low)
        if high:
            part = part.where(F.col(name) <= high)
    return part if limit is None else part.orderBy("seq_global", "seq_session", "ts_ms").limit(max(1, limit))


def replay_window(
    events: DataFrame, session_id: str = "", seq_from: int = 0, seq_to: int = 0, from_sig: str = ""
) -> DataFrame:
    """Events chosen for replay; a checkpoint signature moves the start to its first hit.

    A signature that never occurs fails the query, as does an empty range.
    """
    if seq_from and seq_to and seq_from > seq_to:
        raise ValueError("replay start lies after replay end")
    part = events.where(F.col("session_id") == session_id) if session_id else events
    if from_sig:
        first_hit = part.where((F.col("type") == "checkpoint") & (F.col("sig") == from_sig)).agg(
            F.coalesce(
                F.min("seq_global"), F.raise_error(F.lit(f"start checkpoint not found: {from_sig}")).cast("long")
            )
        )
        part = part.where(F.col("seq_global") >= first_hit.scalar())
    if seq_from:
        part = part.where(F.col("seq_global") >= seq_from)
    if seq_to:
        part = part.where(F.col("seq_global") <= seq_to)
    return part


def replay_inputs(events: DataFrame, mode: str = "raw") -> DataFrame:
    """Events that are sent during replay."""
    if mode == "deterministic":
        return events.where(F.col("type") == "deterministic_input")
    return events.where((F.col("type") == "bytes") & (F.col("dir") == "in"))


def decode_payload(events: DataFrame) -> DataFrame:
    """Decoded bytes with the integrity finding of each payload."""
    # the SQL text form reaches the null-on-error decoder
    raw = F.expr("try_to_binary(coalesce(data_b64, ''), 'base64')")
    length = F.octet_length("raw").cast("long")
    return (
        events.withColumn("raw", raw)
        .withColumn("actual_bytes", F.coalesce(length, F.lit(0)).cast("long"))
        .withColumn(
            "integrity_error",
            F.when(F.col("raw").isNull(), "invalid_base64").when(
                F.col("n").isNotNull() & (F.col("n") != length), "byte_count_mismatch"
            ),
        )
    )


def session_index(events: DataFrame) -> DataFrame:
    """Position, byte ordinal, running decoded size and order check per event."""
    is_bytes = F.col("type") == "bytes"
    sized = events.withColumn(
        "decoded_len",
        F.when(is_bytes, F.coalesce(F.octet_length(F.expr("try_to_binary(data_b64, 'base64')")), F.lit(0))).cast(
            "long"
        ),
    )
    indexed = ordered.scan(
        sized,
        ["session_id"],
        ["seq_global"],
        position=ordered.row_number(),
        byte_count=ordered.running_sum(F.when(is_bytes, 1).otherwise(0).cast("long")),
        bytes_in_so_far=ordered.running_sum(F.when(F.col("dir") == "in", F.col("decoded_len")).otherwise(0)),
        bytes_out_so_far=ordered.running_sum(F.when(F.col("dir") == "out", F.col("decoded_len")).otherwise(0)),
        previous_ts=ordered.lag(F.col("ts_ms")),
    )
    return indexed.select(
        "session_id",
        "seq_global",
        (F.col("position") - 1).alias("position"),
        F.when(is_bytes, F.col("byte_count") - 1).alias("byte_ordinal"),
        F.when(is_bytes, F.col("dir")).alias("direction"),
        "decoded_len",
        "bytes_in_so_far",
        "bytes_out_so_far",
        F.coalesce(F.col("ts_ms") >= F.col("previous_ts"), F.lit(True)).alias("monotonic"),
    )


def playback_page(
    events: DataFrame, offset: int | None = None, limit: int | None = None
) -> DataFrame:
    """Byte events of each session inside the page, with session totals and the last OUT before the page.

    Without offset and limit whole sessions are returned; ``windowed`` tells that a page was asked for.
    """
    ordinals = session_index(events).where(F.col("byte_ordinal").isNotNull())
    explicit = offset is not None or limit is not None
    start = max(0, offset or 0) if explicit else 0
    before = F.when((F.col("byte_ordinal") < start) & (F.col("direction") == "out"), F.col("byte_ordinal"))
    totals = ordinals.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_byte_events"),
        F.sum(F.when(F.col("direction") == "in", F.col("decoded_len")).otherwise(0)).alias("total_in"),
        F.sum(F.when(F.col("direction") == "out", F.col("decoded_len")).otherwise(0)).alias("total_out"),
        F.max(before).alias("base_out_ordinal"),
    )
    inside = F.col("byte_ordinal") >= start
    if limit is not None:
        inside &= F.col("byte_ordinal") < start + max(1, limit)
    return (
        ordinals.join(totals, "session_id")
        .where(inside)
        .select(
            "session_id", "seq_global", "byte_ordinal", "direction", "decoded_len", "total_byte_events",
            "total_in", "total_out", F.coalesce("base_out_ordinal", F.lit(-1)).cast("long").alias("base_out_ordinal"),
            F.lit(explicit).alias("windowed"),
        )
    )


def annotate_timeline(events: DataFrame, failures: DataFrame) -> DataFrame:
    """Event kind per row and the number and worst type of failures linked by sequence."""
    linked = failures.groupBy("session_id", "seq_global").agg(
        F.count(F.lit(1)).alias("linked_failures"),
        F.min("failure_type").alias("first_failure_type"),
    )
    typ = F.col("type")
    kind = (
        F.when(F.col("linked_failures").isNotNull(), "failure")
        .when(typ.isin("checkpoint", "session_start", "session_end", "deterministic_input"), typ)
        .when(typ == "unknown_screen", "warning")
        .when(typ == "bytes", "io")
        .otherwise("neutral")
    )
    return events.join(linked, ["session_id", "seq_global"], "left").select(
        "session_id",
        "seq_global",
        kind.alias("event_kind"),
        F.coalesce("linked_failures", F.lit(0)).cast("long").alias("linked_failures"),
        "first_failure_type",
    )


def screen_segments(events: DataFrame) -> DataFrame:
    """Number the screens of each session.

    A checkpoint always opens a screen; an input opens one when its signature differs
    from the screen before it.
    """
    hot = ordered.hot_keys(events, ["session_id"], "seq_global")
    known = ordered.scan(
        events, ["session_id"], ["seq_global"], hot, prev_sig=ordered.last_known(F.col("sig"), include_current=False)
    )
    opens = F.col("sig").isNotNull() & (
        (F.col("type") == "checkpoint") | F.col("prev_sig").isNull() | (F.col("sig") != F.col("prev_sig"))
    )
    return ordered.scan(
        known.withColumn("__opens", opens.cast("long")),
        ["session_id"],
        ["seq_global"],
        hot,
        screen_no=ordered.running_sum(F.col("__opens")),
    ).drop("__opens", "prev_sig")


def screens_with_inputs(events: DataFrame) -> DataFrame:
    """One row per screen: signature, first event, inputs typed on it."""
    return (
        screen_segments(events)
        .where(F.col("screen_no") > 0)
        .groupBy("session_id", "screen_no")
        .agg(
            F.min_by("sig", "seq_global").alias("sig"),
            F.min("seq_global").alias("first_seq"),
            F.count_if(F.col("type") == "deterministic_input").alias("inputs"),
            F.min(F.when(F.col("type") == "deterministic_input", F.col("seq_global"))).alias("first_input_seq"),
        )
    )


def screen_steps(events: DataFrame) -> DataFrame:
    """Each screen of a session with the one that follows it."""
    screens = events.where(F.col("sig").isNotNull())
    return (
        ordered.scan(screens, ["session_id"], ["seq_global"], next_sig=ordered.lead(F.col("sig")))
        .where(F.col("next_sig").isNotNull())
        .select("session_id", "seq_global", F.col("sig").alias("from_sig"), F.col("next_sig").alias("to_sig"))
    )


def screen_transitions(events: DataFrame) -> DataFrame:
    """How often one screen follows another, over all sessions."""
    return screen_steps(events).groupBy("from_sig", "to_sig").agg(F.count(F.lit(1)).alias("transitions"))


def start_screen_journeys(events: DataFrame, steps: int = 10) -> DataFrame:
    """The first transitions seen from each start screen, as journey steps."""
    numbered = ordered.scan(screen_steps(events), ["from_sig"], ["seq_global"], step_order=ordered.row_number())
    return numbered.where(F.col("step_order") <= steps)


def recorded_journey(events: DataFrame) -> DataFrame:
    """Distinct screens of a session in order of first appearance with the i-th input."""
    first_seen = (
        events.where((F.col("type") == "checkpoint") & F.col("sig").isNotNull())
        .groupBy("session_id", "sig")
        .agg(F.min("seq_global").alias("first_seq"))
    )
    screens = ordered.scan(first_seen, ["session_id"], ["first_seq"], step_order=ordered.row_number())
    inputs = ordered.scan(
        events.where(F.col("type") == "deterministic_input").select(
            "session_id", "seq_global", F.col("sig").alias("input_template")
        ),
        ["session_id"],
        ["seq_global"],
        step_order=ordered.row_number(),
    ).drop("seq_global")
    return screens.join(inputs, ["session_id", "step_order"], "left")


def pacing_plan(inputs: DataFrame, speed: float, ramp_per_sec: float, users: int, jitter_ms: int = 0, seed: str = "") -> DataFrame:
    """Send offsets of a replay: gap divided by speed, started along a ramp, user by hash.

    Every gap is drawn out by up to ``jitter_ms``, by a hash of seed, session and number, so that a
    plan can be made again.
    """
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "session_id", F.col("seq_global").cast("string")), 256), 1, 8), 16, 10)
    jitter = F.when(F.col("prev_ts").isNotNull(), drawn.cast("long") % (jitter_ms + 1)).otherwise(0)
    hot = ordered.hot_keys(inputs, ["session_id"], "seq_global")
    gaps = ordered.scan(inputs, ["session_id"], ["seq_global"], hot, prev_ts=ordered.lag(F.col("ts_ms"))).withColumn(
        "wait_ms", F.coalesce(F.floor(F.greatest(F.col("ts_ms") - F.col("prev_ts"), F.lit(0)) / speed), F.lit(0)) + jitter
    )
    timed = ordered.scan(gaps, ["session_id"], ["seq_global"], hot, offset_ms=ordered.running_sum(F.col("wait_ms")))
    starts = inputs.select("session_id").distinct().withColumn("plan", F.lit("plan"))
    ranked = ordered.scan(starts, ["plan"], ["session_id"], session_rank=ordered.row_number())
    digits = F.expr("transform(split(sha2(session_id, 256), ''), c -> conv(c, 16, 10))")
    modulo = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d.cast("long")) % users)
    ranked = ranked.select(
        "session_id",
        ((F.col("session_rank") - 1) / ramp_per_sec * 1000).alias("start_ms"),
        modulo.alias("user_slot"),
    )
    return timed.join(ranked, "session_id").select(
        "session_id", "seq_global", "wait_ms", (F.col("start_ms") + F.col("offset_ms")).alias("send_at_ms"), "user_slot"
    )


def connection_changes(samples: DataFrame) -> DataFrame:
    """Open and close events from periodic samples of (connection, sample number)."""
    seen = samples.distinct()
    expected = seen.select("connection", (F.col("sample") + 1).alias("sample"))
    opened = seen.join(expected, ["connection", "sample"], "left_anti").withColumn("change", F.lit("open"))
    closed = expected.join(seen, ["connection", "sample"], "left_anti").withColumn("change", F.lit("close"))
    return opened.unionByName(closed)
