"""Run reports: failures, baselines, regressions, reprocessing, scenarios, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import ordered

# Failure and severity vocabulary with the weights of the criticality score.
FAILURE_TYPES = (
    "functional", "timeout", "screen_divergence", "technical_error", "navigation_error",
    "concurrency_error", "checkpoint_mismatch", "integrity_error", "cancelled",
)
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_WEIGHTS = {"critical": 12, "high": 6, "medium": 3, "low": 1}
OPEN_STATUSES = ("queued", "running", "paused")
ENDED_BADLY = ("failed", "cancelled")

SIGNATURE = ("failure_type", "severity", "expected_value", "observed_value")


def signature() -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in SIGNATURE])


def pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100.0, 1)).otherwise(0.0)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for place, name in enumerate(reversed(SEVERITIES), start=1):
        rank = F.when(severity == name, 5 - place).otherwise(rank)
    return rank


def normalize_failures(raw: DataFrame) -> DataFrame:
    """Unknown types become technical_error, unknown severities high, nulls the defaults."""
    kind, severity = F.trim("failure_type"), F.trim("severity")
    texts = [c for c in ("session_id", "flow_name", "expected_value", "observed_value") if c in raw.columns]
    numbers = [c for c in ("seq_global", "seq_session") if c in raw.columns]
    changed = {
        "failure_type": F.when(kind.isin(*FAILURE_TYPES), kind).otherwise("technical_error"),
        "severity": F.when(severity.isin(*SEVERITIES), severity).otherwise("high"),
        **{c: F.coalesce(c, F.lit("")) for c in texts},
        **{c: F.coalesce(c, F.lit(0)).cast("long") for c in numbers},
    }
    return raw.withColumns(changed)


def run_environment(params: Column, host: Column) -> Column:
    """First non-empty of the four environment keys of the JSON parameters, else the host."""
    keys = ("environment", "env", "target_env", "target_environment")
    found = [F.trim(F.get_json_object(params, f"$.{k}")) for k in keys]
    return F.coalesce(*[F.when(v != "", v) for v in found], F.trim(host), F.lit(""))


def normalize_tags(csv: Column) -> Column:
    """Trimmed non-empty tags, first occurrence kept, twelve at most."""
    clean = F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_distinct(clean), 1, 12)


def failure_breakdown(failures: DataFrame) -> DataFrame:
    """Failures of every run by type, severity, flow, session and flow × severity.

    Equal failures are counted first, which also keeps a run of any size small; the counts then meet
    by run, and the groupings are made there without moving rows again.
    """
    session = F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), F.lit("sem_sessao"))
    flow = F.coalesce(F.nullif(F.trim("flow_name"), F.lit("")), F.lit("sem_fluxo"))
    names = ("failure_type", "severity", "flow_name", "session_id")
    dimensions = {
        "type": ("failure_type",), "severity": ("severity",), "flow": ("flow_name",), "session": ("session_id",),
        "flow_severity": ("flow_name", "severity"), "total": (),
    }
    clean = failures.select("run_id", "failure_type", "severity", flow.alias("flow_name"), session.alias("session_id"), "seq_global")
    counted = clean.groupBy("run_id", *names).agg(F.count(F.lit(1)).alias("n"), F.max("seq_global").alias("last"))
    none = {c: F.lit(None).cast(clean.schema[c].dataType) for c in names}
    sets = F.array(*[
        F.struct(F.lit(name).alias("dimension"), *[(F.col(c) if c in of else none[c]).alias(c) for c in names])
        for name, of in dimensions.items()
    ])
    flat = counted.repartition("run_id").select("run_id", F.explode(sets).alias("g"), "n", "last").select("run_id", "g.*", "n", "last")
    return flat.groupBy("run_id", "dimension", *names).agg(F.sum("n").alias("failures"), F.max("last").alias("last_seq_global"))


def failure_groups(failures: DataFrame, *scope: str) -> DataFrame:
    """Counts per failure signature; the scope is usually the run."""
    return failures.groupBy(*scope, signature().alias("signature")).agg(
        F.first("failure_type").alias("failure_type"),
        F.first("severity").alias("severity"),
        F.count(F.lit(1)).alias("failures"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct(F.when(F.col("seq_global") != 0, F.col("seq_global"))).alias("seq_globals"),
    )


def group_members(failures: DataFrame, *scope: str) -> DataFrame:
    """The sessions and sequence numbers of each signature, one row each (never one long list)."""
    members = F.array(
        F.struct(F.lit("session").alias("kind"), F.col("session_id").alias("member")),
        F.struct(F.lit("seq_global").alias("kind"), F.col("seq_global").cast("string").alias("member")),
    )
    return (
        failures.select(*scope, signature().alias("signature"), F.explode(members).alias("m"))
        .select(*scope, "signature", "m.kind", "m.member")
        .where(F.col("member").isNotNull() & (F.col("member") != "") & ~((F.col("kind") == "seq_global") & (F.col("member") == "0")))
        .distinct()
    )


def group_messages(failures: DataFrame, *scope: str, keep: int = 5) -> DataFrame:
    """The newest distinct messages of each signature, ``keep`` per signature."""
    distinct = (
        failures.where(F.col("message") != "")
        .groupBy(*scope, signature().alias("signature"), "message")
        .agg((-F.max("ts_ms")).alias("age"))
    )
    ranked = ordered.scan(distinct, [*scope, "signature"], ["age", "message"], place=ordered.row_number())
    return ranked.where(F.col("place") <= keep).drop("age")


def choose_baselines(runs: DataFrame, match: list[str]) -> DataFrame:
    """Baseline per run: an existing parent, else the newest earlier run with equal keys."""
    known = runs.select(F.col("run_id").alias("parent_run_id"), F.lit(True).alias("parent_exists"))
    previous = ordered.scan(
        runs.select("run_id", "parent_run_id", *match), match, ["run_id"], previous=ordered.lag(F.col("run_id"))
    )
    parent = F.when(F.col("parent_exists"), F.col("parent_run_id"))
    return previous.join(known, "parent_run_id", "left").select(
        "run_id",
        F.coalesce(parent, "previous").alias("baseline_run_id"),
        F.when(parent.isNotNull(), "parent")
        .when(F.col("previous").isNotNull(), "previous_match")
        .otherwise("missing")
        .alias("baseline_mode"),
    )


#: Failures one task counts and pairs; with more of them there are more tasks, not larger ones.
ROWS_PER_TASK = 1_000_000


def _tasks(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))


def _paired(failures: DataFrame, baselines: DataFrame, key: str, value: Column) -> DataFrame:
    """Failures of each run by ``value`` next to those of its baseline, dealt by runs throughout."""
    tasks = _tasks(failures)
    dealt = failures.select("run_id", value.alias(key)).repartition(tasks, "run_id")
    counts = dealt.groupBy("run_id", key).agg(F.count(F.lit(1)).alias("failures"))
    current = counts.select("run_id", key, F.col("failures").alias("current"), F.lit(0).alias("base"))
    pairs = baselines.where(F.col("baseline_run_id").isNotNull()).select("run_id", "baseline_run_id")
    base = counts.select(F.col("run_id").alias("baseline_run_id"), key, "failures").join(pairs, "baseline_run_id")
    base = base.select("run_id", key, F.lit(0).alias("current"), F.col("failures").alias("base"))
    return (
        current.unionByName(base)
        .repartition(tasks, "run_id")
        .groupBy("run_id", key)
        .agg(F.sum("current").alias("current_count"), F.sum("base").alias("baseline_count"))
    )


def compare_groups(failures: DataFrame, baselines: DataFrame) -> DataFrame:
    """New, recurring and resolved failure groups of every run against its baseline."""
    state = (
        F.when(F.col("baseline_count") == 0, "new").when(F.col("current_count") == 0, "resolved").otherwise("recurring")
    )
    return _paired(failures, baselines, "signature", signature()).select(
        "run_id", "signature", state.alias("state"), "current_count", "baseline_count",
        (F.col("current_count") - F.col("baseline_count")).alias("delta_count"),
    )


def compare_flows(failures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Failures per flow of each run with a baseline against that baseline."""
    flow = F.coalesce(F.nullif(F.trim("flow_name"), F.lit("")), F.lit("sem_fluxo"))
    based = baselines.where(F.col("baseline_run_id").isNotNull())
    return (
        _paired(failures, baselines, "flow_name", flow)
        .join(based.select("run_id"), "run_id", "left_semi")
        .withColumn("delta_count", F.col("current_count") - F.col("baseline_count"))
        .withColumn("regression", F.col("delta_count") > 0)
    )


def compare_runs(runs: DataFrame, failures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Summary per run: group counters, failure delta and the regression flag.

    A run without baseline counts no new group and is no regression.
    """
    groups = (
        compare_groups(failures, baselines)
        .groupBy("run_id")
        .agg(
            F.count_if(F.col("state") == "new").alias("new_groups"),
            F.count_if(F.col("state") == "recurring").alias("recurring_groups"),
            F.count_if(F.col("state") == "resolved").alias("resolved_groups"),
            F.sum("current_count").alias("current_failures"),
            F.sum("baseline_count").alias("baseline_failures"),
        )
    )
    base_status = runs.select(F.col("run_id").alias("baseline_run_id"), F.col("status").alias("baseline_status"))
    joined = (
        runs.select("run_id", "status", "environment", "created_at_ms")
        .join(baselines, "run_id")
        .join(base_status, "baseline_run_id", "left")
        .join(groups, "run_id", "left")
    )
    based = F.col("baseline_run_id").isNotNull()

    def counted(name: str, needs_baseline: bool = True) -> Column:
        value = F.coalesce(F.col(name), F.lit(0)).cast("long")
        return (F.when(based, value).otherwise(F.lit(0).cast("long")) if needs_baseline else value).alias(name)

    regression = based & (
        (F.coalesce("new_groups", F.lit(0)) > 0)
        | (F.coalesce("current_failures", F.lit(0)) > F.coalesce("baseline_failures", F.lit(0)))
        | ((F.col("baseline_status") == "success") & F.col("status").isin(*ENDED_BADLY))
    )
    return joined.select(
        "run_id", "status", "environment", "created_at_ms", "baseline_mode", "baseline_run_id",
        counted("new_groups"), counted("recurring_groups"), counted("resolved_groups"),
        counted("current_failures", False), counted("baseline_failures"),
        F.coalesce(regression, F.lit(False)).alias("regression"),
    )


def newest_runs(runs: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` runs of a report, chosen before any filter; without it all."""
    return runs if limit is None else runs.orderBy(F.desc("run_id")).limit(max(1, limit))


def environment_trend(
    runs: DataFrame, failures: DataFrame, baselines: DataFrame, limit: int | None = None, environment: str = "",
    created_from_ms: int = 0, created_to_ms: int = 0,
) -> DataFrame:
    """Runs, failures, regressions and most failing flow per environment."""
    chosen = newest_runs(runs, limit)
    if environment:
        chosen = chosen.where(F.contains(F.lower("environment"), F.lit(environment.lower())))
    if created_from_ms:
        chosen = chosen.where(F.col("created_at_ms") >= created_from_ms)
    if created_to_ms:
        chosen = chosen.where(F.col("created_at_ms") <= created_to_ms)
    compared = compare_runs(runs, failures, baselines).join(chosen.select("run_id"), "run_id", "left_semi")
    totals = compared.groupBy("environment").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("current_failures").alias("failures"),
        F.count_if("regression").alias("regressions"),
    )
    flows = (
        failures.groupBy("run_id", "flow_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(chosen.select("run_id", "environment"), "run_id")
        .groupBy("environment", "flow_name")
        .agg(F.sum("n").alias("n"))
        .groupBy("environment")
        .agg(F.min_by("flow_name", F.struct(-F.col("n"), F.col("flow_name"))).alias("top_flow"))
    )
    return totals.join(flows, "environment", "left").withColumn("top_flow", F.coalesce("top_flow", F.lit("")))


def flow_trend(runs: DataFrame, failures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Failures, regressing runs and number of environments per flow."""
    per_run = failures.groupBy("run_id", "flow_name").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        per_run.join(runs.select("run_id", "environment"), "run_id")
        .groupBy("flow_name")
        .agg(F.sum("n").alias("failures"), F.count_distinct("environment").alias("environment_count"))
    )
    worse = compare_flows(failures, baselines).where("regression AND current_count > 0").select("run_id", "flow_name")
    bad_runs = compare_runs(runs, failures, baselines).where("regression").select("run_id")
    regressions = (
        worse.join(bad_runs, "run_id", "left_semi").groupBy("flow_name").agg(F.count(F.lit(1)).alias("regressions"))
    )
    return totals.join(regressions, "flow_name", "left").withColumn(
        "regressions", F.coalesce("regressions", F.lit(0)).cast("long")
    )


def reprocess_outcomes(attempts: DataFrame, failures: DataFrame) -> DataFrame:
    """Outcome of every reprocessing run.

    ``attempts`` has run_id, status, environment, source_run_id and the signature
    columns plus flow_name of the source failure (null when none was found).
    """
    seen = failures.select("run_id", signature().alias("signature")).distinct().withColumn("seen", F.lit(True))
    source = F.col("failure_type").isNotNull()
    marked = attempts.withColumn("signature", signature()).join(seen, ["run_id", "signature"], "left")
    return marked.withColumn(
        "outcome",
        F.when(source & F.col("seen"), "repeated")
        .when(source & (F.col("status") == "success"), "resolved")
        .when(source & F.col("status").isin(*ENDED_BADLY), "not_repeated")
        .otherwise("inconclusive"),
    ).drop("seen")


def reprocess_analytics(outcomes: DataFrame) -> DataFrame:
    """Outcome counters by flow, environment and signature with rates and automation score."""
    flow = F.coalesce(F.nullif("flow_name", F.lit("")), F.lit("sem_fluxo"))
    rows = outcomes.select(
        flow.alias("flow_name"), "environment", "signature", F.coalesce("severity", F.lit("")).alias("severity"), "outcome"
    )
    f, e, s, v = (F.col(c) for c in ("flow_name", "environment", "signature", "severity"))
    counted = rows.groupingSets([[f], [e], [s, v]], f, e, s, v).agg(
        F.count(F.lit(1)).alias("attempts"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("resolved", "repeated", "not_repeated", "inconclusive")],
        F.grouping("flow_name").alias("g_flow"),
        F.grouping("environment").alias("g_env"),
    )
    by_signature = (F.col("g_flow") == 1) & (F.col("g_env") == 1)
    repeat = pct(F.col("repeated"), F.col("attempts"))
    score = F.bround(
        F.least(F.lit(100.0), F.col("attempts") * 8 + repeat * 0.7 + F.when(F.col("severity") == "high", 20).otherwise(0)), 1
    )
    return counted.select(
        F.when(F.col("g_flow") == 0, "flow").when(F.col("g_env") == 0, "environment").otherwise("signature").alias("dimension"),
        F.coalesce("flow_name", "environment", "signature").alias("name"),
        "attempts", "resolved", "repeated", "not_repeated", "inconclusive",
        pct(F.col("resolved"), F.col("attempts")).alias("success_rate_pct"),
        repeat.alias("repeat_rate_pct"),
        F.when(by_signature, score).alias("automation_score"),
    )


def pending_queue(outcomes: DataFrame) -> DataFrame:
    """Reprocessing runs that are still open or repeated their failure."""
    return outcomes.where(F.col("status").isin(*OPEN_STATUSES) | (F.col("outcome") == "repeated"))


def scenario_usage(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Usage of each scenario: runs by status, failure rate, criticality, last use, top users.

    ``runs`` has scenario_id, run_id, status, username and created_at_ms.
    """
    per_run = failures.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(
            F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in SEVERITY_WEIGHTS.items()], F.lit(0))
        ).alias("weight"),
    )
    joined = runs.where(F.col("scenario_id") > 0).join(per_run, "run_id", "left")
    status = F.col("status")
    had_failures = (F.coalesce("n", F.lit(0)) > 0) | status.isin(*ENDED_BADLY)
    usage = joined.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(status == "success").alias("success_runs"),
        F.count_if(status == "failed").alias("failed_runs"),
        F.count_if(status == "cancelled").alias("cancelled_runs"),
        F.count_if(status.isin(*OPEN_STATUSES)).alias("active_runs"),
        F.count_if(had_failures).alias("runs_with_failures"),
        F.sum(F.coalesce("n", F.lit(0))).alias("total_failure_events"),
        F.sum(F.coalesce("weight", F.lit(0))).alias("weight"),
        F.max("created_at_ms").alias("last_used_at_ms"),
        F.max_by("run_id", F.struct("created_at_ms", -F.col("run_id"))).alias("last_run_id"),
    )
    rate = pct(F.col("runs_with_failures"), F.col("total_runs"))
    score = F.bround(
        F.least(F.col("total_runs") * 4, F.lit(30))
        + F.least(F.col("failure_rate_pct") * 0.55, F.lit(55.0))
        + F.least(F.col("weight"), F.lit(25))
        + F.least(F.col("active_runs") * 4, F.lit(10)),
        1,
    )
    usage = (
        usage.withColumn("failure_rate_pct", rate)
        .withColumn("criticality_score", F.least(F.lit(100.0), score))
        .drop("weight")
    )
    return usage.join(top_users(runs), "scenario_id", "left")


def top_users(runs: DataFrame, k: int = 3) -> DataFrame:
    """The k most active users of each scenario as one text."""
    counts = (
        runs.where(F.col("scenario_id") > 0)
        .groupBy("scenario_id", "username")
        .agg((-F.count(F.lit(1))).alias("minus_runs"))
    )
    ranked = ordered.scan(counts, ["scenario_id"], ["minus_runs", "username"], place=ordered.row_number())
    label = F.concat("username", F.lit(":"), (-F.col("minus_runs")).cast("string"))
    places = [F.max(F.when(F.col("place") == p, label)) for p in range(1, k + 1)]
    return ranked.where(F.col("place") <= k).groupBy("scenario_id").agg(F.concat_ws(",", *places).alias("top_users"))


def sla_status(df: DataFrame) -> DataFrame:
    """SLA columns over failure rate and criticality: breached above a limit, warning from 80 %."""

    def breach(value: str, limit: str, label: str) -> Column:
        v, m = F.coalesce(value, F.lit(0.0)), F.col(limit)
        return F.when(v > m, F.concat(F.lit(f"{label} "), F.bround(v, 1).cast("string"), F.lit(" > "), F.bround(m, 1).cast("string")))

    def close(value: str, limit: str, label: str) -> Column:
        v, m = F.coalesce(value, F.lit(0.0)), F.col(limit)
        return F.when(
            (v <= m) & (m > 0) & (v >= m * 0.8),
            F.concat(F.lit(f"{label} perto do limite "), F.bround(v, 1).cast("string"), F.lit("/"), F.bround(m, 1).cast("string")),
        )

    pairs = (
        ("failure_rate_pct", "sla_max_failure_rate_pct", "falha"),
        ("criticality_score", "sla_max_criticality_score", "criticidade"),
    )
    return (
        df.withColumn("sla_breaches", F.concat_ws("; ", *[breach(*p) for p in pairs]))
        .withColumn("sla_warnings", F.concat_ws("; ", *[close(*p) for p in pairs]))
        .withColumn(
            "sla_status",
            F.when(F.col("sla_breaches") != "", "breached").when(F.col("sla_warnings") != "", "warning").otherwise("ok"),
        )
    )


def visible_scenarios(scenarios: DataFrame, users: DataFrame, favourites: DataFrame, user_id: int | None) -> DataFrame:
    """Scenarios a user may see (shared or own) with author name and favourite flag."""
    if user_id is not None:
        scenarios = scenarios.where((F.col("visibility") == "shared") | (F.col("created_by") == user_id))
    mine = favourites.where(F.col("user_id") == (-1 if user_id is None else user_id)).select("scenario_id").distinct()
    names = users.select(F.col("user_id").alias("created_by"), F.col("username").alias("created_by_username"))
    return (
        scenarios.join(names, "created_by", "left")
        .join(mine.withColumn("is_favorite", F.lit(True)), "scenario_id", "left")
        .withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False)))
        .orderBy(F.desc("is_favorite"), F.desc("updated_at_ms"), F.desc("scenario_id"))
    )


SCENARIO_ORDERS = {
    "updated": ("updated_at_ms desc", "scenario_id desc"),
    "most-used": ("total_runs desc", "last_used_at_ms desc", "name"),
    "highest-failure-rate": ("failure_rate_pct desc", "criticality_score desc", "total_runs desc", "name"),
    "criticality": ("criticality_score desc", "failure_rate_pct desc", "total_runs desc", "name"),
    "recent-use": ("last_used_at_ms desc", "updated_at_ms desc", "name"),
    "name": ("lower(name)",),
}


def operational_scenarios(
    scenarios: DataFrame, usage: DataFrame, sort_by: str = "updated", tag: str = "", sla: str = "",
    favorite_only: bool = False, used_only: bool = False, **contains: str,
) -> DataFrame:
    """Scenario listing with usage and SLA.

    Keyword filters (environment, squad, area, owner_name, scenario_type …) match
    case-blind as part of the column of that name.
    """
    zero = {c: 0 for c in ("total_runs", "last_used_at_ms", "failure_rate_pct", "criticality_score")}
    rows = sla_status(scenarios.join(usage, "scenario_id", "left").fillna(zero))
    for name, wanted in contains.items():
        if wanted.strip():
            rows = rows.where(F.contains(F.lower(name), F.lit(wanted.strip().lower())))
    if tag:
        rows = rows.where(F.exists(normalize_tags(F.col("tags_csv")), lambda x: F.contains(F.lower(x), F.lit(tag.lower()))))
    if sla:
        rows = rows.where(F.col("sla_status") == sla)
    if favorite_only:
        rows = rows.where("is_favorite")
    if used_only:
        rows = rows.where("total_runs > 0")
    order = SCENARIO_ORDERS.get(sort_by, SCENARIO_ORDERS["updated"])
    keys = []
    for part in order:
        text, _, direction = part.partition(" ")
        keys.append(F.expr(text).desc() if direction == "desc" else F.expr(text).asc())
    return rows.orderBy(F.desc("is_favorite"), *keys)


def resolve_targets(requests: DataFrame, environments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Run requests with catalog values filled in; an explicit value wins over the catalog.

    ``connection_options`` of the profile overwrite equal keys of the request.
    """
    empty = F.create_map().cast("map<string,string>")
    asked = F.coalesce("connection_options", empty)
    offered = F.coalesce("options", empty)
    kept = F.map_filter(asked, lambda k, _: ~F.array_contains(F.map_keys(offered), k))

    def given(*columns: Column) -> Column:
        return F.trim(F.coalesce(*[F.when(c != "", c) for c in columns], F.lit("")))

    return (
        requests.join(environments, "target_env_id", "left")
        .join(profiles, "connection_profile_id", "left")
        .select(
            *[c for c in ("run_id", "target_env_id", "connection_profile_id") if c in requests.columns],
            given(F.col("target_host"), F.col("env_host")).alias("target_host"),
            given(F.col("target_user"), F.col("username")).alias("target_user"),
            given(F.col("target_command"), F.col("command")).alias("target_command"),
            F.coalesce("profile_transport", "transport_hint", F.lit("ssh")).alias("transport"),
            F.coalesce("profile_port", "requested_port", "env_port").alias("target_port"),
            F.map_concat(kept, offered).alias("connection_options"),
        )
    )


def counters(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Named overview counters, each table read once."""

    def totals(df: DataFrame, section: str, column: str, *extra: tuple[str, Column]) -> DataFrame:
        by = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))
        whole = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in extra])
        names = ["total", *[n for n, _ in extra]]
        stacked = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
        long = whole.select(F.explode(stacked).alias("v")).select("v.name", "v.value")
        return by.unionByName(long).select(F.lit(section).alias("section"), "name", "value")

    open_runs = ("open", F.col("status").isin(*OPEN_STATUSES, "resuming"))
    return totals(runs, "runs", "status", open_runs).unionByName(totals(failures, "failures", "failure_type"))


def run_metrics(results: DataFrame, failures: DataFrame) -> DataFrame:
    """Session results and failures of a run folded into its metrics and final status.

    ``results`` has run_id, session_id, result (success, failed, skipped) and checkpoints_ok.
    """
    sessions = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sessions_total"),
        F.count_if(F.col("result") == "success").alias("sessions_success"),
        F.count_if(F.col("result") == "failed").alias("sessions_failed"),
        F.count_if(F.col("result") == "skipped").alias("sessions_skipped"),
        F.sum("checkpoints_ok").alias("checkpoints_ok"),
    )
    kinds = [
        F.count_if(F.col("failure_type") == k).alias(f"type_{k}") for k in FAILURE_TYPES
    ] + [F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES]
    failed = failures.groupBy("run_id").agg(F.count(F.lit(1)).alias("failures"), *kinds)
    counted = [c for c in failed.columns if c != "run_id"]
    return (
        sessions.join(failed, "run_id", "left")
        .fillna(0, counted)
        .withColumn(
            "final_status",
            F.when(F.col("sessions_failed") > 0, "failed").otherwise("success"),
        )
    )


def listing(df: DataFrame, order: str, limit: int, keep: Column | None = None) -> DataFrame:
    """Newest rows first; a later filter works on the capped rows only, as the page does."""
    page = df.orderBy(F.desc(order)).limit(limit)
    return page if keep is None else page.where(keep)


def capture_page(
    captures: DataFrame, search: str = "", author: str = "", ts_from: int = 0, ts_to: int = 0, status: str = "",
    limit: int = 20, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Total number of matches and one page of captures, newest first."""
    found = captures
    if search.strip().lstrip("-").isdigit():
        found = found.where(F.col("id") == int(search))
    else:
        for name, text in (("session_uuid", search), ("created_by_username", author)):
            if text.strip():
                found = found.where(F.col(name).contains(text.strip()))
        if ts_from > 0:
            found = found.where(F.col("started_at_ms") >= ts_from)
        if ts_to > 0:
            found = found.where(F.col("started_at_ms") <= ts_to)
        if status.strip():
            found = found.where(F.col("status") == status.strip())
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total, found.orderBy(F.desc("started_at_ms"), F.desc("id")).offset(offset).limit(limit)


def report_rows(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """The report of every run in long form: run_id, section (run, summary, flow), name, value.

    ``runs``: run_id, environment; ``failures``: run_id, severity, flow_name.
    """
    about = F.array(
        F.struct(F.lit("id").alias("name"), F.col("run_id").cast("string").alias("value")),
        F.struct(F.lit("environment").alias("name"), F.col("environment").alias("value")),
    )
    rows = runs.select("run_id", F.lit("run").alias("section"), F.explode(about).alias("v")).select("run_id", "section", "v.*")
    kinds = {"summary": F.concat(F.lit("severity."), F.col("severity")), "flow": F.coalesce("flow_name", F.lit("sem_fluxo"))}
    for section, name in kinds.items():
        counted = failures.groupBy("run_id", name.alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value"))
        rows = rows.unionByName(counted.withColumn("section", F.lit(section)))
    return rows
