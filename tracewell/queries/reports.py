"""Queries over runs, failures, scenarios and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import hosts, reports
from tracewell.plans import ordered
from tracewell.queries import tables as t
from tracewell.queries.registry import query
from tracewell.sources import exports
from tracewell.sources import tables as store

_SIG = "concat_ws('|', failure_type, severity, expected_value, observed_value)"

_BASELINES = """
bl AS (
  SELECT r.run_id, coalesce(p.run_id, prev) AS baseline_run_id,
         CASE WHEN p.run_id IS NOT NULL THEN 'parent' WHEN prev IS NOT NULL THEN 'previous_match' ELSE 'missing' END AS baseline_mode
  FROM (SELECT *, lag(run_id) OVER (PARTITION BY scenario_id, mode ORDER BY run_id) AS prev FROM runs) r
  LEFT JOIN runs p ON p.run_id = r.parent_run_id)"""


def _baselines(runs):
    return reports.choose_baselines(runs, ["scenario_id", "mode"])


@query("jn07_baseline_choice", t.with_tables(t.RUNS_SQL, _BASELINES) + "SELECT * FROM bl")
def baseline_choice(spark, sf):
    return _baselines(t.runs(spark, sf))


_GROUPS = f"""
cnt AS (SELECT run_id, {_SIG} AS signature, count(*) AS failures FROM failures GROUP BY 1, 2),
cmp AS (
  SELECT run_id, signature, CAST(sum(cur) AS BIGINT) AS current_count, CAST(sum(base) AS BIGINT) AS baseline_count FROM (
    SELECT run_id, signature, failures AS cur, 0 AS base FROM cnt
    UNION ALL SELECT bl.run_id, signature, 0, failures FROM bl JOIN cnt ON cnt.run_id = bl.baseline_run_id) GROUP BY 1, 2),
cmps AS (SELECT *, CASE WHEN baseline_count = 0 THEN 'new' WHEN current_count = 0 THEN 'resolved' ELSE 'recurring' END AS state,
    current_count - baseline_count AS delta_count FROM cmp),
g AS (SELECT run_id, count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'recurring') AS n_rec,
   count(*) FILTER (state = 'resolved') AS n_res, sum(current_count) AS cur, sum(baseline_count) AS base FROM cmps GROUP BY 1),
rc AS (
  SELECT r.run_id, r.status, r.environment, r.created_at_ms, bl.baseline_mode, bl.baseline_run_id,
    CAST(CASE WHEN bl.baseline_run_id IS NULL THEN 0 ELSE coalesce(n_new, 0) END AS BIGINT) AS new_groups,
    CAST(CASE WHEN bl.baseline_run_id IS NULL THEN 0 ELSE coalesce(n_rec, 0) END AS BIGINT) AS recurring_groups,
    CAST(CASE WHEN bl.baseline_run_id IS NULL THEN 0 ELSE coalesce(n_res, 0) END AS BIGINT) AS resolved_groups,
    CAST(coalesce(cur, 0) AS BIGINT) AS current_failures,
    CAST(CASE WHEN bl.baseline_run_id IS NULL THEN 0 ELSE coalesce(base, 0) END AS BIGINT) AS baseline_failures,
    bl.baseline_run_id IS NOT NULL AND (coalesce(n_new, 0) > 0 OR coalesce(cur, 0) > coalesce(base, 0)
       OR coalesce(b.status = 'success' AND r.status IN ('failed', 'cancelled'), FALSE)) AS regression
  FROM runs r JOIN bl USING (run_id) LEFT JOIN runs b ON b.run_id = bl.baseline_run_id LEFT JOIN g ON g.run_id = r.run_id),
fl AS (SELECT run_id, flow_name, count(*) AS failures FROM failures GROUP BY 1, 2),
fcmp AS (
  SELECT run_id, flow_name, CAST(sum(cur) AS BIGINT) AS current_count, CAST(sum(base) AS BIGINT) AS baseline_count FROM (
    SELECT run_id, flow_name, failures AS cur, 0 AS base FROM fl
    UNION ALL SELECT bl.run_id, flow_name, 0, failures FROM bl JOIN fl ON fl.run_id = bl.baseline_run_id)
  WHERE run_id IN (SELECT run_id FROM bl WHERE baseline_run_id IS NOT NULL) GROUP BY 1, 2)"""
_CTES = (t.RUNS_SQL, t.FAILURES_SQL, _BASELINES, _GROUPS)


@query(
    "jn06_failure_group_comparison",
    t.with_tables(*_CTES) + "SELECT run_id, signature, state, current_count, baseline_count, delta_count FROM cmps",
)
def group_comparison(spark, sf):
    return reports.compare_groups(t.failures(spark, sf), _baselines(t.runs(spark, sf)))


@query(
    "jn06_flow_comparison",
    t.with_tables(*_CTES)
    + "SELECT *, current_count - baseline_count AS delta_count, current_count > baseline_count AS regression FROM fcmp",
)
def flow_comparison(spark, sf):
    return reports.compare_flows(t.failures(spark, sf), _baselines(t.runs(spark, sf)))


@query("jn06_run_comparison", t.with_tables(*_CTES) + "SELECT * FROM rc")
def run_comparison(spark, sf):
    runs = t.runs(spark, sf)
    return reports.compare_runs(runs, t.failures(spark, sf), _baselines(runs))


@query(
    "agg04_run_report",
    t.with_tables(t.FAILURES_SQL)
    + """SELECT run_id, CASE WHEN grouping(failure_type) = 0 THEN 'type'
           WHEN grouping(flow_name) = 0 AND grouping(severity) = 0 THEN 'flow_severity'
           WHEN grouping(flow_name) = 0 THEN 'flow' WHEN grouping(severity) = 0 THEN 'severity'
           WHEN grouping(session_id) = 0 THEN 'session' ELSE 'total' END AS dimension,
         failure_type, severity, flow_name, session_id, count(*) AS failures, max(seq_global) AS last_seq_global
       FROM failures GROUP BY GROUPING SETS ((run_id, failure_type), (run_id, severity), (run_id, flow_name),
         (run_id, session_id), (run_id, flow_name, severity), (run_id))""",
)
def run_report(spark, sf):
    return reports.failure_breakdown(t.failures(spark, sf))


@query(
    "agg05_signature_groups",
    t.with_tables(t.FAILURES_SQL)
    + f"""SELECT {_SIG} AS signature, any_value(failure_type) AS failure_type, any_value(severity) AS severity,
        count(*) AS failures, count(DISTINCT session_id) AS sessions, count(DISTINCT seq_global) AS seq_globals
        FROM failures GROUP BY 1""",
)
def signature_groups(spark, sf):
    return reports.failure_groups(t.failures(spark, sf))


@query(
    "agg05_signature_members",
    t.with_tables(t.FAILURES_SQL)
    + f"""SELECT DISTINCT {_SIG} AS signature, 'session' AS kind, session_id AS member FROM failures
        UNION SELECT DISTINCT {_SIG}, 'seq_global', CAST(seq_global AS VARCHAR) FROM failures WHERE seq_global <> 0""",
)
def signature_members(spark, sf):
    return reports.group_members(t.failures(spark, sf))


@query(
    "agg05_signature_messages",
    t.with_tables(t.FAILURES_SQL)
    + f"""SELECT signature, message, place FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY newest DESC, message) AS place
        FROM (SELECT {_SIG} AS signature, message, max(ts_ms) AS newest FROM failures GROUP BY 1, 2)) WHERE place <= 5""",
)
def signature_messages(spark, sf):
    return reports.group_messages(t.failures(spark, sf))


_PER_RUN_FLOW = "SELECT environment, flow_name, count(*) AS n FROM failures JOIN runs USING (run_id) GROUP BY 1, 2"


@query(
    "agg06_environment_trend",
    t.with_tables(*_CTES)
    + f"""SELECT environment, count(*) AS runs, CAST(sum(current_failures) AS BIGINT) AS failures,
          count(*) FILTER (regression) AS regressions, coalesce(any_value(top_flow), '') AS top_flow
        FROM rc LEFT JOIN (SELECT environment, arg_min(flow_name, (-n, flow_name)) AS top_flow FROM ({_PER_RUN_FLOW}) GROUP BY 1)
          USING (environment) GROUP BY environment""",
)
def environment_trend(spark, sf):
    runs = t.runs(spark, sf)
    return reports.environment_trend(runs, t.failures(spark, sf), _baselines(runs))


@query(
    "agg06_flow_trend",
    t.with_tables(*_CTES)
    + f"""SELECT flow_name, CAST(sum(n) AS BIGINT) AS failures, count(DISTINCT environment) AS environment_count,
          coalesce(any_value(bad), 0) AS regressions FROM ({_PER_RUN_FLOW})
        LEFT JOIN (SELECT flow_name, count(*) AS bad FROM fcmp JOIN rc USING (run_id)
                   WHERE rc.regression AND fcmp.current_count > fcmp.baseline_count GROUP BY 1) USING (flow_name)
        GROUP BY flow_name""",
)
def flow_trend(spark, sf):
    runs = t.runs(spark, sf)
    return reports.flow_trend(runs, t.failures(spark, sf), _baselines(runs))


_ATTEMPTS = f"""
src AS (SELECT run_id AS source_run_id, arg_min(failure_type, o) AS failure_type, arg_min(severity, o) AS severity,
     arg_min(expected_value, o) AS expected_value, arg_min(observed_value, o) AS observed_value, arg_min(flow_name, o) AS flow_name
   FROM (SELECT *, (seq_global, failure_type, severity, expected_value, flow_name) AS o FROM failures) GROUP BY 1),
att AS (SELECT r.run_id, r.status, r.environment, r.parent_run_id AS source_run_id, failure_type, severity, expected_value,
     observed_value, flow_name, concat_ws('|', coalesce(failure_type, ''), coalesce(severity, ''), coalesce(expected_value, ''),
       coalesce(observed_value, '')) AS signature
   FROM runs r LEFT JOIN src ON src.source_run_id = r.parent_run_id WHERE r.parent_run_id IS NOT NULL),
cnt AS (SELECT DISTINCT run_id, {_SIG} AS signature FROM failures),
outc AS (SELECT att.*, CASE WHEN failure_type IS NOT NULL AND cnt.run_id IS NOT NULL THEN 'repeated'
     WHEN failure_type IS NOT NULL AND status = 'success' THEN 'resolved'
     WHEN failure_type IS NOT NULL AND status IN ('failed', 'cancelled') THEN 'not_repeated' ELSE 'inconclusive' END AS outcome
   FROM att LEFT JOIN cnt ON cnt.run_id = att.run_id AND cnt.signature = att.signature)"""


def _outcomes(spark, sf):
    failures = t.failures(spark, sf)
    order = F.struct("seq_global", "failure_type", "severity", "expected_value", "flow_name")
    fields = ("failure_type", "severity", "expected_value", "observed_value", "flow_name")
    source = (
        failures.groupBy(F.col("run_id").alias("source_run_id"))
        .agg(F.min_by(F.struct(*fields), order).alias("f"))
        .select("source_run_id", "f.*")
    )
    attempts = (
        t.runs(spark, sf)
        .where(F.col("parent_run_id").isNotNull())
        .select("run_id", "status", "environment", F.col("parent_run_id").alias("source_run_id"))
        .join(source, "source_run_id", "left")
    )
    return reports.reprocess_outcomes(attempts, failures)


_RATE = "CASE WHEN attempts > 0 THEN round_even({0} / attempts * 100.0, 1) ELSE 0.0 END"


@query(
    "agg07_reprocess_analytics",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _ATTEMPTS)
    + f""", c AS (SELECT CASE WHEN grouping(flow) = 0 THEN 'flow' WHEN grouping(environment) = 0 THEN 'environment' ELSE 'signature' END AS dimension,
          coalesce(flow, environment, signature) AS name, sev, count(*) AS attempts,
          count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'repeated') AS repeated,
          count(*) FILTER (outcome = 'not_repeated') AS not_repeated, count(*) FILTER (outcome = 'inconclusive') AS inconclusive
        FROM (SELECT coalesce(flow_name, 'sem_fluxo') AS flow, environment, signature, coalesce(severity, '') AS sev, outcome FROM outc)
        GROUP BY GROUPING SETS ((flow), (environment), (signature, sev)))
      SELECT dimension, name, attempts, resolved, repeated, not_repeated, inconclusive,
        {_RATE.format('resolved')} AS success_rate_pct, {_RATE.format('repeated')} AS repeat_rate_pct,
        CASE WHEN dimension = 'signature' THEN round_even(least(100.0, attempts * 8.0 + {_RATE.format('repeated')} * CAST(0.7 AS DOUBLE)
             + CASE WHEN sev = 'high' THEN 20 ELSE 0 END), 1) END AS automation_score FROM c""",
)
def reprocess_analytics(spark, sf):
    return reports.reprocess_analytics(_outcomes(spark, sf))


@query(
    "agg07_pending_queue",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _ATTEMPTS)
    + """SELECT run_id, source_run_id, status, outcome, environment FROM outc
         WHERE status IN ('queued', 'running', 'paused') OR outcome = 'repeated'""",
)
def pending_queue(spark, sf):
    return reports.pending_queue(_outcomes(spark, sf)).select("run_id", "source_run_id", "status", "outcome", "environment")


_USAGE = """
pr AS (SELECT run_id, count(*) AS n, CAST(sum(CASE severity WHEN 'critical' THEN 12 WHEN 'high' THEN 6 WHEN 'medium' THEN 3
          WHEN 'low' THEN 1 ELSE 0 END) AS BIGINT) AS weight FROM failures GROUP BY 1),
ru AS (SELECT runs.*, 'op' || substr(mode, 1, 1) AS username, n, weight FROM runs LEFT JOIN pr USING (run_id) WHERE scenario_id > 0),
us0 AS (
  SELECT scenario_id, count(*) AS total_runs, count(*) FILTER (status = 'success') AS success_runs,
    count(*) FILTER (status = 'failed') AS failed_runs, count(*) FILTER (status = 'cancelled') AS cancelled_runs,
    count(*) FILTER (status IN ('queued', 'running', 'paused')) AS active_runs,
    count(*) FILTER (coalesce(n, 0) > 0 OR status IN ('failed', 'cancelled')) AS runs_with_failures,
    CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_failure_events, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS weight,
    max(created_at_ms) AS last_used_at_ms, arg_max(run_id, (created_at_ms, -run_id)) AS last_run_id
  FROM ru GROUP BY 1),
us1 AS (SELECT *, round_even(runs_with_failures / total_runs * 100.0, 1) AS failure_rate_pct FROM us0),
tu AS (SELECT scenario_id, string_agg(username || ':' || c, ',' ORDER BY rn) AS top_users FROM (
    SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY c DESC, username) AS rn FROM (
      SELECT scenario_id, username, count(*) AS c FROM ru GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1),
usage AS (SELECT us1.* EXCLUDE (weight), least(100.0, round_even(CAST(least(total_runs * 4, 30) AS DOUBLE)
    + least(failure_rate_pct * CAST(0.55 AS DOUBLE), 55.0) + least(weight, 25) + least(active_runs * 4, 10), 1)) AS criticality_score, top_users
  FROM us1 LEFT JOIN tu USING (scenario_id))"""


def _usage(spark, sf):
    runs = t.runs(spark, sf).withColumn("username", F.concat(F.lit("op"), F.substring("mode", 1, 1)))
    return reports.scenario_usage(runs, t.failures(spark, sf))


@query("agg08_scenario_usage", t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _USAGE) + "SELECT * FROM usage")
def scenario_usage(spark, sf):
    return _usage(spark, sf)


_SLA = """
scen AS (SELECT c_custkey AS scenario_id, c_name AS name, c_mktsegment AS squad, c_nationkey AS created_by,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST((c_custkey % 5 + 2) * 13 AS DOUBLE) END AS sla_max_failure_rate_pct,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(40 + c_custkey % 50 AS DOUBLE) END AS sla_max_criticality_score,
    CASE WHEN c_acctbal > 5000 THEN 'shared' ELSE 'private' END AS visibility FROM customer),
sla0 AS (SELECT scen.*, coalesce(total_runs, 0) AS total_runs, coalesce(failure_rate_pct, 0) AS f, coalesce(criticality_score, 0) AS c
   FROM scen LEFT JOIN usage USING (scenario_id)),
sla AS (SELECT *, CASE WHEN coalesce(f > sla_max_failure_rate_pct, FALSE) OR coalesce(c > sla_max_criticality_score, FALSE) THEN 'breached'
   WHEN coalesce(sla_max_failure_rate_pct > 0 AND f >= sla_max_failure_rate_pct * CAST(0.8 AS DOUBLE), FALSE)
     OR coalesce(sla_max_criticality_score > 0 AND c >= sla_max_criticality_score * CAST(0.8 AS DOUBLE), FALSE) THEN 'warning' ELSE 'ok' END AS sla_status
   FROM sla0),
fav AS (SELECT DISTINCT l_suppkey * 7 % (SELECT count(*) FROM customer) AS scenario_id, l_partkey % 25 AS user_id FROM lineitem)"""


def _scenarios(spark, sf):
    key = F.col("c_custkey")
    return t.read(spark, sf, "customer").select(
        key.alias("scenario_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("squad"),
        F.col("c_nationkey").cast("long").alias("created_by"),
        F.when(key % 7 != 0, ((key % 5 + 2) * 13).cast("double")).alias("sla_max_failure_rate_pct"),
        F.when(key % 3 != 0, (40 + key % 50).cast("double")).alias("sla_max_criticality_score"),
        F.when(F.col("c_acctbal") > 5000, "shared").otherwise("private").alias("visibility"),
        (key * 1000).alias("updated_at_ms"),
    )


def _favourites(spark, sf):
    customers = t.read(spark, sf, "customer").agg(F.count(F.lit(1)))
    return t.read(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 7 % customers.scalar()).alias("scenario_id"), (F.col("l_partkey") % 25).alias("user_id")
    )


def _users(spark, sf):
    return t.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_name").alias("username"))


@query(
    "fn21_sla_status",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _USAGE, _SLA) + "SELECT scenario_id, sla_status FROM sla",
)
def sla_status(spark, sf):
    zero = {"failure_rate_pct": 0.0, "criticality_score": 0.0}
    joined = _scenarios(spark, sf).join(_usage(spark, sf), "scenario_id", "left").fillna(zero)
    return reports.sla_status(joined).select("scenario_id", "sla_status")


@query(
    "jn02_scenario_listing",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _USAGE, _SLA)
    + """SELECT scenario_id, name, n_name AS created_by_username, visibility,
           scenario_id IN (SELECT scenario_id FROM fav WHERE user_id = 3) AS is_favorite
         FROM scen LEFT JOIN nation ON n_nationkey = created_by WHERE visibility = 'shared' OR created_by = 3""",
)
def scenario_listing(spark, sf):
    seen = reports.visible_scenarios(_scenarios(spark, sf), _users(spark, sf), _favourites(spark, sf), 3)
    return seen.select("scenario_id", "name", "created_by_username", "visibility", "is_favorite")


@query(
    "jn03_operational_scenarios",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _USAGE, _SLA)
    + """SELECT scenario_id, name, squad, total_runs, f AS failure_rate_pct, c AS criticality_score, sla_status,
           scenario_id IN (SELECT scenario_id FROM fav WHERE user_id = 3) AS is_favorite
         FROM sla WHERE sla_status <> 'ok' AND contains(lower(squad), 'm') AND total_runs > 0 AND sla_status = 'breached'""",
)
def operational_scenarios(spark, sf):
    every = reports.visible_scenarios(
        _scenarios(spark, sf).withColumn("visibility", F.lit("shared")), _users(spark, sf), _favourites(spark, sf), 3
    )
    found = reports.operational_scenarios(
        every, _usage(spark, sf), sort_by="criticality", sla="breached", used_only=True, squad="M"
    )
    return found.select(
        "scenario_id", "name", "squad", "total_runs", "failure_rate_pct", "criticality_score", "sla_status", "is_favorite"
    )


@query(
    "jn01_run_target",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN 'host' || (o_orderkey % 10) ELSE n_name END AS target_host,
         CASE WHEN o_orderkey % 6 = 0 THEN 'root' ELSE lower(r_name) END AS target_user, 'run ' || r_name AS target_command,
         CASE WHEN r_regionkey IS NOT NULL THEN CASE r_regionkey % 2 WHEN 0 THEN 'ssh' ELSE 'telnet' END ELSE 'ssh' END AS transport,
         CASE WHEN r_regionkey % 2 = 1 THEN 23 WHEN o_orderkey % 9 = 0 THEN 2200 ELSE 22 + c_nationkey END AS target_port,
         CASE WHEN o_orderkey % 2 = 0 THEN 'mode=' || coalesce(r_name, 'fast') || ',retry=1' ELSE 'mode=' || r_name END AS options
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN region ON r_regionkey = CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1""",
)
def run_target(spark, sf):
    o = t.read(spark, sf, "orders").join(
        t.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left"
    )
    key = F.col("o_orderkey")
    requests = o.select(
        key.alias("run_id"),
        F.col("c_nationkey").alias("target_env_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("connection_profile_id"),
        F.when(key % 4 == 0, F.concat(F.lit("host"), (key % 10).cast("string"))).otherwise("").alias("target_host"),
        F.when(key % 6 == 0, "root").alias("target_user"),
        F.lit(None).cast("string").alias("target_command"),
        F.when(key % 9 == 0, 2200).alias("requested_port"),
        F.when(key % 2 == 0, F.create_map(F.lit("mode"), F.lit("fast"), F.lit("retry"), F.lit("1"))).alias("connection_options"),
    )
    environments = t.read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("target_env_id"),
        F.col("n_name").alias("env_host"),
        (22 + F.col("n_nationkey")).alias("env_port"),
        F.lit("ssh").alias("transport_hint"),
    )
    odd = F.col("r_regionkey") % 2 == 1
    profiles = t.read(spark, sf, "region").select(
        F.col("r_regionkey").alias("connection_profile_id"),
        F.lower("r_name").alias("username"),
        F.concat(F.lit("run "), "r_name").alias("command"),
        F.when(odd, "telnet").otherwise("ssh").alias("profile_transport"),
        F.when(odd, 23).alias("profile_port"),
        F.create_map(F.lit("mode"), F.col("r_name")).alias("options"),
    )
    options = F.transform(
        F.array_sort(F.map_entries("connection_options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return reports.resolve_targets(requests, environments, profiles).select(
        "run_id", "target_host", "target_user", "target_command", "transport", "target_port",
        F.array_join(options, ",").alias("options"),
    )


_WINDOWS = """
win AS (SELECT run_id, 1704067200000 + (run_id * 7919 % 2592000) * 1000 AS from_ms,
   CASE WHEN status = 'running' THEN greatest(1704067200000 + (run_id * 7919 % 2592000) * 1000, (SELECT max(ts_ms) FROM host_metrics))
     ELSE 1704067200000 + (run_id * 7919 % 2592000) * 1000 + (run_id % 500 + 1) * 60000 END AS to_ms FROM runs)"""


def _samples_and_windows(spark, sf):
    samples = t.host_metrics(spark, sf).select("ts_ms", "cpu_pct")
    newest = samples.agg(F.max("ts_ms")).scalar()
    runs = t.runs(spark, sf)
    start = F.lit(1704067200000) + (F.col("run_id") * 7919 % 2592000) * 1000
    windows = hosts.run_windows(
        runs.select(
            "run_id", "created_at_ms", start.alias("started_at_ms"),
            F.when(F.col("status") != "running", start + (F.col("run_id") % 500 + 1) * 60000).alias("finished_at_ms"),
        ),
        newest,
    )
    return samples, windows


@query(
    "jn08_host_samples_per_run",
    t.with_tables(t.RUNS_SQL, t.HOST_SQL, _WINDOWS)
    + """SELECT run_id, from_ms, to_ms, count(ts_ms) AS samples, avg(cpu_pct) AS cpu_pct_avg, max(cpu_pct) AS cpu_pct_max
         FROM win LEFT JOIN host_metrics ON ts_ms BETWEEN from_ms AND to_ms GROUP BY 1, 2, 3""",
)
def host_samples_per_run(spark, sf):
    samples, windows = _samples_and_windows(spark, sf)
    return hosts.window_statistics(samples, windows, ["cpu_pct"])


@query(
    "src10_host_window_export",
    t.with_tables(t.RUNS_SQL, t.HOST_SQL, _WINDOWS)
    + """SELECT run_id, status, from_ms, to_ms, ts_ms, cpu_pct FROM win JOIN runs USING (run_id) JOIN host_metrics ON ts_ms BETWEEN from_ms AND to_ms WHERE status <> 'running'""",
)
def host_window_export(spark, sf):
    """The samples of every finished run, exported and read back."""
    samples, windows = _samples_and_windows(spark, sf)
    finished = t.runs(spark, sf).where(F.col("status") != "running").select("run_id", "status")
    windows = windows.join(finished.select("run_id"), "run_id")
    rows = exports.host_window_rows(samples, windows, finished).select("run_id", "status", "from_ms", "to_ms", "ts_ms", "cpu_pct")
    path = _folder(spark, "hosts")
    exports.export(rows, path, "csv", packed=True)
    return exports.exported(spark, path, rows.schema, "csv")


@query(
    "agg09_overview_counters",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL)
    + """SELECT 'runs' AS section, status AS name, count(*) AS value FROM runs GROUP BY 2
         UNION ALL SELECT 'runs', 'total', count(*) FROM runs
         UNION ALL SELECT 'runs', 'open', count(*) FROM runs WHERE status IN ('queued', 'running', 'paused', 'resuming')
         UNION ALL SELECT 'failures', failure_type, count(*) FROM failures GROUP BY 2
         UNION ALL SELECT 'failures', 'total', count(*) FROM failures""",
)
def overview_counters(spark, sf):
    return reports.counters(t.runs(spark, sf), t.failures(spark, sf))


_RESULTS = """
res AS (SELECT l_orderkey AS run_id, l_linenumber AS session_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed'
    WHEN bool_or(l_returnflag = 'A') THEN 'success' ELSE 'skipped' END AS result, CAST(sum(l_quantity) AS BIGINT) AS checkpoints_ok
  FROM lineitem GROUP BY 1, 2)"""
_TYPE_COUNTS = ", ".join(
    f"coalesce(type_{k}, 0) AS type_{k}" for k in reports.FAILURE_TYPES
) + ", " + ", ".join(f"coalesce(severity_{s}, 0) AS severity_{s}" for s in reports.SEVERITIES)


@query(
    "agg16_run_metrics",
    t.with_tables(
        t.FAILURES_SQL, _RESULTS,
        "fm AS (SELECT run_id, count(*) AS failures, "
        + ", ".join(f"count(*) FILTER (failure_type = '{k}') AS type_{k}" for k in reports.FAILURE_TYPES) + ", "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in reports.SEVERITIES)
        + " FROM failures GROUP BY 1)",
        """sm AS (SELECT run_id, count(*) AS sessions_total, count(*) FILTER (result = 'success') AS sessions_success,
             count(*) FILTER (result = 'failed') AS sessions_failed, count(*) FILTER (result = 'skipped') AS sessions_skipped,
             CAST(sum(checkpoints_ok) AS BIGINT) AS checkpoints_ok FROM res GROUP BY 1)""",
    )
    + f"""SELECT run_id, sessions_total, sessions_success, sessions_failed, sessions_skipped, checkpoints_ok,
          coalesce(failures, 0) AS failures, {_TYPE_COUNTS},
          CASE WHEN sessions_failed > 0 THEN 'failed' ELSE 'success' END AS final_status FROM sm LEFT JOIN fm USING (run_id)""",
)
def run_metrics(spark, sf):
    flag = F.col("l_returnflag")
    results = (
        t.read(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("session_id"))
        .agg(
            F.when(F.bool_or(flag == "R"), "failed").when(F.bool_or(flag == "A"), "success").otherwise("skipped").alias("result"),
            F.sum("l_quantity").cast("long").alias("checkpoints_ok"),
        )
    )
    return reports.run_metrics(results, t.failures(spark, sf))


@query(
    "prj07_capture_listing",
    t.with_tables(t.RUNS_SQL)
    + """, m AS (SELECT * FROM runs WHERE contains(environment, 'NATION_1') AND status = 'success'),
         p AS (SELECT run_id AS id, created_at_ms AS started_at_ms FROM m ORDER BY started_at_ms DESC, id DESC LIMIT 50 OFFSET 10)
         SELECT id, started_at_ms, (SELECT count(*) FROM m) AS total FROM p""",
)
def capture_listing(spark, sf):
    captures = t.runs(spark, sf).select(
        F.col("run_id").alias("id"), F.col("environment").alias("session_uuid"), F.lit("op").alias("created_by_username"),
        F.col("created_at_ms").alias("started_at_ms"), "status",
    )
    total, page = reports.capture_page(captures, search="NATION_1", status="success", limit=50, offset=10)
    return page.select("id", "started_at_ms", total.scalar().alias("total"))


@query(
    "prj08_capped_listing",
    t.with_tables(t.RUNS_SQL)
    + "SELECT * FROM (SELECT run_id, status, environment FROM runs ORDER BY run_id DESC LIMIT 2000) WHERE status = 'failed'",
)
def capped_listing(spark, sf):
    runs = t.runs(spark, sf).select("run_id", "status", "environment")
    return reports.listing(runs, "run_id", 2000, F.col("status") == "failed")


@query(
    "prj09_run_environment",
    """SELECT o_orderkey AS run_id, CASE o_orderkey % 6 WHEN 0 THEN 'prod' WHEN 1 THEN o_orderpriority WHEN 2 THEN 'T' || o_custkey
         WHEN 3 THEN 'E' || o_custkey ELSE 'h' || o_custkey END AS environment FROM orders""",
)
def run_environment(spark, sf):
    key, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    none = F.lit(None).cast("string")
    params = F.to_json(
        F.struct(
            F.when(key % 6 == 0, " prod ").when(key % 6 == 1, " ").otherwise(none).alias("environment"),
            F.when(key % 6 == 1, F.col("o_orderpriority")).alias("env"),
            F.when(key % 6 == 2, F.concat(F.lit("T"), who)).alias("target_env"),
            F.when(key % 6 == 3, F.concat(F.lit("E"), who)).alias("target_environment"),
        )
    )
    raw = F.when(key % 6 == 4, F.lit("{broken")).otherwise(params)
    host = F.concat(F.lit(" h"), who)
    return t.read(spark, sf, "orders").select(key.alias("run_id"), reports.run_environment(raw, host).alias("environment"))


@query(
    "prj10_tag_lists",
    r"""SELECT doc_id, array_to_string(list_slice(list_transform(list_sort(list_transform(
          list_distinct(parts), lambda p: lpad(CAST(list_position(parts, p) AS VARCHAR), 9, '0') || p)), lambda s: substr(s, 10)), 1, 12), '|') AS tags
        FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, ' ', ', '), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)""",
)
def tag_lists(spark, sf):
    docs = t.read(spark, sf, "documents")
    return docs.select(
        "doc_id", F.array_join(reports.normalize_tags(F.replace("text", F.lit(" "), F.lit(", "))), "|").alias("tags")
    )


@query(
    "prj12_failure_records",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'timeout' ELSE 'technical_error' END AS failure_type,
         CASE WHEN l_linenumber = 1 THEN 'low' WHEN l_linenumber = 2 THEN 'critical' ELSE 'high' END AS severity,
         CASE WHEN l_linestatus = 'F' THEN 'flow' ELSE '' END AS flow_name, CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE 0 END AS seq_global
       FROM lineitem""",
)
def failure_records(spark, sf):
    raw = t.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.expr("CASE l_returnflag WHEN 'R' THEN ' timeout' WHEN 'A' THEN 'weird' END").alias("failure_type"),
        F.expr("CASE l_linenumber WHEN 1 THEN 'low' WHEN 2 THEN 'critical' WHEN 3 THEN 'worst' END").alias("severity"),
        F.when(F.col("l_linestatus") == "F", "flow").alias("flow_name"),
        F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("seq_global"),
    )
    return reports.normalize_failures(raw)


@query(
    "srt01_ranked_failures",
    t.with_tables(t.FAILURES_SQL)
    + """SELECT * FROM (SELECT severity, failure_type, count(*) AS failures, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3
           WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank FROM failures GROUP BY 1, 2)
         ORDER BY severity_rank DESC, failures DESC, failure_type LIMIT 8""",
)
def ranked_failures(spark, sf):
    counted = t.failures(spark, sf).groupBy("severity", "failure_type").agg(F.count(F.lit(1)).alias("failures"))
    return (
        counted.withColumn("severity_rank", reports.severity_rank(F.col("severity")))
        .orderBy(F.desc("severity_rank"), F.desc("failures"), "failure_type")
        .limit(8)
    )


@query(
    "src10_report_long_form",
    t.with_tables(t.RUNS_SQL, t.FAILURES_SQL)
    + """, w AS (SELECT count(*) AS failures, count(DISTINCT run_id) AS runs, count(DISTINCT flow_name) AS flows FROM failures)
       SELECT 'summary' AS section, unnest(['failures', 'runs', 'flows']) AS name,
         unnest([CAST(failures AS VARCHAR), CAST(runs AS VARCHAR), CAST(flows AS VARCHAR)]) AS value FROM w""",
)
def report_long_form(spark, sf):
    wide = t.failures(spark, sf).agg(
        F.count(F.lit(1)).alias("failures"), F.count_distinct("run_id").alias("runs"),
        F.count_distinct("flow_name").alias("flows"),
    )
    return store.long_form("summary", wide)


#: Each run as report rows: what it is, counts by severity, and failures by flow.
_REPORT = """
rep AS (SELECT run_id, 'run' AS section, 'id' AS name, CAST(run_id AS VARCHAR) AS value FROM runs UNION ALL SELECT run_id, 'run', 'environment', coalesce(environment, '') FROM runs
  UNION ALL SELECT run_id, 'summary', 'severity.' || severity, CAST(count(*) AS VARCHAR) FROM failures GROUP BY run_id, severity
  UNION ALL SELECT run_id, 'flow', coalesce(flow_name, 'sem_fluxo'), CAST(count(*) AS VARCHAR) FROM failures GROUP BY run_id, flow_name)"""


def _report_rows(spark, sf):
    runs = t.runs(spark, sf).select("run_id", F.coalesce("environment", F.lit("")).alias("environment"))
    return reports.report_rows(runs, t.failures(spark, sf))


def _folder(spark, name):
    import os
    import uuid

    from tracewell.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


@query("src10_report_csv", t.with_tables(t.RUNS_SQL, t.FAILURES_SQL, _REPORT) + "SELECT * FROM rep")
def report_csv(spark, sf):
    """The report of every run written as CSV and read back."""
    rows, path = _report_rows(spark, sf), _folder(spark, "report")
    exports.export(rows, path, "csv")
    return exports.exported(spark, path, rows.schema, "csv")


@query("src10_documents_json_lines", "SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def documents_json_lines(spark, sf):
    """Whole texts, line ends and nulls included, written as JSON lines and read back."""
    rows, path = t.read(spark, sf, "documents"), _folder(spark, "documents")
    exports.export(rows, path, "jsonl")
    return exports.exported(spark, path, rows.schema, "jsonl").withColumn("n_chars", F.col("n_chars").cast("long"))


_PATHS = r"""
paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || CASE page_id % 4 WHEN 0 THEN '.prg' WHEN 1 THEN '.DBF'
    WHEN 2 THEN '' ELSE '.tar.gz' END AS path FROM pages)"""


@query(
    "src11_file_inventory",
    t.with_tables(_PATHS)
    + r"""SELECT CASE WHEN regexp_extract(path, '^/?([^/]+)/', 1) = '' THEN '(root)' ELSE regexp_extract(path, '^/?([^/]+)/', 1) END AS module,
          CASE WHEN regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\.([A-Za-z0-9]+)$', 1) = '' THEN '(none)'
            ELSE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\.([A-Za-z0-9]+)$', 1)) END AS extension, count(*) AS files
        FROM paths GROUP BY 1, 2""",
)
def file_inventory(spark, sf):
    path = F.concat(
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1),
        F.expr("CASE page_id % 4 WHEN 0 THEN '.prg' WHEN 1 THEN '.DBF' WHEN 2 THEN '' ELSE '.tar.gz' END"),
    )
    return store.file_inventory(t.read(spark, sf, "pages").select(path.alias("path")))


@query("src12_evidence_manifest", "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents")
def evidence_manifest(spark, sf):
    docs = t.read(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return store.evidence_manifest(docs.select(path.alias("path"), F.col("text").alias("content")))


@query(
    "src06_operational_tables",
    """SELECT s_suppkey AS id, s_name AS name, n_name AS environment, s_acctbal AS balance FROM supplier
       LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def operational_tables(spark, sf):
    from tracewell.schemas import struct

    suppliers = store.scan_table(
        spark, f"{sf}/supplier.parquet", struct("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    )
    nations = store.scan_table(spark, f"{sf}/nation.parquet", struct("n_nationkey int, n_name string"))
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("environment"),
        F.col("s_acctbal").alias("balance"),
    )
