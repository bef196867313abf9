"""Benchmark statistics: latencies, ladders, degradation, normalisation, decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import ordered
from tracewell.plans.quantiles import exact_percentiles

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}

# Half-width of the confidence interval accepted relative to the mean.
CI_MAX_REL_WIDTH = 0.10


@dataclass(frozen=True)
class DegradationLimits:
    throughput_growth_min_pct: float = 10.0
    concurrency_growth_pct: float = 50.0
    p95_growth_max_pct: float = 50.0
    error_rate_max_pct: float = 5.0


def latency_statistics(samples: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """n, mean, exact percentiles, maximum, population deviation, cv and normal 95 % interval."""
    moments = {
        "n": F.count(value),
        "mean": F.avg(value),
        "max": F.max(value),
        "stdev": F.stddev_pop(value),
    }
    joined = exact_percentiles(samples, keys, value, PERCENTILES, moments)
    margin = F.col("stdev") * 1.96 / F.sqrt("n")
    return joined.select(
        "*",
        F.when(F.col("mean") != 0, F.col("stdev") / F.col("mean")).otherwise(0.0).alias("cv"),
        (F.col("mean") - margin).alias("ci95_low"),
        (F.col("mean") + margin).alias("ci95_high"),
    )


def outcome_counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Successes, timeouts, errors and divergences; success is looked at before timeout."""
    ok, late = F.col("success"), F.col("timeout")
    return samples.groupBy(*keys).agg(
        F.count_if(ok).alias("successes"),
        F.count_if(~ok & late).alias("timeouts"),
        F.count_if(~ok & ~late).alias("errors"),
        F.count_if("functional_divergence").alias("divergences"),
    )


def grouped_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    return latency_statistics(samples, keys).join(outcome_counts(samples, keys), keys)


def throughput(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples per second over the real window and functional counts, completed runs only."""
    done = samples.where(F.col("run_status") == "COMPLETED")
    seconds = (F.col("last_ns") - F.col("first_ns")) / 1e9
    return (
        done.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.min("started_ns").alias("first_ns"),
            F.max("finished_ns").alias("last_ns"),
            F.count_if("success").alias("success"),
            F.count_if("timeout").alias("timeouts"),
            F.count_if("functional_divergence").alias("divergences"),
            F.count_if(~F.col("success") & ~F.col("timeout")).alias("errors"),
        )
        .withColumn("tps", F.when(seconds > 0, F.col("total") / seconds).otherwise(0.0))
        .drop("first_ns", "last_ns")
    )


def load_ladder(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Throughput, p95, p99 and error share per concurrency level, completed runs only."""
    by = [*keys, "concurrency"]
    done = samples.where(F.col("run_status") == "COMPLETED")
    seconds = F.greatest(F.lit(1e-9), (F.col("last_ns") - F.col("first_ns")) / 1e9)
    facts = {
        "total": F.count(F.lit(1)),
        "bad": F.count_if(~F.col("success") | F.col("timeout")),
        "first_ns": F.min("started_ns"),
        "last_ns": F.max("finished_ns"),
    }
    levels = exact_percentiles(done, by, "latency_ms", {"p95_ms": 0.95, "p99_ms": 0.99}, facts)
    return levels.select(
        *by,
        (F.col("total") / seconds).alias("tps"),
        "p95_ms",
        "p99_ms",
        (F.col("bad") / F.col("total") * 100.0).alias("error_pct"),
    )


def capacity(ladder: DataFrame, keys: list[str]) -> DataFrame:
    return ladder.groupBy(*keys).agg(
        F.max("tps").alias("max_tps_observed"), F.max("concurrency").alias("max_concurrency_tested")
    )


def degradation(ladder: DataFrame, keys: list[str], limits: DegradationLimits = DegradationLimits()) -> DataFrame:
    """First level degraded against the level before it, last safe level, highest level."""
    walked = ordered.scan(
        ladder, keys, ["concurrency"],
        p_level=ordered.lag(F.col("concurrency")), p_tps=ordered.lag(F.col("tps")), p_p95=ordered.lag(F.col("p95_ms")),
    )

    def growth(now: str, before: str) -> Column:
        return (F.col(now) - F.col(before)) / F.col(before) * 100.0

    flat = (
        (F.col("p_tps") > 0)
        & (growth("concurrency", "p_level") >= limits.concurrency_growth_pct)
        & (growth("tps", "p_tps") < limits.throughput_growth_min_pct)
    )
    slow = (F.col("p_p95") > 0) & (growth("p95_ms", "p_p95") > limits.p95_growth_max_pct)
    failing = F.col("error_pct") > limits.error_rate_max_pct
    bad = F.col("p_level").isNotNull() & F.coalesce(flat | slow | failing, F.lit(False))
    marked = walked.withColumn("bad", bad)
    points = marked.groupBy(*keys).agg(
        F.min(F.when(F.col("bad"), F.col("concurrency"))).alias("degradation_point"),
        F.max("concurrency").alias("maximum_observed_limit"),
    )
    safe = (
        ladder.select(*keys, "concurrency")
        .join(points, keys)
        .where(F.col("degradation_point").isNull() | (F.col("concurrency") < F.col("degradation_point")))
        .groupBy(*keys)
        .agg(F.max("concurrency").alias("safe_operational_limit"))
    )
    return points.join(safe, keys, "left")


def stop_conditions(
    levels: DataFrame, error_rate_pct: float, p99_limit_ms: float, swap_growth_mb: float, host_cpu_pct: float
) -> DataFrame:
    """First stop rule each level meets.

    ``levels`` has error_pct, p99_ms, swap_growth (maximum) and cpu_sustained (peak of a
    sustained stretch, null when there was none).
    """
    rules = (
        ("error_rate_pct", F.col("error_pct"), error_rate_pct),
        ("p99_limit_ms", F.col("p99_ms"), p99_limit_ms),
        ("swap_growth_mb", F.col("swap_growth"), swap_growth_mb),
        ("host_cpu_pct", F.col("cpu_sustained"), host_cpu_pct),
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for label, measured, limit in reversed(rules):
        hit = F.coalesce(measured > limit, F.lit(False))
        name, value = F.when(hit, label).otherwise(name), F.when(hit, measured).otherwise(value)
    return levels.withColumn("stop_condition", name).withColumn("stop_value", value)


def downgrade_transients(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Take back divergences that the following steps disprove.

    First signature divergences whose next step was checked and matched (typing ahead),
    then text divergences whose next checked step matched (late screen).
    """
    diverged = F.coalesce("functional_divergence", F.lit(False))
    hot = ordered.hot_keys(samples, keys, order)
    ahead = ordered.scan(
        samples, keys, order, hot,
        __next_ok=ordered.lead(F.col("screen_sig_checked") & ~diverged),
    )
    skew = diverged & (F.col("screen_check_kind") == "sig") & F.coalesce("__next_ok", F.lit(False))
    first = ahead.withColumn("segmentation_skew", skew).withColumn("functional_divergence", diverged & ~skew)
    later = ordered.scan(
        first.drop("__next_ok"), keys, order, hot,
        __next_checked=ordered.next_known(F.when(F.col("screen_sig_checked"), F.col("functional_divergence"))),
    )
    lag = (
        F.col("functional_divergence")
        & (F.col("screen_check_kind") == "text")
        & F.coalesce(~F.col("__next_checked"), F.lit(False))
    )
    return (
        later.withColumn("checkpoint_lag", lag)
        .withColumn("functional_divergence", F.col("functional_divergence") & ~lag)
        .drop("__next_checked")
    )


def schedule_regressions(runs: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """Success rate of each scheduled run against the one before, with new and gone error types.

    ``error_types`` is an array of the types of the run; ``threshold`` may override the limit.
    """
    rate = F.coalesce("completed", F.lit(0)) / F.greatest(F.coalesce("total_sessions", F.lit(1)), F.lit(1)) * 100
    walked = ordered.scan(
        runs.withColumn("rate", rate), ["schedule_id"], ["run_id"],
        previous_run_id=ordered.lag(F.col("run_id")),
        p_rate=ordered.lag(F.col("rate")),
        p_types=ordered.lag(F.col("error_types")),
    ).where(F.col("previous_run_id").isNotNull())
    delta = F.col("p_rate") - F.col("rate")
    return walked.select(
        "schedule_id", "run_id", "previous_run_id",
        F.bround("rate", 1).alias("success_rate_current"),
        F.bround("p_rate", 1).alias("success_rate_previous"),
        F.bround(delta, 1).alias("delta_pct"),
        (delta > threshold_pct).alias("is_regression"),
        F.array_join(F.array_sort(F.array_except("error_types", "p_types")), ",").alias("new_error_types"),
        F.array_join(F.array_sort(F.array_except("p_types", "error_types")), ",").alias("resolved_error_types"),
    )


def replay_steps(events: DataFrame, quiet_ms: int = 300, reach: int = 8) -> DataFrame:
    """Benchmark steps of a capture: quiet points with expected screen and neighbour window.

    A step is a quiet point when the last output before the input is at least
    ``quiet_ms`` old; ``lag_window`` lists the inputs up to ``reach`` before and after.
    """
    out_ts = F.when((F.col("type") == "bytes") & (F.col("dir") == "out"), F.col("ts_ms"))
    hot = ordered.hot_keys(events, ["session_id"], "seq_global")
    timed = ordered.scan(
        events, ["session_id"], ["seq_global"], hot, last_out=ordered.running_max(out_ts, include_current=False)
    ).where(F.col("type") == "deterministic_input")
    placed = ordered.scan(
        timed, ["session_id"], ["seq_global"], hot, position=ordered.row_number(), next_sig=ordered.lead(F.col("sig"))
    )
    near = ordered.neighbours(
        placed, ["session_id"], "position", reach, reach, window=F.collect_list("seq_global")
    )
    gap = F.coalesce(F.col("ts_ms") - F.col("last_out"), F.lit(0))
    others = F.filter("window", lambda s: s != F.col("seq_global"))
    return near.select(
        "session_id", "seq_global", "position", gap.alias("gap_ms"), (gap >= quiet_ms).alias("quiet_point"),
        F.when(gap >= quiet_ms, F.col("sig")).alias("expected_screen"),
        F.coalesce("next_sig", F.lit("")).alias("expected_next_sig"),
        F.array_join(F.transform(others, lambda s: s.cast("string")), ",").alias("lag_window"),
    )


def checkpoint_verdicts(steps: DataFrame) -> DataFrame:
    """Match, late screen or divergence per text checkpoint.

    Expects observed, expected, env_expected (own baseline, may be null) and the
    neighbour texts lag_window / env_lag_window as arrays, all normalised.
    """
    own = F.col("env_expected").isNotNull() & (F.col("env_expected") != "")
    expected = F.when(own, F.col("env_expected")).otherwise(F.col("expected"))
    window = F.when(own, F.coalesce("env_lag_window", "lag_window")).otherwise(F.col("lag_window"))
    checked = expected.isNotNull() & (expected != "")
    same = F.col("observed") == expected
    late = F.coalesce(F.array_contains(window, F.col("observed")), F.lit(False))
    return steps.select(
        *[c for c in steps.columns if c not in ("lag_window", "env_lag_window", "observed", "expected", "env_expected")],
        F.when(own, "env").otherwise("shared").alias("screen_check_basis"),
        F.when(~checked, "unchecked").when(same, "match").when(late, "lag").otherwise("divergence").alias("verdict"),
    )


def apply_env_baselines(steps: DataFrame, baselines: DataFrame) -> DataFrame:
    """Own screen text of each environment per checkpoint; null where the baseline has none.

    ``steps``: journey_id, step_id, expected_text. ``baselines``: environment_id, journey_id, step_id, text.
    """
    environments = baselines.select("environment_id", "journey_id").distinct()
    return (
        steps.where(F.coalesce("expected_text", F.lit("")) != "")
        .join(environments, "journey_id")
        .join(baselines.where(F.col("text") != ""), ["environment_id", "journey_id", "step_id"], "left")
    )


def baseline_coverage(merged: DataFrame) -> DataFrame:
    """Screens applied and missing per environment and journey."""
    return merged.groupBy("environment_id", "journey_id").agg(
        F.count("text").alias("screens"), F.count_if(F.col("text").isNull()).alias("missing")
    )


def normalize_throughput(results: DataFrame) -> DataFrame:
    """Throughput per unit of capacity; a missing or zero unit gives null and INCONCLUSIVE.

    Expects tps, platform, virtual_processors, physical_processors, entitled_capacity,
    memory_mb, cpu_consumed, cost_per_hour and has_model.
    """

    def per(column: Column) -> Column:
        return F.when(column != 0, F.col("tps") / column)

    aix = F.upper("platform") == "AIX"
    vcpu, core = per(F.col("virtual_processors")), per(F.col("physical_processors"))
    entitled = F.when(aix, per(F.col("entitled_capacity")))
    memory = per(F.col("memory_mb") / 1024.0)
    missing = F.concat_ws(
        ",",
        F.when(~F.col("has_model"), "environment_model"),
        F.when(F.col("has_model") & vcpu.isNull(), "virtual_processors"),
        F.when(F.col("has_model") & core.isNull(), "physical_processors"),
        F.when(F.col("has_model") & aix & entitled.isNull(), "entitled_capacity"),
        F.when(F.col("has_model") & memory.isNull(), "memory_mb"),
    )
    cost = F.when((F.col("tps") > 0) & (F.col("cost_per_hour") > 0), F.col("cost_per_hour") / (F.col("tps") * 3.6))
    return results.select(
        "*",
        vcpu.alias("tps_per_vcpu"),
        core.alias("tps_per_physical_core"),
        entitled.alias("tps_per_entitled_capacity"),
        per(F.col("cpu_consumed")).alias("tps_per_cpu_consumed"),
        memory.alias("tps_per_gb"),
        cost.alias("cost_per_1k_transactions"),
        missing.alias("missing_fields"),
        F.when(missing == "", "OK").otherwise("NORMALIZATION_INCONCLUSIVE").alias("normalization_status"),
    )


def decide(facts: DataFrame) -> DataFrame:
    """Verdict per experiment: functional gate first, then completeness, then performance.

    Expects functional_diffs, extra_errors, extra_timeouts, samples_complete,
    collectors_ok, target_samples, target_checked, ci_ok, normalization_ok,
    degradation_point, own_baseline and stop_condition.
    """
    broken = (F.col("functional_diffs") > 0) | (F.col("extra_errors") > 0) | (F.col("extra_timeouts") > 0)
    no_evidence = (F.col("target_samples") > 0) & (F.col("target_checked") == 0)
    warnings = F.concat_ws(
        "; ",
        F.when(~F.col("ci_ok"), "ci95"),
        F.when(~F.col("normalization_ok"), "normalization"),
        F.when(F.col("degradation_point").isNotNull(), F.concat(F.lit("degradation:"), F.col("degradation_point").cast("string"))),
        F.when(F.col("own_baseline"), "per_env"),
        F.when(F.col("stop_condition") != "", F.concat(F.lit("stop_condition:"), "stop_condition")),
    )
    verdict = (
        F.when(broken, "FAIL")
        .when(~F.col("samples_complete") | ~F.col("collectors_ok") | no_evidence, "INCONCLUSIVE")
        .when(warnings != "", "WARN")
        .otherwise("PASS")
    )
    reasons = (
        F.when(
            broken,
            F.concat_ws(
                "; ",
                F.when(F.col("functional_diffs") > 0, F.concat(F.col("functional_diffs").cast("string"), F.lit(" divergences"))),
                F.when(F.col("extra_errors") > 0, F.concat(F.col("extra_errors").cast("string"), F.lit(" extra errors"))),
                F.when(F.col("extra_timeouts") > 0, F.concat(F.col("extra_timeouts").cast("string"), F.lit(" extra timeouts"))),
            ),
        )
        .when(~F.col("samples_complete"), "samples")
        .when(~F.col("collectors_ok"), "collectors")
        .when(no_evidence, "functional_evidence_missing")
        .otherwise(warnings)
    )
    return facts.select("experiment_id", verdict.alias("verdict"), reasons.alias("reasons"))


def decision_facts(samples: DataFrame, hosts: DataFrame, stops: DataFrame, baseline: str, target: str) -> DataFrame:
    """Gate inputs per experiment from raw samples, host samples and stop reasons.

    ``samples`` has experiment_id plus the sample columns, screen_sig_checked,
    screen_check_basis and run_status; ``hosts`` has experiment_id, environment_id, available.
    """
    exp = ["experiment_id"]
    done = F.col("run_status") == "COMPLETED"
    at_target, at_base = F.col("environment_id") == target, F.col("environment_id") == baseline

    def extra(flag: Column) -> Column:
        return F.count_if(done & at_target & flag) - F.count_if(done & at_base & flag)

    error = ~F.col("success") & ~F.col("timeout")
    counts = samples.groupBy(*exp).agg(
        F.count_if(done & at_target & F.col("functional_divergence")).alias("functional_diffs"),
        extra(error).alias("extra_errors"),
        extra(F.col("timeout")).alias("extra_timeouts"),
        F.count_if(done & at_target).alias("target_samples"),
        F.count_if(at_target & F.col("screen_sig_checked")).alias("target_checked"),
        F.bool_or(F.col("screen_check_basis") == "env").alias("own_baseline"),
        (F.count_if(done) > 0).alias("__some"),
        (F.count_if(F.col("run_status") == "FAILED") == 0).alias("__none_failed"),
    )
    # the interval needs moments only, not percentiles
    intervals = (
        samples.where(done)
        .groupBy(*exp, "environment_id")
        .agg(F.avg("latency_ms").alias("m"), F.stddev_pop("latency_ms").alias("s"), F.count(F.lit(1)).alias("n"))
        .groupBy(*exp)
        .agg(F.every((F.col("m") <= 0) | (F.col("s") * 1.96 / F.sqrt("n") <= F.col("m") * CI_MAX_REL_WIDTH)).alias("ci_ok"))
    )
    seen = samples.select("experiment_id", "environment_id").distinct()
    collected = hosts.groupBy("experiment_id", "environment_id").agg(F.count_if("available").alias("valid"))
    collectors = (
        seen.join(collected, ["experiment_id", "environment_id"], "left")
        .groupBy(*exp)
        .agg(F.every(F.coalesce("valid", F.lit(0)) > 0).alias("collectors_ok"))
    )
    ladder = load_ladder(samples, ["experiment_id", "environment_id"])
    points = (
        degradation(ladder, ["experiment_id", "environment_id"])
        .where(at_target)
        .select("experiment_id", "degradation_point")
    )
    return (
        counts.join(intervals, "experiment_id", "left")
        .join(collectors, "experiment_id", "left")
        .join(points, "experiment_id", "left")
        .join(stops, "experiment_id", "left")
        .withColumn("samples_complete", F.col("__some") & F.col("__none_failed"))
        .withColumn("ci_ok", F.coalesce("ci_ok", F.lit(False)))
        .withColumn("stop_condition", F.coalesce("stop_condition", F.lit("")))
        .drop("__some", "__none_failed")
    )


def roll_up_experiments(runs: DataFrame) -> DataFrame:
    """Admission ceiling, reclassified failures and final status of each experiment.

    ``runs``: experiment_id, run_id, iteration, concurrency, status, error_reason, transport_error.
    A level where every run failed to start, without transport error and after some
    completed run, is the admission limit; its failures become ABORTED.
    """
    refused = (
        (F.col("status") == "FAILED")
        & F.coalesce(F.col("error_reason").startswith("start_session_failed"), F.lit(False))
        & ~F.col("transport_error")
    )
    levels = runs.groupBy("experiment_id", "iteration", "concurrency").agg(
        F.every(refused).alias("all_refused"),
        F.max(F.when(F.col("status") == "COMPLETED", 1).otherwise(0)).alias("completed"),
    )
    levels = levels.withColumn("place", F.col("iteration") * 1_000_000_000 + F.col("concurrency"))
    earlier = ordered.scan(
        levels, ["experiment_id"], ["place"],
        before=ordered.running_max(F.col("completed"), include_current=False),
    )
    limit = earlier.where(F.col("all_refused") & (F.col("before") == 1))
    stops = limit.groupBy("experiment_id").agg(
        F.min("concurrency").alias("admission_ceiling"),
        F.min_by(F.struct("iteration", "concurrency"), "place").alias("stop"),
    )
    failed_order = F.struct("iteration", "concurrency", "run_id")
    rows = runs.join(stops, "experiment_id", "left").withColumn(
        "final",
        F.when(
            (F.col("status") == "FAILED")
            & (F.col("iteration") == F.col("stop.iteration"))
            & (F.col("concurrency") == F.col("stop.concurrency")),
            "ABORTED",
        ).otherwise(F.col("status")),
    )
    failed = F.col("final") == "FAILED"
    summary = rows.groupBy("experiment_id").agg(
        F.first("admission_ceiling").alias("admission_ceiling"),
        F.count_if(F.col("final") == "ABORTED").alias("aborted_runs"),
        F.count_if(failed).alias("failed_runs"),
        F.bool_or("transport_error").alias("unreachable"),
        F.min_by(F.col("error_reason"), F.when(failed, failed_order)).alias("first_reason"),
    )
    bad = F.col("unreachable") | (F.col("failed_runs") > 0)
    reason = (
        F.when(F.col("unreachable"), "environment_unreachable_mid_run")
        .when(F.col("failed_runs") > 0, F.coalesce(F.nullif("first_reason", F.lit("")), F.lit("run_failed")))
        .when(F.col("admission_ceiling").isNotNull(), "stop_condition:session_admission_limit")
        .otherwise("")
    )
    return summary.select(
        "experiment_id", "admission_ceiling", "aborted_runs", "failed_runs",
        F.when(bad, "FAILED").otherwise("COMPLETED").alias("status"), reason.alias("reason"),
    )


PARITY_AXES = ("journey_set_sha256", "dataset_sha256", "seed", "concurrency_levels", "measurement_seconds")


def parity_violations(configs: DataFrame) -> DataFrame:
    """Axes in which an environment differs from the first one of its experiment.

    ``configs``: experiment_id, position (0 is the reference), environment_id and the axes as text.
    """
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in PARITY_AXES])
    long = configs.select("experiment_id", "position", "environment_id", F.explode(axes).alias("a")).select(
        "experiment_id", "position", "environment_id", "a.axis", "a.value"
    )
    base = long.where(F.col("position") == 0).select("experiment_id", "axis", F.col("value").alias("expected"))
    return (
        long.where(F.col("position") > 0)
        .join(base, ["experiment_id", "axis"])
        .where(~F.col("value").eqNullSafe(F.col("expected")))
        .drop("position")
    )


def import_samples(lines: DataFrame, imported: DataFrame) -> DataFrame:
    """Samples from per-run artifact files (path, line) whose run is not imported yet.

    Paths look like ``…/<experiment>/runs/<environment>-c<concurrency>-i<iteration>/<file>``.
    """
    from tracewell.schemas import SAMPLE

    shape = r"([^/]+)/runs/([^/]+)-c(\d+)-i(\d+)/[^/]+$"
    keyed = lines.select(
        F.regexp_extract("path", shape, 1).alias("experiment_id"),
        F.regexp_extract("path", shape, 2).alias("environment_id"),
        F.regexp_extract("path", shape, 3).cast("int").alias("concurrency"),
        F.regexp_extract("path", shape, 4).cast("int").alias("iteration"),
        F.from_json("line", SAMPLE).alias("s"),
    ).where(F.col("experiment_id") != "")
    keys = ["experiment_id", "environment_id", "concurrency", "iteration"]
    rest = [c for c in SAMPLE.fieldNames() if c not in keys]
    return keyed.join(imported, keys, "left_anti").select(*keys, *[F.col(f"s.{c}") for c in rest])
