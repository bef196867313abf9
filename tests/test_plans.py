import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import benchmark, graph
from tracewell.plans import ordered
from tracewell.plans.quantiles import exact_percentiles


def _scan(df):
    v = F.col("v")
    return ordered.scan(
        df, ["k"], ["o"], no=ordered.row_number(), total=ordered.running_sum(v), high=ordered.running_max(v, False),
        before=ordered.lag(v), after=ordered.lead(v), known=ordered.last_known(v), coming=ordered.next_known(v),
    )


def _key(row):
    return tuple((x is None, x) for x in row)


def test_split_keys_give_the_same_running_values(spark):
    rng = random.Random(3)
    rows = [("hot", i * 3, rng.choice([None, rng.randint(-9, 9)])) for i in range(200)]
    rows += [(f"k{j}", i, rng.randint(0, 9)) for j in range(6) for i in range(4)] + [(None, 1, 7), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    plain = sorted((tuple(r) for r in _scan(df).select(*_COLUMNS).collect()), key=_key)
    spark.conf.set("spark.tracewell.hotRows", "5")
    try:
        split = sorted((tuple(r) for r in _scan(df).select(*_COLUMNS).collect()), key=_key)
    finally:
        spark.conf.unset("spark.tracewell.hotRows")
    assert split == plain
    assert len(plain) == len(rows)


_COLUMNS = ("k", "o", "no", "total", "high", "before", "after", "known", "coming")


@pytest.mark.parametrize("case", ["outlier", "equal_beginnings", "ties", "nulls", "timestamps"])
def test_ranges_of_a_huge_key_are_even(spark, case):
    at = {
        "outlier": lambda i: (float(i) if i else 1e12, i),
        "equal_beginnings": lambda i: (f"session-{i:06d}", i),
        "ties": lambda i: (7 if i % 10 else i, i),
        "nulls": lambda i: (None if i % 3 else i, i),
        "timestamps": lambda i: (datetime(2024, 10, 27) + timedelta(minutes=i), i),
    }[case]
    kind = {"outlier": "double", "equal_beginnings": "string", "timestamps": "timestamp"}.get(case, "bigint")
    rows = [("hot", *at(i), i) for i in range(1001)] + [("small", at(1)[0], i, i) for i in range(30)]
    df = spark.createDataFrame(rows, f"k string, o {kind}, p bigint, v bigint")
    outputs = {"no": ordered.row_number(), "total": ordered.running_sum(F.col("v")), "before": ordered.lag(F.col("p")), "coming": ordered.next_known(F.col("v"))}
    plain = {tuple(r) for r in ordered.scan(df, ["k"], ["o", "p"], **outputs).collect()}
    spark.conf.set("spark.tracewell.hotRows", "100")
    try:
        cuts = ordered.hot_keys(df, ["k"], ["o", "p"])
        split = {tuple(r) for r in ordered.scan(df, ["k"], ["o", "p"], **outputs).collect()}
    finally:
        spark.conf.unset("spark.tracewell.hotRows")
    assert split == plain and len(split) == len(rows)
    sizes = [r["count"] for r in ordered.with_range(df, ["k"], ["o", "p"], cuts).where("k = 'hot'").groupBy("__range").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 2 * 1001 / len(sizes)


def test_bounds_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LOOKS", 8)
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.concat(F.lit("s"), F.lpad("id", 6, "0")).alias("o"))
    spark.conf.set("spark.tracewell.hotRows", "4000")
    try:
        cuts = ordered.hot_keys(df, ["k"], ["o"])
        out = ordered.scan(df, ["k"], ["o"], no=ordered.row_number())
        assert out.where(F.col("no") != F.substring("o", 2, 6).cast("int") + 1).count() == 0
    finally:
        spark.conf.unset("spark.tracewell.hotRows")
    sizes = [r["count"] for r in ordered.with_range(df, ["k"], ["o"], cuts).groupBy("__range").count().collect()]
    assert sum(sizes) == 40_000 and 25 <= len(sizes) <= 60 and max(sizes) < 4000


def test_neighbours_across_blocks(spark):
    df = spark.range(1, 51).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    out = ordered.neighbours(df, ["k"], "pos", 2, 3, block=8, near=F.collect_list("pos")).collect()
    assert len(out) == 50
    for r in out:
        assert r["near"] == [p for p in range(r["pos"] - 2, r["pos"] + 4) if 1 <= p <= 50]


@pytest.mark.parametrize("limit", ["1000000", "5"])
def test_percentiles_known_answers(spark, limit):
    values = [("hundred", float(i)) for i in range(1, 101)] + [("four", float(i)) for i in (10, 20, 30, 40)]
    values += [("same", 7.0)] * 30
    df = spark.createDataFrame(values, "k string, v double")
    spark.conf.set("spark.tracewell.hotRows", limit)
    try:
        out = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, {"n": F.count("v")}).collect()}
    finally:
        spark.conf.unset("spark.tracewell.hotRows")
    assert [round(out["hundred"][p], 6) for p in ("p50", "p90", "p95", "p99")] == [50.5, 90.1, 95.05, 99.01]
    assert [round(out["four"][p], 6) for p in ("p50", "p90", "p95", "p99")] == [25, 37, 38.5, 39.7]
    assert out["same"]["p99"] == 7.0 and out["same"]["n"] == 30


def test_percentiles_against_numpy(spark, tiny_limit):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(size=n).round(2) for k, n in (("a", 400), ("b", 37), ("c", 1))}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, v double")
    for r in exact_percentiles(df, ["k"], "v", {"p": 0.73}).collect():
        assert r["p"] == pytest.approx(np.percentile(data[r["k"]], 73))


@pytest.mark.parametrize(
    "errors, limits, expected",
    [({}, None, (40, 20, 80)), ({}, (1.0, 200.0), (80, 40, 80)), ({10: 6.0}, None, (10, 5, 20))],
)
def test_ladder_known_answers(spark, errors, limits, expected):
    ladder = [(1, 10, 50), (5, 50, 55), (10, 100, 60), (20, 200, 70)]
    if not errors:
        ladder += [(40, 205, 150), (80, 206, 400)]
    rows = [("e", c, float(t), float(p), errors.get(c, 0.0)) for c, t, p in ladder]
    df = spark.createDataFrame(rows, "env string, concurrency bigint, tps double, p95_ms double, error_pct double")
    chosen = benchmark.DegradationLimits()
    if limits:
        chosen = benchmark.DegradationLimits(throughput_growth_min_pct=limits[0], p95_growth_max_pct=limits[1])
    out = benchmark.degradation(df, ["env"], chosen).first()
    assert (out["degradation_point"], out["safe_operational_limit"], out["maximum_observed_limit"]) == expected


def _brute_components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_with_hub_chain_and_loners(spark):
    nodes = list(range(60))
    edges = [(0, i) for i in range(1, 20)] + [(i, i + 1) for i in range(25, 45)] + [(50, 51), (51, 50), (55, 55)]
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == _brute_components(nodes, edges)


def test_levels_and_roots_with_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzq"], "node string")
    assert {r["node"]: r["level"] for r in graph.dependency_levels(nodes, edges).collect()} == {
        "a": 0, "q": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None,
    }
    forest = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (10, 9)], "id bigint, parent bigint")
    found = {r["id"]: (r["root"], r["depth"]) for r in graph.roots(forest).collect()}
    assert found == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 8: (None, None), 9: (None, None), 10: (None, None)}


def _brute_order(nodes, edges):
    needs = {n: {b for a, b in edges if a == n and a != b and b in nodes} for n in nodes}
    reach = {n: set(needs[n]) for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= set().union(*(reach[m] for m in reach[n])) if reach[n] else set()
    cycle = {n for n in nodes if n in reach[n]}
    level = {}

    def of(n):
        if n not in level:
            level[n] = None if n in cycle or reach[n] & cycle else max((of(m) + 1 for m in needs[n]), default=0)
        return level[n]

    return {n: (of(n), n in cycle) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_dependency_order_against_plain_reach(spark, seed):
    import random

    rng = random.Random(seed)
    nodes = list(range(70))
    edges = [(i, i + 1) for i in range(0, 12)] + [(20, 21), (21, 22), (22, 20), (30, 31), (31, 30), (32, 30), (33, 32), (31, 34), (34, 35), (40, 40), (99, 1)]
    edges += [(50, 51), (51, 52), (52, 50), (52, 53), (53, 54), (54, 55), (55, 53)]
    edges += [(rng.randint(10, 69), rng.randint(10, 69)) for _ in range(8 * seed)]
    got = graph.dependency_order(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r["node"]: (r["level"], r["in_cycle"]) for r in got.collect()} == _brute_order(nodes, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "settle", lambda df, real=graph.settle: rounds.append(1) or real(df))
    nodes = spark.range(10_000).withColumnRenamed("id", "node")
    edges = nodes.where("node < 9999").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    got = graph.dependency_order(nodes, edges)
    assert got.where(F.col("level") != 9999 - F.col("node")).count() == 0 and got.count() == 10_000
    assert len(rounds) < 60  # two doublings of 14 rounds, and what does not grow with the chain


def test_deliveries_are_files_whatever_the_partitions_are(spark):
    from tracewell.queries import live as jobs

    rows = spark.range(4000).select((F.col("id") * 1000).alias("ts_ms"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = jobs._arriving(spark, rows, "deliveries")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    kept = spark.read.parquet(path)
    assert len(kept.inputFiles()) == jobs.FILES + 1 and kept.count() == 4001
