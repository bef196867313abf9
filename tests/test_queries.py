"""A cross-section of the registered queries against their SQL twins; tools/check.py runs all."""

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "agg01_session_summary", "win01_session_index", "chn01_sequence_breaks", "jn06_run_comparison", "agg08_scenario_usage",
    "agg11_latency_statistics", "win05_sustained_saturation", "fn02_layout_signature", "jn09_error_matches",
    "ext03_file_commands", "grf01_run_families", "gen02_check_digits", "str04_rate_limit_batch",
)


@pytest.mark.parametrize("hot", [None, "40"])
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name, hot):
    if hot:
        spark.conf.set("spark.tracewell.hotRows", hot)
    try:
        status, _, note = check.compare(spark, check.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    finally:
        if hot:
            spark.conf.unset("spark.tracewell.hotRows")
    assert status == "ok", note


def test_every_sql_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry is not None


def test_screen_entities_read_all_line_items(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracewell.queries import tables

    read, discount = tables.read, F.lit(0)
    monkeypatch.setattr(tables, "read", lambda s, sf, name: read(s, sf, name).withColumn("l_discount", discount) if name == "lineitem" else read(s, sf, name))
    query = entry.queries()["jn12_screen_entities"]
    none = sorted(map(repr, query(spark, SF).collect()))
    discount = F.lit(0.1)
    assert none == sorted(map(repr, query(spark, SF).collect()))
