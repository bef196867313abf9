"""Domain tables built from the driver tables, with the same mapping as SQL text.

``read`` and the functions below give DataFrames; the ``*_SQL`` constants are the
matching common table expressions for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import ordered


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the tables store wall-clock times; they are read as UTC whatever the session was started with
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys where the scan has fewer splits than there are cores for heavy work on each row."""
    few = rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(*keys) if few else rows


def audit_events(spark: SparkSession, sf: str, seq_session: bool = False) -> DataFrame:
    """``events`` as an audit log: one capture, one session per user."""
    ev = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    closing = (
        ev.where(F.col("user_id") % 2 == 0)
        .groupBy("user_id")
        .agg(F.max("event_id").alias("closing_id"))
        .select("closing_id")
    )
    ev = ev.join(closing, ev["event_id"] == closing["closing_id"], "left")
    kind = F.col("event_type")
    typ = (
        F.when(F.col("closing_id").isNotNull(), "session_end")
        .when(kind == "signup", "session_start")
        .when(kind == "view", "checkpoint")
        .when(kind == "click", "deterministic_input")
        .otherwise("bytes")
    )
    ev = ev.withColumn("type", typ)
    is_bytes = F.col("type") == "bytes"
    is_start = F.col("type") == "session_start"
    text = F.concat(
        F.when(kind == "purchase", F.when(F.col("k") % 5 == 0, "login: ").otherwise("ok ")).otherwise("key "),
        F.col("k").cast("string"),
    )
    ev = ev.select(
        (F.col("event_id") + 1).alias("seq_global"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"),
        "type",
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("actor"),
        F.when(is_bytes, F.when(kind == "purchase", "out").otherwise("in")).alias("dir"),
        F.when(is_bytes, F.col("k")).alias("n"),
        F.when(F.col("type") == "checkpoint", F.concat(F.lit("k"), F.col("k").cast("string")))
        .when(F.col("type") == "deterministic_input", F.concat(F.lit("k"), F.col("k").cast("string")))
        .alias("sig"),
        F.when(is_bytes, F.base64(text.cast("binary"))).alias("data_b64"),
        F.when(is_start & (F.col("k") % 13 == 0), "scp").alias("source_command"),
        F.when(is_start, F.concat(F.lit("gw"), (F.col("user_id") % 3).cast("string"))).alias("gateway_endpoint"),
        F.when(is_start & (F.col("k") % 17 == 0), F.lit(False)).alias("via_gateway"),
        "k",
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        F.concat(F.lit("audit-"), F.date_format(F.col("ts"), "yyyyMMdd"), F.lit(".jsonl")).alias("part"),
    )
    if not seq_session:
        return ev
    return ordered.scan(ev, ["session_id"], ["seq_global"], seq_session=ordered.row_number())


AUDIT_SQL = """
ae AS (
  SELECT e.*, e.event_id + 1 AS seq_global, 's' || e.user_id AS session_id,
         epoch_us(e.ts) // 1000 AS ts_ms, 'u' || (e.user_id % 7) AS actor,
         CASE WHEN type = 'bytes' THEN CASE WHEN event_type = 'purchase' THEN 'out' ELSE 'in' END END AS dir,
         CASE WHEN type = 'bytes' THEN k END AS n,
         CASE WHEN type IN ('checkpoint', 'deterministic_input') THEN 'k' || k END AS sig,
         CASE WHEN type = 'bytes' THEN
           CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 5 = 0 THEN 'login: ' ELSE 'ok ' END
                ELSE 'key ' END || k END AS text,
         CASE WHEN type = 'session_start' AND k % 13 = 0 THEN 'scp' END AS source_command,
         CASE WHEN type = 'session_start' THEN 'gw' || (user_id % 3) END AS gateway_endpoint,
         CASE WHEN type = 'session_start' AND k % 17 = 0 THEN FALSE END AS via_gateway,
         'audit-' || strftime(ts, '%Y%m%d') || '.jsonl' AS part
  FROM (
    SELECT event_id, ts, user_id, event_type, value, props, k, seq_session,
           CASE WHEN user_id % 2 = 0 AND event_id = last_id THEN 'session_end'
                WHEN event_type = 'signup' THEN 'session_start'
                WHEN event_type = 'view' THEN 'checkpoint'
                WHEN event_type = 'click' THEN 'deterministic_input'
                ELSE 'bytes' END AS type
    FROM (
      SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             max(event_id) OVER (PARTITION BY user_id) AS last_id,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq_session
      FROM events)
  ) e
)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as replay runs; the parent is the customer's previous order for every third run."""
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    previous = ordered.scan(
        o.select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], prev_key=ordered.lag(F.col("o_orderkey"))
    )
    o = o.join(
        previous.where(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("pk"), "prev_key"),
        F.col("o_orderkey") == F.col("pk"),
        "left",
    )
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("run_id"),
            F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END").alias(
                "status"
            ),
            F.coalesce("n_name", F.lit("sem_ambiente")).alias("environment"),
            F.col("o_custkey").alias("scenario_id"),
            F.col("o_orderpriority").alias("mode"),
            F.col("prev_key").alias("parent_run_id"),
            F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000").alias("created_at_ms"),
            "o_totalprice",
        )
    )


RUNS_SQL = """
runs AS (
  SELECT o_orderkey AS run_id,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS status,
         coalesce(n_name, 'sem_ambiente') AS environment, o_custkey AS scenario_id, o_orderpriority AS mode,
         CASE WHEN o_orderkey % 3 = 0 THEN prev_key END AS parent_run_id,
         epoch_us(o_orderdate) // 1000 AS created_at_ms, o_totalprice
  FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_key FROM orders) o
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """All line items as replay failures; orders without line items are runs without failures."""
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("session_id"),
        F.col("l_linenumber").cast("long").alias("seq_global"),
        F.concat(F.lit("flow"), (F.col("l_suppkey") % 10).cast("string")).alias("flow_name"),
        F.expr(
            "CASE l_returnflag WHEN 'R' THEN 'timeout' WHEN 'A' THEN 'screen_divergence' "
            "ELSE 'checkpoint_mismatch' END"
        ).alias("failure_type"),
        F.expr(
            "CASE WHEN l_tax < 0.02 THEN 'low' WHEN l_tax < 0.04 THEN 'medium' "
            "WHEN l_tax < 0.07 THEN 'high' ELSE 'critical' END"
        ).alias("severity"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("expected_value"),
        F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("observed_value"),
        F.concat(F.lit("supplier "), (F.col("l_suppkey") % 20).cast("string")).alias("message"),
        F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000").alias("ts_ms"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
    )


FAILURES_SQL = """
failures AS (
  SELECT l_orderkey AS run_id, 's' || (l_partkey % 50) AS session_id, CAST(l_linenumber AS BIGINT) AS seq_global,
         'flow' || (l_suppkey % 10) AS flow_name,
         CASE l_returnflag WHEN 'R' THEN 'timeout' WHEN 'A' THEN 'screen_divergence'
              ELSE 'checkpoint_mismatch' END AS failure_type,
         CASE WHEN l_tax < 0.02 THEN 'low' WHEN l_tax < 0.04 THEN 'medium'
              WHEN l_tax < 0.07 THEN 'high' ELSE 'critical' END AS severity,
         'p' || (l_partkey % 5) AS expected_value, 'o' || l_linenumber AS observed_value,
         'supplier ' || (l_suppkey % 20) AS message, epoch_us(l_shipdate) // 1000 AS ts_ms,
         l_partkey AS part_key, l_suppkey AS supp_key
  FROM lineitem
)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as benchmark samples of two environments."""
    li = read(spark, sf, "lineitem")
    start_s = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000000")
    return li.select(
        F.col("l_linestatus").alias("environment_id"),
        F.expr("element_at(array(1, 5, 10, 20), cast(l_suppkey % 4 as int) + 1)").cast("long").alias("concurrency"),
        F.col("l_linenumber").cast("long").alias("iteration"),
        F.when(F.col("l_quantity") <= 3, "WARMUP").otherwise("MEASUREMENT").alias("phase"),
        F.col("l_extendedprice").alias("latency_ms"),
        (F.col("l_returnflag") != "R").alias("success"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)).alias("timeout"),
        (F.col("l_discount") > 0.08).alias("functional_divergence"),
        (start_s * 1000000000).alias("started_ns"),
        ((start_s + F.col("l_quantity").cast("long")) * 1000000000).alias("finished_ns"),
        F.col("l_orderkey").alias("user_key"),
        F.col("l_partkey").alias("journey_key"),
        F.expr("CASE WHEN l_suppkey % 11 = 0 THEN 'ABORTED' ELSE 'COMPLETED' END").alias("run_status"),
    )


SAMPLES_SQL = """
samples AS (
  SELECT l_linestatus AS environment_id, CAST([1, 5, 10, 20][l_suppkey % 4 + 1] AS BIGINT) AS concurrency,
         CAST(l_linenumber AS BIGINT) AS iteration,
         CASE WHEN l_quantity <= 3 THEN 'WARMUP' ELSE 'MEASUREMENT' END AS phase,
         l_extendedprice AS latency_ms, l_returnflag <> 'R' AS success,
         (l_returnflag = 'R' AND l_tax > 0.05) AS timeout, l_discount > 0.08 AS functional_divergence,
         epoch_us(l_shipdate) // 1000000 * 1000000000 AS started_ns,
         (epoch_us(l_shipdate) // 1000000 + CAST(l_quantity AS BIGINT)) * 1000000000 AS finished_ns,
         l_orderkey AS user_key, l_partkey AS journey_key,
         CASE WHEN l_suppkey % 11 = 0 THEN 'ABORTED' ELSE 'COMPLETED' END AS run_status
  FROM lineitem
)"""


def host_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as host gauges of four hosts; every ninth value is missing."""
    ev = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return ev.select(
        F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"),
        "event_id",
        F.when(F.col("event_id") % 9 != 0, F.col("k").cast("double")).alias("cpu_pct"),
        F.when(F.col("event_id") % 10 != 0, F.col("k") * 0.9).alias("mem_pct"),
        F.when(F.col("k") > 95, F.col("value")).otherwise(0.0).alias("swap_pct"),
        (F.col("value") * 2).alias("disk_latency_ms"),
        F.least(F.col("value"), F.lit(100.0)).alias("disk_busy_pct"),
        F.col("value").alias("net_kbs"),
        "k",
        "value",
        "user_id",
    )


HOST_SQL = """
host_metrics AS (
  SELECT 'h' || (user_id % 4) AS host, epoch_us(ts) // 1000 AS ts_ms, event_id,
         CASE WHEN event_id % 9 <> 0 THEN CAST(k AS DOUBLE) END AS cpu_pct,
         CASE WHEN event_id % 10 <> 0 THEN CAST(k AS DOUBLE) * CAST(0.9 AS DOUBLE) END AS mem_pct,
         CASE WHEN k > 95 THEN value ELSE 0.0 END AS swap_pct, value * 2 AS disk_latency_ms,
         least(value, 100.0) AS disk_busy_pct, value AS net_kbs, k, value, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def with_tables(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"
