"""Typed counters from stored text of host tools (Linux /proc files, AIX commands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole disks, not partitions.
BASE_DISK = r"^(sd[a-z]+|vd[a-z]+|xvd[a-z]+|hd[a-z]+|nvme\d+n\d+|mmcblk\d+)$"


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _number(words: Column, place: int) -> Column:
    return F.get(words, F.lit(place)).try_cast("bigint")


def cpu_counters(snapshots: DataFrame) -> DataFrame:
    """Busy, iowait and total jiffies from /proc/stat text."""
    line = F.element_at(F.filter(_lines(F.col("text")), lambda x: x.startswith("cpu ")), 1)
    numbers = F.transform(
        F.filter(F.slice(_words(line), 2, 64), lambda w: w.rlike(r"^\d+$")), lambda w: w.cast("bigint")
    )
    base = snapshots.select("host", "ts_ms", numbers.alias("v")).where(F.size("v") >= 4)
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    iowait = F.coalesce(F.get("v", F.lit(4)), F.lit(0))
    return base.select(
        "host", "ts_ms", (total - F.get("v", F.lit(3)) - iowait).alias("busy"), iowait.alias("iowait"), total.alias("total")
    )


def memory_gauges(snapshots: DataFrame) -> DataFrame:
    """Memory and swap gauges from /proc/meminfo text."""

    def field(name: str) -> Column:
        return F.regexp_extract("text", rf"(?m)^{name}:\s+(\d+)", 1).try_cast("bigint")

    total = F.coalesce(field("MemTotal"), F.lit(0))
    free = F.coalesce(field("MemAvailable"), field("MemFree"), F.lit(0))
    used = F.greatest(total - free, F.lit(0))
    swap, swap_free = F.coalesce(field("SwapTotal"), F.lit(0)), F.coalesce(field("SwapFree"), F.lit(0))
    known = total > 0
    return snapshots.select(
        "host", "ts_ms",
        F.when(known, F.bround(total / 1024, 1)).alias("mem_total_mb"),
        F.when(known, F.bround(used / 1024, 1)).alias("mem_used_mb"),
        F.when(known, F.bround(used * 100 / total, 1)).alias("mem_pct"),
        F.when(swap > 0, F.bround((swap - swap_free) * 100 / swap, 1)).alias("swap_pct"),
    )


def disk_counters(snapshots: DataFrame) -> DataFrame:
    """Counters of every whole disk from /proc/diskstats text."""
    rows = snapshots.select("host", "ts_ms", F.explode(_lines(F.col("text"))).alias("line")).select(
        "host", "ts_ms", _words(F.col("line")).alias("w")
    )
    places = {"reads": 3, "sectors_read": 5, "read_ms": 6, "writes": 7, "sectors_written": 9, "write_ms": 10, "busy_ms": 12}
    return rows.where((F.size("w") >= 13) & F.get("w", F.lit(2)).rlike(BASE_DISK)).select(
        "host", "ts_ms", F.get("w", F.lit(2)).alias("disk"), *[_number(F.col("w"), p).alias(n) for n, p in places.items()]
    )


def vmstat_aix(snapshots: DataFrame) -> DataFrame:
    """CPU percent and free pages from the last data line of AIX vmstat text.

    Columns are found through the header: ``us`` and ``sy`` by their last place (``sy``
    occurs twice), ``fre`` by its first.
    """
    words = F.transform(_lines(F.col("text")), lambda line: _words(line))

    def is_header(w: Column) -> Column:
        return F.array_contains(w, "us") & F.array_contains(w, "sy") & F.array_contains(w, "fre")

    rows = snapshots.select("host", "ts_ms", words.alias("w")).select(
        "host", "ts_ms",
        F.element_at(F.filter("w", is_header), -1).alias("head"),
        F.element_at(F.filter("w", lambda w: F.get(w, F.lit(0)).rlike(r"^-*\d+$")), -1).alias("data"),
    )

    def cell(place: Column) -> Column:
        return F.get("data", place.cast("int")).try_cast("bigint")

    def last(name: str) -> Column:
        return F.size("head") - F.array_position(F.reverse("head"), name)

    return rows.select(
        "host", "ts_ms",
        (cell(last("us")) + cell(last("sy"))).cast("double").alias("cpu_pct"),
        cell(F.array_position("head", "fre") - 1).alias("free_pages"),
    ).where(F.col("cpu_pct").isNotNull() & F.col("free_pages").isNotNull())


def swap_aix(snapshots: DataFrame) -> DataFrame:
    """Used paging space in percent from ``lsps -s`` text."""
    share = F.regexp_extract("text", r"(?m)(?:^|\s)([\d.]+)%\s*$", 1).try_cast("double")
    return snapshots.select("host", "ts_ms", share.alias("swap_pct"))


def real_memory_aix(snapshots: DataFrame) -> DataFrame:
    """Real memory in kB from ``lsattr`` text, value before or after the attribute name."""
    line = F.element_at(
        F.filter(_lines(F.col("text")), lambda x: x.rlike(r"(^|\s)realmem(\s|$)") | x.rlike(r"^\s*\d+\s+\S")), 1
    )
    return snapshots.select(
        "host", "ts_ms", F.regexp_extract(line, r"(?:^|\s)(\d+)(?=\s|$)", 1).try_cast("bigint").alias("mem_total_kb")
    )


def load_averages(snapshots: DataFrame) -> DataFrame:
    """Load averages from ``uptime`` text."""
    shape = r"load averages?:\s*([\d.]+),\s*([\d.]+),\s*([\d.]+)"
    return snapshots.select(
        "host", "ts_ms",
        *[F.regexp_extract("text", shape, i).try_cast("double").alias(n) for i, n in ((1, "load1"), (2, "load5"), (3, "load15"))],
    )


def iostat_aix(snapshots: DataFrame, interval_s: float = 1.0) -> DataFrame:
    """Disk and I/O-wait gauges from the last report of AIX ``iostat`` text."""
    tail = F.substring_index("text", "Disks:", -1)
    has_disks = F.contains(F.col("text"), F.lit("Disks:"))
    block = F.element_at(F.split(tail, r"\n\s*\n"), 1)
    shape = r"^(hdisk\S*)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+(\d+)\s+(\d+)\s*$"
    disks = F.filter(_lines(block), lambda x: x.rlike(shape))
    cpu = F.element_at(
        F.filter(_lines(F.col("text")), lambda x: x.rlike(r"^\s*(-?[\d.]+\s+){5}-?[\d.]+\s*$")), -1
    )

    def numbers(group: int) -> Column:
        return F.transform("d", lambda x: F.regexp_extract(x, shape, group).cast("double"))

    def total(group: int) -> Column:
        return F.aggregate(numbers(group), F.lit(0.0), lambda a, x: a + x)

    known = F.size("d") > 0
    return snapshots.select(
        "host", "ts_ms", F.when(has_disks, disks).otherwise(F.array().cast("array<string>")).alias("d"), cpu.alias("cpu")
    ).select(
        "host", "ts_ms",
        F.when(known, F.bround(total(5) / interval_s, 1)).alias("disk_read_kbs"),
        F.when(known, F.bround(total(6) / interval_s, 1)).alias("disk_write_kbs"),
        F.when(known, F.bround(total(4), 1)).alias("iops"),
        F.when(known, F.bround(F.array_max(numbers(2)), 1)).alias("disk_busy_pct"),
        F.element_at(_words(F.col("cpu")), -1).try_cast("double").alias("cpu_iowait_pct"),
    )


def disk_latency_aix(snapshots: DataFrame) -> DataFrame:
    """Mean service time in ms, weighted by operations, of the last report of ``iostat -D`` text.

    Numbers may end in K, M, G (magnitude) or S (seconds in a field of milliseconds).
    """
    number = r"([\d.]+)([KMGS]?)"
    shape = rf"(?m)^(hdisk\S*)\s+xfer:[^\n]*|(read|write):[^\n]*avgserv[^\n]*\n\s*{number}\s+{number}"
    hits = F.regexp_extract_all("text", F.lit(shape), F.lit(0))
    walked = snapshots.select("host", "ts_ms", hits.alias("hits"))

    def scaled(value: Column, suffix: Column) -> Column:
        factor = (
            F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "G", 1e9).when(suffix == "S", 1e3).otherwise(1.0)
        )
        return value.cast("double") * factor

    inner = rf"^(read|write):[^\n]*\n\s*{number}\s+{number}"
    folded = F.aggregate(
        "hits",
        F.struct(F.lit("").alias("disk"), F.create_map().cast("map<string,struct<ops:double,ms:double>>").alias("seen")),
        lambda acc, h: F.when(
            h.startswith("hdisk"), F.struct(F.regexp_extract(h, r"^(\S+)", 1).alias("disk"), acc["seen"].alias("seen"))
        ).otherwise(
            F.struct(
                acc["disk"].alias("disk"),
                _put(
                    acc["seen"],
                    F.concat(acc["disk"], F.lit("|"), F.regexp_extract(h, inner, 1)),
                    F.struct(
                        scaled(F.regexp_extract(h, inner, 2), F.regexp_extract(h, inner, 3)).alias("ops"),
                        scaled(F.regexp_extract(h, inner, 4), F.regexp_extract(h, inner, 5)).alias("ms"),
                    ),
                ).alias("seen"),
            )
        ),
    )
    values = F.map_values(folded["seen"])
    return walked.select("host", "ts_ms", values.alias("v")).select(
        "host", "ts_ms",
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x["ops"]).alias("ops"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x["ops"] * x["ms"]).alias("weighted"),
    ).select("host", "ts_ms", F.when(F.col("ops") > 0, F.bround(F.col("weighted") / F.col("ops"), 2)).alias("disk_latency_ms"))


def _put(known: Column, key: Column, value: Column) -> Column:
    others = F.map_filter(known, lambda k, _: k != key)
    return F.map_concat(others, F.create_map(key, value))
