"""Exact percentiles with linear interpolation, without holding a huge group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import ordered


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per key with the percentile columns named in ``points`` (0..1).

    ``extra`` adds further aggregates over the same rows.  Rank rule: position
    ``(n - 1) * p``, linear between neighbours.  If every key is below the row limit,
    the built-in exact percentile does it in one aggregation.  Else equal values are
    counted before the shuffle, the running count is an ordered scan, and only the two
    values next to each rank reach the last aggregation.
    """
    extra = extra or {}
    known = df.where(F.col(value).isNotNull())
    hot = ordered.hot_keys(known, keys, value)
    more = [c.alias(n) for n, c in extra.items()]
    if hot.table is None:
        wanted = F.percentile(value, F.array(*[F.lit(float(p)) for p in points.values()]))
        grouped = df.groupBy(*keys).agg(wanted.alias("__p"), *more)
        picked = [F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(points)]
        return grouped.select(*keys, *picked, *extra)

    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered.scan(counted, keys, [value], hot, __upto=ordered.running_sum(F.col("__c")))
    totals = df.groupBy(*keys).agg(F.count(value).alias("__n"), *more)
    joined = _join(ranked, totals, keys, [value, "__c", "__upto", "__n"])
    below = F.col("__upto") - F.col("__c")

    def at(rank):
        return F.max(F.when((below <= rank) & (rank < F.col("__upto")), F.col(value)))

    picks = []
    for name, p in points.items():
        place = (F.col("__n") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(place)).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place).alias(f"__at_{name}"),
        ]
    low, high, at_ = ({n: F.col(f"__{c}_{n}") for n in points} for c in ("lo", "hi", "at"))
    # the same arithmetic as the built-in aggregate, so both ways agree to the last bit
    between = {n: (F.ceil(at_[n]) - at_[n]) * low[n] + (at_[n] - F.floor(at_[n])) * high[n] for n in points}
    edges = joined.groupBy(*keys).agg(*picks).select(
        *keys, *[F.when(low[n] == high[n], low[n].cast("double")).otherwise(between[n]).alias(n) for n in points]
    )
    return _join(totals, edges, keys, [*points, *extra])


def _join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    on = None
    for k in keys:
        test = left[k].eqNullSafe(right[k])
        on = test if on is None else on & test
    return left.join(right, on).select(*[left[k] for k in keys], *columns)
