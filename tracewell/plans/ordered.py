"""Running values over an ordered group that stay distributed when one group is huge.

``Window.partitionBy(key)`` sends a whole key to one task.  So the size of the keys is
checked first (a count over the key columns alone; one row comes back).  If no key exceeds
the row limit, the plain window is used: one shuffle, shared by all scans of the same key.
Keys above the limit are cut into ranges of the order columns, at quantiles of a sample of
their rows; the window runs per (key, range), and what earlier ranges contribute is added
from a small per-range summary.  Bounds decide only how rows are dealt, never a result.

Sizes are bounded by construction: a key is cut if it holds more rows than the limit and
more than one in ``SHARE`` of all rows, into ranges of a quarter of that.  So there are at
most ``SHARE`` such keys and ``RANGES_PER_LIMIT * SHARE`` bounds at any size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import hot_rows

SHARE = 50_000
RANGES_PER_LIMIT = 4
#: Rows looked at for each range.
LOOKS = 32

_RANGE = "__range"


@dataclass(frozen=True)
class Running:
    """One output column of an ordered scan."""

    kind: str
    value: Column | None = None
    include_current: bool = True
    backward: bool = False


def row_number() -> Running:
    return Running("count")


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def running_max(value: Column, include_current: bool = True) -> Running:
    return Running("max", value, include_current)


def running_min(value: Column, include_current: bool = True) -> Running:
    return Running("min", value, include_current)


def lag(value: Column) -> Running:
    """Value of the previous row (null on the first row)."""
    return Running("near", value, include_current=False)


def lead(value: Column) -> Running:
    return Running("near", value, include_current=False, backward=True)


def last_known(value: Column, include_current: bool = True) -> Running:
    """Latest non-null value up to this row (or before it)."""
    return Running("known", value, include_current)


def next_known(value: Column, include_current: bool = False) -> Running:
    return Running("known", value, include_current, backward=True)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


@dataclass(frozen=True)
class Cuts:
    """Keys that are cut, one row each with the bounds of its ranges (no table: none), and the
    largest number of bounds of a key."""

    order: tuple[str, ...]
    table: DataFrame | None = None
    most: int = 0


def _position(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def _on_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & _same(left[k], right[f"{prefix}{k}"])
    return on


def hot_keys(df: DataFrame, keys: list[str], order: str | list[str]) -> Cuts:
    """Keys above the row limit and the bounds of their ranges.

    One aggregation tells whether there are any.  Only then a sample of their rows is ranked
    along ``order``, and every so many rows one becomes a bound.
    """
    order = [order] if isinstance(order, str) else list(order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
    least = max(hot_rows(df.sparkSession), (total or 0) // SHARE)
    if (largest or 0) <= least:
        return Cuts(tuple(order))
    rows = max(1, least // RANGES_PER_LIMIT)
    step = max(1, rows // LOOKS)
    names = [f"__hot_{k}" for k in keys]
    hot = sizes.where(F.col("__n") > least).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    looked = df.where(F.rand(17) * step < 1) if step > 1 else df
    looked = looked.join(F.broadcast(hot), _on_keys(looked, hot, keys, "__hot_")).select(*names, _position(order).alias("__at"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy("__at"))
    chosen = looked.withColumn("__no", place).where(F.col("__no") % max(1, rows // step) == 0)
    bounds = chosen.groupBy(*names).agg(F.collect_list("__at").alias("__bounds"))
    found = bounds.collect()
    table = df.sparkSession.createDataFrame(found, bounds.schema).withColumn("__bounds", F.sort_array("__bounds"))
    return Cuts(tuple(order), table, max((len(r["__bounds"]) for r in found), default=0))


def with_range(df: DataFrame, keys: list[str], order: list[str], cuts: Cuts) -> DataFrame:
    """Add the range number: 0 for ordinary keys, from 1 along the order for those that are cut.

    The range follows from the number of bounds up to a row's position, found by halving.
    """
    position = _position(order[: len(cuts.order)])
    steps = F.array(*[F.lit(2**p) for p in reversed(range(max(1, cuts.most.bit_length())))])
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__bounds", at + step - 1) <= position, at + step).otherwise(at))
    joined = df.join(F.broadcast(cuts.table), _on_keys(df, cuts.table, keys, "__hot_"), "left")
    ranged = F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(upto + 1)
    return joined.select(*df.columns, ranged.cast("long").alias(_RANGE))


def _plain(df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, Running]) -> DataFrame:
    columns = []
    for name, spec in outputs.items():
        ordering = [F.col(c).desc() if spec.backward else F.col(c).asc() for c in order]
        stop = Window.currentRow if spec.include_current else -1
        frame = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, stop)
        if spec.kind == "count":
            column = F.count(F.lit(1)).over(frame)
        elif spec.kind == "near":
            column = F.lag(spec.value).over(Window.partitionBy(*keys).orderBy(*ordering))
        else:
            aggregate = {"sum": F.sum, "max": F.max, "min": F.min, "known": lambda v: F.last(v, ignorenulls=True)}
            column = aggregate[spec.kind](spec.value).over(frame)
        columns.append(column.alias(name))
    return df.select("*", *columns)


def scan(
    df: DataFrame, keys: list[str], order: list[str], hot: Cuts | None = None, **outputs: Running
) -> DataFrame:
    """``df`` plus running columns along ``order`` inside ``keys``.

    ``order`` must identify a row inside its key; its columns may have any type that
    can be ordered.  Pass ``hot`` (from ``hot_keys`` over the same rows or a superset,
    and the first or all order columns) to check the sizes once for several scans.
    """
    if hot is None:
        hot = hot_keys(df, keys, order)
    if hot.table is None:
        return _plain(df, keys, order, outputs)
    inputs, staged = [], {}
    for name, spec in outputs.items():
        if spec.value is not None:
            staged[name] = f"__in_{name}"
            inputs.append(spec.value.alias(staged[name]))
    base = with_range(df.select("*", *inputs), keys, order, hot)
    along = [F.col(c).asc() for c in order]
    against = [F.col(c).desc() for c in order]
    parts = [*keys, _RANGE]

    def frame(spec: Running):
        ordering = against if spec.backward else along
        stop = Window.currentRow if spec.include_current else -1
        return Window.partitionBy(*parts).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, stop)

    local, summary, carried = [], [], []
    position = F.struct(*order)
    flow = {
        False: Window.partitionBy(*keys).orderBy(F.col(_RANGE).asc()).rowsBetween(Window.unboundedPreceding, -1),
        True: Window.partitionBy(*keys).orderBy(F.col(_RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1),
    }
    result = []
    for name, spec in outputs.items():
        here, total, before = f"__w_{name}", f"__s_{name}", f"__p_{name}"
        value = F.col(staged[name]) if name in staged else None
        over = flow[spec.backward]
        if spec.kind == "count":
            local.append(F.count(F.lit(1)).over(frame(spec)).alias(here))
            summary.append(F.count(F.lit(1)).alias(total))
            carried.append(F.sum(total).over(over).alias(before))
            result.append((F.col(here) + F.coalesce(F.col(before), F.lit(0))).cast("long").alias(name))
        elif spec.kind == "sum":
            local.append(F.sum(value).over(frame(spec)).alias(here))
            summary.append(F.sum(value).alias(total))
            carried.append(F.sum(total).over(over).alias(before))
            both = F.col(here) + F.col(before)
            result.append(F.coalesce(both, F.col(here), F.col(before)).alias(name))
        elif spec.kind in ("max", "min"):
            pick, join_two = (F.max, F.greatest) if spec.kind == "max" else (F.min, F.least)
            local.append(pick(value).over(frame(spec)).alias(here))
            summary.append(pick(value).alias(total))
            carried.append(pick(total).over(over).alias(before))
            result.append(join_two(F.col(here), F.col(before)).alias(name))
        else:
            boxed = F.struct(value.alias("v"))
            if spec.kind == "known":
                boxed = F.when(value.isNotNull(), boxed)
            edge = F.min_by if spec.backward else F.max_by
            local.append(F.last(boxed, ignorenulls=True).over(frame(spec)).alias(here))
            summary.append(edge(boxed, F.when(boxed.isNotNull(), position)).alias(total))
            carried.append(F.last(F.col(total), ignorenulls=True).over(over).alias(before))
            result.append(F.coalesce(F.col(here), F.col(before))["v"].alias(name))

    windowed = base.select("*", *local)
    prefix = (
        base.where(F.col(_RANGE) > 0)
        .groupBy(*parts)
        .agg(*summary)
        .select(
            *[F.col(k).alias(f"__pre_{k}") for k in keys],
            F.col(_RANGE).alias("__pre_range"),
            *carried,
        )
    )
    on = (windowed[_RANGE] == prefix["__pre_range"]) & _on_keys(windowed, prefix, keys, "__pre_")
    # the number of rows is bounded; values are small if they are numbers, others are left to AQE
    numbers = all(isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in prefix.schema.fields[len(keys) :])
    return windowed.join(F.broadcast(prefix) if numbers else prefix, on, "left").select(*df.columns, *result)


def neighbours(
    df: DataFrame, keys: list[str], position: str, reach_back: int, reach_ahead: int, block: int = 4096, **outputs
) -> DataFrame:
    """Aggregates over the rows ``-reach_back..+reach_ahead`` of a dense position column.

    Rows are blocked by position; rows near an edge are copied to the next block, so
    a long group spreads over many tasks and each row is shuffled once (plus edges).
    ``outputs`` maps a name to an aggregate column (for example ``collect_list``).
    """
    home = F.floor(F.col(position) / block)
    copies = F.array_distinct(
        F.array(
            home,
            F.floor((F.col(position) + reach_back) / block),
            F.floor((F.col(position) - reach_ahead) / block),
        )
    )
    # a copy only serves as context: it is dropped after the window
    spread = df.select("*", home.alias("__home"), F.explode(copies).alias("__block"))
    frame = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(-reach_back, reach_ahead)
    with_values = spread.select("*", *[agg.over(frame).alias(name) for name, agg in outputs.items()])
    return with_values.where(F.col("__home") == F.col("__block")).drop("__home", "__block")
