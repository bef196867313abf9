"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import settle

#: Weights dealt to the sources in order of their names.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size; no document is taken more often.
MOST_COPIES = 3
#: Ranks are cut into so many steps per source before the step at the boundary is sorted.
STEPS = 4096
#: Passes over the ranking; each later one offers the rest of the quota to documents that still fit.
ROUNDS = 3
BLANK_FREE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_FREE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row per source.

    Water filling in closed form: by rising size per weight, a source is full when its limit lies
    below the level that the sources not yet full would share.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")).cast("double")
    s = F.col("source_size").cast("double")
    dealt = sources.withColumn("w", w).withColumn("limit", s * most)
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    none = F.lit(0.0)
    open_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), none)
    left = F.sum(s).over(every) - F.coalesce(F.sum("limit").over(before), none)
    full = dealt.withColumn("full", F.col("limit") * open_weight < left * F.col("w")).withColumn("all", F.sum(s).over(every))
    spent = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(none)).over(every)
    shared = F.sum(F.when(F.col("full"), none).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("limit")).otherwise((F.col("all") - spent) * F.col("w") / shared)
    return full.select("source", "source_size", target.alias("target"))


def _fill(ranked: DataFrame) -> DataFrame:
    """Take, in order of rank, units that fit the gap of their source, up to the first that does not.

    ``in`` and ``gap`` are brought up to date. The sums per step and the one sorted step give a row
    per source, which is stored; the units themselves are not moved.
    """
    fits = ~F.col("in") & F.col("rank").isNotNull() & (F.col("words") <= F.col("gap"))
    steps = ranked.where(fits).groupBy("source", "step").agg(F.sum("words").alias("words"), F.max("gap").alias("gap"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("step"))
    over = F.col("upto") > F.col("gap")
    cut = (
        steps.withColumn("upto", upto)
        .groupBy("source")
        .agg(F.min(F.when(over, F.col("step"))).alias("cut"), F.max(F.when(~over, F.col("upto"))).alias("before"))
        .select(F.col("source").alias("of"), "cut", F.coalesce("before", F.lit(0)).alias("before"))
    )
    here = F.struct("rank", "draw", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    at_cut = ranked.where(fits).join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("step") == F.col("cut")))
    run = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy(here))
    last = (
        at_cut.withColumn("run", run)
        .where(F.col("run") <= F.col("gap"))
        .groupBy("source")
        .agg(F.max(here).alias("last"), F.max("run").alias("run"))
        .withColumnRenamed("source", "at")
    )
    bound = settle(cut.join(last, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"))
    out = ranked.join(bound, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    below = F.col("cut").isNull() | (F.col("step") < F.col("cut")) | ((F.col("step") == F.col("cut")) & F.coalesce(here <= F.col("last"), F.lit(False)))
    out = out.withColumn("in", F.col("in") | (fits & below))
    return out.withColumn("gap", F.col("gap") - F.coalesce("run", "before", F.lit(0))).drop("cut", "before", "last", "run")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are not read. Every document of a source
    gets floor(target / source_size) whole copies. What is left of the target is filled by Pareto
    order sampling: documents are ranked by the odds of a uniform number, divided by the odds of
    their inclusion probability (the missing share, scaled by size / (size + 100), so very short
    documents get a repeat less often), and taken in that order up to the first that does not fit;
    ``ROUNDS`` passes offer what is left to documents that still fit, and one further document, the
    one that comes nearest to the rest, closes the gap if it brings the sum nearer.

    The uniform number comes from md5 of id and text, so reruns agree. A null source is a source of
    its own, null and empty texts have size 0 and are never taken. Rows with equal id, source and
    text are ranked as one and taken or left together; rows that share only the id are told apart
    by their text. An empty table gives no rows.

    Running sums over a source never sort the source in one task: words are summed per step of the
    rank first, and only the step in which the target is reached is sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary"))
    units = settle(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"))
        .groupBy("doc_id", "source", "size", "draw")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    liking = F.col("size") / (F.col("size") + F.lit(100.0))
    known = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"),
        F.sum(liking * F.col("rows")).alias("liking_sum"),
        F.sum("rows").alias("docs"),
    )
    plan = targets(known.select("source", "source_size"), weights, most).withColumnRenamed("source", "of")
    plan = plan.join(known.select(F.col("source").alias("of_"), "liking_sum", "docs"), F.col("of").eqNullSafe(F.col("of_"))).drop("of_")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = settle(plan)

    share = F.col("quota") / F.col("source_size")
    chance = F.least(share * liking / (F.col("liking_sum") / F.col("docs")), F.lit(1 - 1e-9))
    u = (F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    rank = (u / (1 - u)) / (chance / (1 - chance))
    ranked = units.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("words", F.col("size") * F.col("rows"))
    ranked = ranked.withColumn("rank", F.when((F.col("quota") > 0) & (F.col("size") > 0), rank))
    ranked = ranked.withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS))
    ranked = ranked.withColumn("in", F.lit(False)).withColumn("gap", F.col("quota"))
    for _ in range(ROUNDS):
        ranked = _fill(ranked)
    miss = F.abs(F.col("words") - F.col("gap"))
    closing = (
        ranked.where(~F.col("in") & F.col("rank").isNotNull() & (miss < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), "rank", "draw", "doc_id")).alias("closing"))
        .withColumnRenamed("source", "of")
    )
    ranked = ranked.join(closing, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    closes = F.coalesce((F.col("closing.draw") == F.col("draw")) & F.col("closing.doc_id").eqNullSafe(F.col("doc_id")) & ~F.col("in"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("in") | closes).cast("long")).otherwise(0)
    out = ranked.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    return out.select(
        "doc_id", "source", "draw", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row_no"),
    ).drop("row_no")
