"""Screen rules: which rule fires for a screen and the state that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dispatch(screens: DataFrame, rules: DataFrame, key: str, predicates: dict[str, Column] | None = None) -> DataFrame:
    """Rule of the highest priority whose signature, states and predicate fit each screen.

    ``rules``: rule_id, signature, states (array or null), predicate (name or null), priority,
    next_state.  Rules meet screens by equal signature; handlers are not run here.
    """
    joined = screens.join(rules, "signature")
    fits = F.col("states").isNull() | F.array_contains("states", F.col("state"))
    test = F.col("predicate").isNull()
    for name, condition in (predicates or {}).items():
        test = test | ((F.col("predicate") == name) & F.coalesce(condition, F.lit(False)))
    return (
        joined.where(fits & test)
        .groupBy(key)
        .agg(F.min_by(F.struct("rule_id", "next_state"), F.struct(-F.col("priority"), F.col("rule_id"))).alias("r"))
        .select(key, "r.rule_id", "r.next_state")
    )
