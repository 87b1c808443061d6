"""Validation as rows: each rule that an item breaks is a row of (item_id, rule_order, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(items: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rules: (name, condition that holds for a sound item); null counts as broken. Order is the rules' order."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("rule_order"), F.lit(name).alias("rule"))) for i, (name, ok) in enumerate(rules)]))
    return items.select("item_id", F.explode(broken).alias("r")).select("item_id", "r.rule_order", "r.rule")


def first_failures(found: DataFrame) -> DataFrame:
    """The rule that a check which stops at the first failure would name."""
    return found.groupBy("item_id").agg(F.min_by("rule", "rule_order").alias("rule"))


def closeness(wrong: Column) -> Column:
    """From the sorted numbers of violations of the three wrong options; null if no pattern fits or an option is missing."""
    one, two, three = (F.get(wrong, F.lit(i)) for i in range(3))
    return F.when((one == 2) & (two == 2) & (three >= 2), "easy").when((one == 1) & (two == 1) & (three == 2), "medium").when((one == 1) & (two == 1) & (three == 1), "hard")


def far_threshold(k: Column) -> Column:
    return F.ceil(k / 2).cast("int")


def distractor_level(wrong: Column, k: Column) -> Column:
    """DS1: all far from the gold option; DS2: one near, the others not; DS3: all near. Null without three wrong options."""
    far, near = F.array_min(wrong) >= far_threshold(k), F.array_max(wrong) == 1
    level = F.when(near, "DS3").when(far, "DS1").when((F.get(wrong, F.lit(0)) == 1) & (F.get(wrong, F.lit(1)) >= 2), "DS2")
    return F.when(F.size(wrong) >= 3, level)


def signature_capacity(k: Column) -> Column:
    """How many sets of at least half of k constraints there are."""
    factorial = lambda n: F.factorial(n.cast("int"))
    return F.aggregate(F.sequence(far_threshold(k), k), F.lit(0).cast("long"), lambda acc, s: acc + (factorial(k) / (factorial(s) * factorial(k - s))).cast("long"))
