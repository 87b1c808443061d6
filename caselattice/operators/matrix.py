"""Constraint matrices and violation signatures: the core operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constraint_matrix(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidates (item_id, label, attributes map) and items (item_id, constraints array): a row for each label and
    constraint; satisfied is null where the candidate lacks the attribute.

    One join on item_id, before anything is exploded: a candidate's map and an item's array are one row each."""
    return cells(candidates.select("item_id", "label", "attributes").join(items.select("item_id", "constraints"), "item_id"))


def cells(candidates: DataFrame) -> DataFrame:
    """constraint_matrix of candidates (item_id, label, attributes map, constraints array) that hold their item's constraints."""
    each = candidates.select("item_id", "label", "attributes", F.explode("constraints").alias("c"))
    return each.select("item_id", "label", F.col("c.pos").alias("pos"), F.col("c.constraint_id").alias("constraint_id"), F.col("c.attribute").alias("attribute"), (F.element_at("attributes", F.col("c.attribute")) == F.col("c.required_value")).alias("satisfied"))


def broken_ids(attributes: Column, constraints: Column) -> Column:
    """The ids of the constraints that these attributes do not satisfy, in the order of the constraints.

    What a candidate lacks it does not satisfy; a null is no value, so a plain comparison would let it pass."""
    broken = F.filter(constraints, lambda c: ~F.coalesce(F.element_at(attributes, c["attribute"]) == c["required_value"], F.lit(False)))
    return F.transform(broken, lambda c: c["constraint_id"])


def violation_signatures(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, label, signature): the unsatisfied constraints' ids in the order of the constraints, without a group-by."""
    both = candidates.select("item_id", "label", "attributes").join(items.select("item_id", "constraints"), "item_id")
    return both.select("item_id", "label", broken_ids(F.col("attributes"), F.col("constraints")).alias("signature"))


def missing_attributes(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, label, constraint_id, attribute): constrained attributes that a candidate lacks."""
    return constraint_matrix(candidates, items).filter(F.col("satisfied").isNull()).select("item_id", "label", "constraint_id", "attribute")


def item_signatures(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """One row an item: sigs (map from label to signature), gold (the one label without violations, else null), valid (how
    many have none), wrong (sorted sizes of the others' signatures)."""
    return gathered(violation_signatures(candidates, items))


def gathered(signatures: DataFrame) -> DataFrame:
    """item_signatures of (item_id, label, signature)."""
    size = F.size("signature")
    found = signatures.groupBy("item_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "signature")))).alias("sigs"),
        F.count_if(size == 0).alias("valid"),
        F.max(F.when(size == 0, F.col("label"))).alias("first_gold"),
        F.array_sort(F.collect_list(F.when(size > 0, size))).alias("wrong"),
    )
    return found.withColumn("gold", F.when(F.col("valid") == 1, F.col("first_gold"))).drop("first_gold")
