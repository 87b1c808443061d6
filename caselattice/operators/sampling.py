"""Draws of unique subsets by their number, and ranks of whole columns by histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.sources.folders import stored

#: The most elements of a set; all numbers of subsets then fit 64 bits.
MOST = 60


def _binomial(n: Column, k: Column, most: int) -> Column:
    """Of numbers up to `most`; 0 where k is negative or above n."""
    table = F.array(*[F.array(*[F.lit(math.comb(a, b)) for b in range(most + 1)]).cast("array<long>") for a in range(most + 1)])
    return F.when((k >= 0) & (n >= 0), F.get(F.get(table, n.cast("int")), k.cast("int"))).otherwise(F.lit(0).cast("long"))


def subsets(k: Column, least: Column, most: int = MOST) -> Column:
    """How many sets of at least `least` of k elements there are; k is at most `most`."""
    return F.aggregate(F.sequence(least, k), F.lit(0).cast("long"), lambda s, n: s + _binomial(k, n, most))


def subset_at(k: Column, least: Column, number: Column, most: int = MOST) -> Column:
    """The set of that number, from 0, of at least `least` of the elements 1 to k, as a sorted array: smaller sets first, sets of
    one size in order of their elements. Each element is taken or left by one comparison with a binomial, so no set before it
    is made."""
    size = F.aggregate(
        F.sequence(least, k),
        F.struct(number.cast("long").alias("left"), F.lit(0).cast("int").alias("size")),
        lambda s, n: F.when((s["size"] == 0) & (s["left"] >= _binomial(k, n, most)), F.struct((s["left"] - _binomial(k, n, most)).alias("left"), F.lit(0).alias("size")))
        .when(s["size"] == 0, F.struct(s["left"].alias("left"), n.cast("int").alias("size")))
        .otherwise(s),
    )

    def take(s: Column, p: Column) -> Column:
        with_it = _binomial(k - p, s["size"] - 1, most)
        taken = F.struct(s["left"].alias("left"), (s["size"] - 1).alias("size"), F.array_append(s["found"], p.cast("int")).alias("found"))
        passed = F.struct((s["left"] - with_it).alias("left"), s["size"].alias("size"), s["found"].alias("found"))
        return F.when(s["size"] == 0, s).when(s["left"] < with_it, taken).otherwise(passed)

    begin = F.struct(size["left"].alias("left"), size["size"].alias("size"), F.expr("cast(array() as array<int>)").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), k), begin, take, lambda s: s["found"])


def unique_numbers(count: int, total: Column, draw_of) -> Column:
    """Array of `count` unlike numbers below total, draw i from draw_of(i); where there are fewer numbers, they repeat in turn.

    The i-th draw is among the numbers that are left: it passes over each number drawn before that is not above it."""
    found = F.expr("cast(array() as array<long>)")
    for i in range(count):
        among = draw_of(i).cast("long") % (total - i)
        passed = F.aggregate(F.array_sort(found), among, lambda at, taken: F.when(taken <= at, at + 1).otherwise(at))
        found = F.array_append(found, passed)
    return F.when(total >= count, found).otherwise(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: i % total))


def ranks(df: DataFrame, value: str, within: str) -> DataFrame:
    """(within, value, rank, n): the rank of each value among a group's rows, ties at their mean, and how many rows have it.

    A histogram of values is sorted by range over the tasks; sums over tasks, one row a group and task, say what is before a
    task's first value. No window holds more than a task's values of a group. Nulls have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(within, value).agg(F.count("*").alias("n"))
    sorted_ = stored(counts.repartitionByRange(within, value).withColumn("_part", F.spark_partition_id()))
    parts = sorted_.groupBy(within, "_part").agg(F.sum("n").alias("_n"))
    begins = parts.select(within, "_part", F.coalesce(F.sum("_n").over(W.partitionBy(within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy(within, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sorted_.withColumn("_inside", inside).join(begins.withColumnRenamed(within, "_within"), (F.col(within).eqNullSafe(F.col("_within"))) & (sorted_["_part"] == begins["_part"]))
    return placed.select(within, value, (F.col("_before") + F.col("_inside") + (F.col("n") + 1) / 2.0).alias("rank"), "n")


def rank_correlation(df: DataFrame, x: str, y: str, within: str) -> DataFrame:
    """(within, n, rho): rank correlation of two columns a group, from the rows where both are there; null without two rows or
    without variance. Rows of equal values are one with a weight."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(within, x, y).agg(F.count("*").alias("w"))
    rank_of = lambda c, name: ranks(both, c, within).select(F.col(within).alias(f"_{name}_g"), F.col(c).alias(f"_{name}_v"), F.col("rank").alias(name))
    met = pairs.join(rank_of(x, "rx"), F.col(within).eqNullSafe(F.col("_rx_g")) & (F.col(x) == F.col("_rx_v"))).join(rank_of(y, "ry"), F.col(within).eqNullSafe(F.col("_ry_g")) & (F.col(y) == F.col("_ry_v")))
    total = lambda e: F.sum(F.col("w") * e)
    rx, ry, n = F.col("rx"), F.col("ry"), F.sum("w")
    top = n * total(rx * ry) - total(rx) * total(ry)
    low = F.sqrt((n * total(rx * rx) - total(rx) * total(rx)) * (n * total(ry * ry) - total(ry) * total(ry)))
    return met.groupBy(within).agg(n.alias("n"), F.when(n >= 2, F.round(F.try_divide(top, low), 6)).alias("rho"))
