"""Connected components by alternating stars, with built-in functions.

Each round points every node at the least id among itself and its neighbours, first over the larger neighbours, then over
the smaller; paths become stars in about log rounds. Edges are kept in a stored table between rounds. A centre that many
larger nodes are linked to has its edges dealt to SALTS parts by their other end: each part sends its least id only, and
learns the centre's, so such a node is never read by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.llm.names import unused
from caselattice.llm.storage import discard, stored

SALTS = 32


def with_least(df: DataFrame, key: str, by: str, value: Column, out: str) -> DataFrame:
    """df with the least value of each key as `out`. Rows of a key are dealt to parts by a hash of the column `by`."""
    (part,) = unused(df, "_part")
    salted = df.withColumn(part, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    least = salted.groupBy(key, part).agg(F.min(value).alias(out))
    # At most SALTS rows a key.
    told = least.select(F.col(key).alias("_key"), F.col(part).alias("_told"), F.min(out).over(W.partitionBy(key)).alias(out))
    return salted.join(told, (F.col(key) == F.col("_key")) & (F.col(part) == F.col("_told"))).select(*df.columns, out)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = with_least(both, "u", "v", F.col("v"), "m").filter("v > u")
    return known.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v")


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.withColumnRenamed("m", "v").unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs: (node, root) for every node of an edge, root the least id of its component.

    Loops and nulls link nothing; without edges the result is empty."""
    usable = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = stored(usable.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    while (sign := now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()) != was:
        was, before = sign, now
        now = stored(_small(_large(before)))
        discard(before)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
