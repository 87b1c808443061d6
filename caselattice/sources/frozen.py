"""Frozen tables: written once with digests of their buckets, so that a later copy is checked by digests and only buckets that
differ are compared row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselattice.sources import folders

_DIGEST = ["n", "mixed", "total"]


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_row", F.sha2(row, 256))


def digests(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """(_bucket, n, mixed, total): each bucket's count, exclusive or and sum of its rows' digests. Digests of two tables' buckets
    merge into those of their union."""
    h = F.conv(F.left("_row", F.lit(15)), 16, 10).cast("long")
    return _bucketed(df, keys, buckets).groupBy("_bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("mixed"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def root(found: DataFrame) -> str:
    """One digest of a table of bucket digests, whose number does not grow with the rows."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", *_DIGEST))), lambda b: F.concat_ws(":", b["_bucket"], *[b[c] for c in _DIGEST]))
    return found.agg(F.sha2(F.array_join(lines, "|"), 256).alias("root")).first()["root"]


def freeze(df: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """Writes the table by buckets of its keys, and the buckets' digests beside it."""
    bucketed = _bucketed(df, keys, buckets).drop("_row")
    bucketed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    digests(df, keys, buckets).withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/digests")


def differences(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """(df's columns, side): rows of the frozen table that df lacks, `frozen`, and rows that only df has, `new`; repeated rows
    count. Buckets of equal digests are not read."""
    spark: SparkSession = df.sparkSession
    held = spark.read.parquet(f"{path}/digests")
    first = held.select("buckets").first()
    buckets = first["buckets"] if first else 1
    unlike = digests(df, keys, buckets).alias("a").join(held.alias("b"), "_bucket", "full").where(" OR ".join(f"NOT a.{c} <=> b.{c}" for c in _DIGEST))
    changed = [r["_bucket"] for r in unlike.select("_bucket").collect()]
    mine = _bucketed(df, keys, buckets).where(F.col("_bucket").isin(changed)).select(*df.columns)
    frozen = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{path}/rows").where(F.col("_bucket").isin(changed)).select(*df.columns)
    return frozen.exceptAll(mine).withColumn("side", F.lit("frozen")).unionByName(mine.exceptAll(frozen).withColumn("side", F.lit("new")))


def freeze_or_verify(df: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """Writes once; later calls must bring the same rows or fail with an example."""
    if not folders.names_in(df.sparkSession, f"{path}/digests"):
        freeze(df, path, keys, buckets)
        return
    found = differences(df, path, keys).first()
    if found is not None:
        raise ValueError(f"{path} is frozen and differs, as in {found.asDict()}")
