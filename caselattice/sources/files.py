"""JSON lines, JSON and CSV: readers with explicit schemas, writers, digests, configurations and frozen files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FrozenContentError(ValueError):
    """A frozen table differs from what would be written now."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line, blank lines skipped; a line that is no such object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of text files, numbered from 1 within each file, blank ones too. A file is read by as many
    tasks as it has splits: lines are counted a split, splits summed up a file, and a line's place in its split added."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    splits = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "_at", "_first", ahead.alias("_ahead"))
    return lines.join(starts, ["file", "_at"]).select("file", (F.col("_ahead") + F.col("_id") - F.col("_first") + 1).alias("line"), "text")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of lines that are neither blank nor a JSON object, in order: what to look at after a failed read."""
    kind = F.schema_of_variant(F.try_parse_json("text"))
    return numbered_lines(spark, path).filter((F.trim("text") != "") & ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))).orderBy("file", "line")


def load_json(spark: SparkSession, path: str) -> dict:
    """A configuration: one JSON object, however many lines it takes, from any path that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    held = json.loads(rows[0]["value"])
    if not isinstance(held, dict):
        raise ValueError(f"{path} does not hold an object")
    return held


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns by name, nulls written."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """With a header, quotes doubled within quotes; arrays, maps and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    """One indented object with sorted keys, as one file at any path that Spark writes."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray((json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def write_cells_csv(df: DataFrame, path: str, cell: str = "cell", mode: str = "errorifexists") -> None:
    """Cell statistics as CSV: the cell's name in its three parts, columns of structs, maps and arrays left out."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    parts = F.split(cell, "__")
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != cell and not isinstance(f.dataType, nested)]
    df.select(*[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("cl", "ds", "il"))], *rest).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def entity_json(df: DataFrame, *columns: str, out: str = "entity") -> DataFrame:
    """Adds the columns as one JSON object without those that are null, as entities are written."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def canonical_hash(data: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files at a path, by their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def model_alias(config: dict) -> str:
    """The alias of a model's configuration."""
    alias = config.get("alias") or config.get("model_alias")
    if not alias:
        raise ValueError("a model needs an alias or model_alias")
    return str(alias)


def public_config(config: dict) -> dict:
    """A configuration without keys of services, at any depth."""
    if isinstance(config, dict):
        return {k: public_config(v) for k, v in config.items() if k != "api_key"}
    return [public_config(x) for x in config] if isinstance(config, list) else config


def experiment_config(config: dict, name: str) -> dict:
    """One experiment's configuration over what all share."""
    experiments = config.get("experiments", {})
    if name not in experiments:
        raise ValueError(f"no experiment is named {name}")
    return {k: v for k, v in config.items() if k != "experiments"} | dict(experiments[name])


def assert_compatible(manifest: dict, expected: dict, keys: tuple[str, ...] = ("experiment_id", "fingerprints")) -> None:
    """A log may only go on under the experiment and the fingerprints that it was begun with."""
    unlike = [k for k in keys if manifest.get(k) != expected.get(k)]
    if unlike:
        raise FrozenContentError(f"the manifest differs in {', '.join(unlike)}")


def latest_records(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row of the greatest order value."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def completed_keys(df: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """Distinct keys of the log; with retry_failed those of failed requests are still open. A missing run_id is the seed."""
    run = F.coalesce(F.col("run_id"), F.col("seed")) if {"run_id", "seed"} <= set(df.columns) else None
    named = df if run is None else df.withColumn("run_id", run)
    return (named.filter(F.col("request_error").isNull()) if retry_failed else named).select(*keys).distinct()


def write_or_verify(df: DataFrame, path: str, order: str) -> None:
    """Writes a table once; later calls must bring the same rows, `order` included, or fail."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df.write.parquet(path)
        return
    held = spark.read.parquet(path)
    if sorted(held.columns) != sorted(df.columns) or order not in held.columns:
        raise FrozenContentError(f"{path} has other columns")
    if held.select(*df.columns).exceptAll(df).limit(1).count() or df.exceptAll(held.select(*df.columns)).limit(1).count():
        raise FrozenContentError(f"{path} has other rows")


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: of the sorted digests' running sums, not of collected rows."""
    one = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    row = df.select(one.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).select(F.sha2(F.concat_ws("|", "n", F.coalesce(F.col("x"), F.lit(0)), F.coalesce(F.col("s"), F.lit(0))), 256).alias("d"))
    return row.first()["d"]
