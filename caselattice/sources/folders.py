"""Folders and small files in the store that driver and executors share, reached through Hadoop's file systems alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; unset, a new one of this machine where the master is local, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df and reads it again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries; none if it is not there."""
    there, system = _file_system(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(there)) if system.exists(there) else []


def read_text(spark: SparkSession, path: str) -> str:
    there, system = _file_system(spark, path)
    stream = system.open(there)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    there, system = _file_system(spark, path)
    system.delete(there, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a whole file of that name if none is there; False if one is. Of several callers at once one succeeds: a local file
    is hard-linked to its name, elsewhere it is renamed without overwriting, which the store must do atomically."""
    there, system = _file_system(spark, path)
    draft, _ = _file_system(spark, f"{there.getParent().toString()}/.draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    try:
        if system.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(there), local(draft))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, there, options)
        return True
    except Exception as refused:
        if "AlreadyExists" in str(refused):
            return False
        raise
    finally:
        system.delete(draft, False)
