"""A log of one row a key that several writers append to, rewrite and read at once.

Rows lie in folders of Parquet files, divided into buckets by a hash of the key. A version is a small JSON file: the folders
that make up the log, and the last batch of each writer. A version is published by creating the file of the next number, which
one writer alone can do; who comes second looks at what the other added, drops the keys that it now has, and tries again. So
no key is added twice, and a batch that is run again adds nothing. A batch is compared with those buckets alone that its keys
fall in. A reader keeps the folders of the version that it began with: whatever is published meanwhile, it sees one whole
version. Folders that no version names any more are removed by `vacuum`.

A writer's batches have rising numbers, as those of a stream have. Rows of equal key within a batch: the least by `order`
is kept, nulls last, or without `order` any. A null in a key is a value like others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from caselattice.sources import folders

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Version:
    number: int
    parts: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def version(self, number: int | None = None) -> Version:
        """The version of that number, or the last one published; number 0 is the empty log."""
        if number is None:
            number = max((int(n[:-5]) for n in folders.names_in(self.spark, f"{self.path}/versions") if n.endswith(".json") and not n.startswith(".")), default=0)
        return Version(number, **json.loads(folders.read_text(self.spark, self._file(number)))) if number else Version(0)

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def _rows(self, parts: list[str], only: list[int] | None = None) -> DataFrame:
        """The rows of these folders with their bucket; `only`: of these buckets alone, so that no file of another is opened."""
        shape = StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], shape)
        found = self.spark.read.schema(shape).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{p}" for p in parts])
        return found if only is None else found.where(F.col(_BUCKET).isin(only))

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.version(number).parts).select(*self.schema.names)

    def _same_key(self, a: str, b: str) -> Column:
        found = F.col(f"{a}.{_BUCKET}") == F.col(f"{b}.{_BUCKET}")
        for k in self.keys:
            found = found & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return found

    def _lacking(self, rows: DataFrame, parts: list[str]) -> DataFrame:
        """rows whose keys these folders lack."""
        if not parts:
            return rows
        touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())
        return self._without(rows, self._rows(parts, touched))

    def _without(self, rows: DataFrame, held: DataFrame) -> DataFrame:
        # The files of a log are small for its rows: by their size it would be broadcast, and each task would hold all its keys.
        return rows.alias("n").join(held.hint("merge").alias("h"), self._same_key("n", "h"), "left_anti")

    def _write(self, rows: DataFrame) -> str:
        part = f"part={uuid.uuid4().hex}"
        # Large buckets are dealt to several tasks.
        rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/rows/{part}")
        return part

    def append(self, batch: DataFrame, order: str | None = None, writer: str | None = None, batch_id: int | None = None) -> Version:
        """Adds the rows whose keys the log lacks."""
        seen = self.version()
        if writer is not None and batch_id <= seen.batches.get(writer, -1):
            return seen
        bucketed = batch.select(*self.schema.names, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_BUCKET))
        row = F.struct(*[c for c in self.schema.names if c not in self.keys], F.col(_BUCKET))
        first = F.min_by(row, F.struct(F.col(order).isNull(), F.col(order))) if order else F.any_value(row)
        firsts = bucketed.groupBy(*self.keys).agg(first.alias("_row")).select(*[F.col(c) if c in self.keys else F.col("_row")[c].alias(c) for c in self.schema.names], F.col("_row")[_BUCKET].alias(_BUCKET))
        part = self._write(self._lacking(firsts, seen.parts))
        while True:
            batches = seen.batches if writer is None else {**seen.batches, writer: batch_id}
            next_ = Version(seen.number + 1, [*seen.parts, part], batches)
            if self._publish(next_):
                return next_
            now = self.version()
            if writer is not None and batch_id <= now.batches.get(writer, -1):
                return now
            # Another writer was first. What is new since then, or all after a rewrite, may have some of these keys.
            new = [p for p in now.parts if p not in seen.parts]
            part, seen = self._write(self._lacking(self._rows([part]), new)), now

    def _publish(self, version: Version) -> bool:
        return folders.publish(self.spark, self._file(version.number), json.dumps({"parts": version.parts, "batches": version.batches}))

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> Version:
        """Replaces the log by what `change` makes of it, as one version; `change` keeps the schema and one row a key. It is
        made again if another version was published meanwhile."""
        while True:
            seen = self.version()
            rows = change(self._rows(seen.parts).select(*self.schema.names)).select(*self.schema.names, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_BUCKET))
            next_ = Version(seen.number + 1, [self._write(rows)], seen.batches)
            if self._publish(next_):
                return next_

    def drop_failed(self, failed: Column) -> Version:
        """Without the rows for which `failed` holds, so that these keys can be run again."""
        return self.rewrite(lambda rows: rows.where(~F.coalesce(failed, F.lit(False))))

    def backfill(self, preflight: DataFrame, phase: str = "formal") -> Version:
        """Adds the preflight rows whose keys the log lacks, marked as of that phase."""
        return self.append(preflight.withColumn("phase", F.lit(phase)))

    def missing(self, jobs: DataFrame) -> DataFrame:
        """The jobs whose key the log lacks."""
        bucketed = jobs.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        return self._without(bucketed, self._rows(self.version().parts)).drop(_BUCKET)

    def follow(self, stream: DataFrame, checkpoint: str, writer: str, order: str | None = None) -> StreamingQuery:
        """Appends a stream's batches until none is left."""
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: self.append(batch, order, writer, n)).start()

    def vacuum(self, keep: int = 1) -> None:
        """Removes the folders and files of all but the last `keep` versions; nobody may be reading or writing these."""
        last = self.version().number
        kept = range(max(1, last - keep + 1), last + 1)
        live = {p for n in kept for p in self.version(n).parts}
        for part in folders.names_in(self.spark, f"{self.path}/rows"):
            if part.startswith("part=") and part not in live:
                folders.delete(self.spark, f"{self.path}/rows/{part}")
        for n in range(1, kept.start):
            folders.delete(self.spark, self._file(n))
