"""Queries over streams and logs that Spark derives from the tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from caselattice.plans.generated import STR05_SQL
from caselattice.plans.registry import query
from caselattice.sources import files, folders, frozen
from caselattice.sources import views as X
from caselattice.sources.views import RUN_SQL
from caselattice.streaming import rounds
from caselattice.streaming.keyed_log import KeyedLog

_KEYS = ["item_id", "model_alias", "run_id"]
_LOGGED = "item_id long, model_alias string, run_id long, answer string, request_error string, phase string"


def _runs(spark, sf):
    return X.runs(spark, sf).select(*_KEYS, "answer", "request_error", F.lit("formal").alias("phase"))


def _log(spark) -> KeyedLog:
    return KeyedLog(spark, folders.new_folder(spark, "log"), _LOGGED, _KEYS, buckets=16)


@query("str05_streamed_rounds", STR05_SQL)
def str05_stream(spark, sf):
    """The first round that is not whole, kept by a stream of calls in random order that fails after two batches and goes on
    from its checkpoint (STR-05)."""
    return rounds.replayed(X.calls(spark, sf), folders.new_folder(spark, "rounds"), 3, stop_after=2)


@query("str02_first_records", f"WITH {RUN_SQL} SELECT item_id, model_alias, run_id, answer, 1 AS n FROM runs")
def str02(spark, sf):
    """A log after two writers at once, each with half of the other's keys, and a batch that came twice (STR-01, STR-02, SNK-06)."""
    log, runs = _log(spark), _runs(spark, sf)
    batches = [("a", 0, runs.where("run_id < 3")), ("b", 0, runs.where("run_id > 1"))]
    with ThreadPoolExecutor(2) as both:
        list(both.map(lambda b: log.append(b[2], writer=b[0], batch_id=b[1]), batches))
    log.append(batches[0][2], writer="a", batch_id=0)
    return log.read().groupBy(*_KEYS).agg(F.first("answer").alias("answer"), F.count("*").cast("int").alias("n"))


@query("str01_streamed_jobs", f"WITH {RUN_SQL} SELECT item_id, model_alias, count(*) AS n_jobs FROM runs WHERE run_id = 2 GROUP BY item_id, model_alias")
def str01_stream(spark, sf):
    """The jobs that are left after a stream of runs has been appended to a log, a file a batch (STR-01)."""
    log, runs = _log(spark), _runs(spark, sf)
    done = folders.new_folder(spark, "runs")
    runs.where("run_id <> 2").repartition(3).write.parquet(done)
    stream = spark.readStream.schema(_LOGGED).option("maxFilesPerTrigger", 1).parquet(done)
    log.follow(stream, folders.new_folder(spark, "checkpoint"), "runner").awaitTermination()
    return log.missing(runs).groupBy("item_id", "model_alias").agg(F.count("*").alias("n_jobs"))


@query("str03_backfilled_log", f"WITH {RUN_SQL} SELECT model_alias, CASE WHEN run_id = 1 AND item_id % 2 = 0 THEN 'copied' ELSE 'formal' END AS phase, count(*) AS n FROM runs WHERE run_id > 1 OR item_id % 2 = 0 OR item_id % 3 = 0 GROUP BY 1, 2")
def str03(spark, sf):
    """Preflight runs that the formal log lacks, copied into it (STR-03)."""
    log, runs = _log(spark), _runs(spark, sf)
    log.append(runs.where("run_id > 1 OR (item_id % 3 = 0 AND item_id % 2 = 1)"))
    log.backfill(runs.where("(run_id = 1 AND item_id % 2 = 0) OR run_id = 2"), "copied")
    return log.read().groupBy("model_alias", "phase").agg(F.count("*").alias("n"))


@query("str04_retried_log", f"WITH {RUN_SQL} SELECT model_alias, count(*) AS n_before, count(*) FILTER (request_error IS NULL) AS n_after, count(*) FILTER (request_error IS NOT NULL) AS n_to_run FROM runs GROUP BY model_alias")
def str04(spark, sf):
    """A log without its failed requests, while a reader keeps the version before, and what is to be run again (STR-04)."""
    log, runs = _log(spark), _runs(spark, sf)
    before = log.read(log.append(runs).number)
    log.drop_failed(F.col("request_error").isNotNull())
    of = lambda df, name: df.groupBy("model_alias").agg(F.count("*").alias(name))
    found = of(before, "n_before").join(of(log.read(), "n_after"), "model_alias", "left").join(of(log.missing(runs), "n_to_run"), "model_alias", "left")
    return found.fillna(0)


@query("src01_malformed_lines", """WITH l AS (SELECT event_id, event_id // 1000 AS block, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line, event_id % 97 AS broken FROM events)
SELECT block, line, CASE broken WHEN 0 THEN '{"event_id":' || event_id WHEN 1 THEN '[' || event_id || ']' ELSE 'null' END AS text FROM l WHERE broken < 3""")
def src01(spark, sf):
    """Events written as lines, some of them broken, cut to something else or blank, and the lines that are no objects, with their
    places in their files (SRC-01)."""
    e = X.read(spark, sf, "events").select("event_id", F.expr("event_id div 1000").alias("block"))
    broken = F.col("event_id") % 97
    sound = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit("}"))
    text = F.when(broken == 0, F.concat(F.lit('{"event_id":'), F.col("event_id"))).when(broken == 1, F.concat(F.lit("["), F.col("event_id"), F.lit("]"))).when(broken == 2, "null").when(broken == 3, " ").otherwise(sound)
    path = folders.new_folder(spark, "lines")
    e.select("block", "event_id", text.alias("value")).repartition("block").sortWithinPartitions("block", "event_id").select("block", "value").write.partitionBy("block").text(path)
    found = files.malformed_lines(spark, path)
    return found.select(F.regexp_extract("file", "block=([0-9]+)", 1).cast("long").alias("block"), "line", "text")


@query("snk07_changed_rows", f"WITH {RUN_SQL} SELECT event_id, side, CASE WHEN side = 'new' THEN coalesce(answer, '') || '!' ELSE answer END AS answer FROM runs, (VALUES ('frozen'), ('new')) s(side) WHERE (event_id % 501 = 0) OR (event_id % 997 = 1 AND side = 'frozen')")
def snk07(spark, sf):
    """A frozen table against a copy with changed and missing rows (SNK-07, FLT-21, SCL-09)."""
    runs = X.runs(spark, sf).select("event_id", "item_id", "model_alias", "run_id", "answer")
    path = folders.new_folder(spark, "frozen")
    frozen.freeze(runs, path, ["event_id"])
    changed = runs.withColumn("answer", F.when(F.col("event_id") % 501 == 0, F.concat(F.coalesce("answer", F.lit("")), F.lit("!"))).otherwise(F.col("answer"))).where("event_id % 997 <> 1 OR event_id % 501 = 0")
    return frozen.differences(changed, path, ["event_id"]).select("event_id", "side", "answer")


@query("snk01_jsonl_round_trip", f"WITH {RUN_SQL} SELECT event_id, item_id, model_alias, answer, correct, confidence FROM runs")
def snk01(spark, sf):
    """Runs written as JSON lines and read again by an explicit schema (SNK-01, SNK-02, SRC-01)."""
    runs = X.runs(spark, sf).select("event_id", "item_id", "model_alias", "answer", "correct", "confidence")
    path = folders.new_folder(spark, "jsonl")
    files.write_jsonl(runs, path)
    return files.read_jsonl(spark, path, runs.schema)


@query("snk04_cell_csv", f"WITH {RUN_SQL} SELECT cl, il, count(*) AS n_runs, count(*) FILTER (correct) AS n_correct, '[\"' || string_agg(DISTINCT model_alias, '\",\"' ORDER BY model_alias) || '\"]' AS models FROM runs GROUP BY cl, il")
def snk04(spark, sf):
    """Statistics by cell written as CSV, arrays as JSON, and read again (SNK-04, SNK-05)."""
    cells = X.runs(spark, sf).groupBy("cl", "il").agg(F.count("*").alias("n_runs"), F.count_if("correct").alias("n_correct"), F.array_sort(F.collect_set("model_alias")).alias("models"))
    path = folders.new_folder(spark, "csv")
    files.write_csv(cells, path)
    return spark.read.schema("cl string, il string, n_runs long, n_correct long, models string").option("header", True).option("escape", '"').csv(path)
