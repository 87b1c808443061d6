"""Logs with several writers, their versions, and the round barrier as a stream."""

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Row
from pyspark.sql import functions as F

from caselattice.operators import debate
from caselattice.sources import folders
from caselattice.streaming import rounds
from caselattice.streaming.keyed_log import KeyedLog

SHAPE = "a long, b string, v long, phase string"


def log_at(spark, tmp_path, buckets=4):
    return KeyedLog(spark, str(tmp_path / "log"), SHAPE, ["a", "b"], buckets)


def rows(spark, *given):
    return spark.createDataFrame([(*r, None) for r in given], SHAPE)


def held(log, number=None):
    return sorted((tuple(r)[:3] for r in log.read(number).collect()), key=repr)


def test_first_rows_win_and_nulls_are_keys(spark, tmp_path):
    log = log_at(spark, tmp_path)
    assert held(log) == [] and log.version().number == 0
    log.append(rows(spark, (1, "x", 9), (1, "x", 2), (None, "x", 5), (1, None, 6)), order="v")
    log.append(rows(spark, (1, "x", 0), (None, "x", 1), (2, "y", None), (2, "y", 7)), order="v")
    assert held(log) == sorted([(1, "x", 2), (None, "x", 5), (1, None, 6), (2, "y", 7)], key=repr)


def test_writers_at_once_add_no_key_twice(spark, tmp_path):
    log = log_at(spark, tmp_path)
    batches = [(f"w{i}", rows(spark, *[(k, "x", i) for k in range(i, 40)])) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda b: log.append(b[1], writer=b[0], batch_id=0), batches))
    assert sorted(k for k, _, _ in held(log)) == list(range(40)) and log.version().number == 4
    for writer, batch in batches:
        log.append(batch.withColumn("a", F.col("a") + 100), writer=writer, batch_id=0)
    assert log.version().number == 4 and log.version().batches == {f"w{i}": 0 for i in range(4)}


def test_one_of_many_publishes(spark, tmp_path):
    path = str(tmp_path / "versions" / "1.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: folders.publish(spark, path, f"text {i}"), range(16)))
    assert won.count(True) == 1 and folders.read_text(spark, path) == f"text {won.index(True)}"
    assert [n for n in folders.names_in(spark, str(tmp_path / "versions")) if n.startswith(".draft")] == []


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    log = log_at(spark, tmp_path)
    first = log.append(rows(spark, *[(k, "x", k) for k in range(20)]))
    reader = log.read()
    log.drop_failed(F.col("v") % 2 == 0)
    log.append(rows(spark, (0, "x", 50), (1, "x", 51)))
    assert sorted(r.v for r in reader.collect()) == list(range(20)) == sorted(v for _, _, v in held(log, first.number))
    assert sorted(v for _, _, v in held(log)) == sorted([50, *range(1, 20, 2)])
    log.vacuum()
    assert sorted(v for _, _, v in held(log)) == sorted([50, *range(1, 20, 2)])
    assert len(folders.names_in(spark, f"{log.path}/versions")) == 1


def test_a_rewrite_meets_an_append(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.append(rows(spark, (1, "x", 1), (2, "x", 2)))
    met = []

    def change(found):
        if not met:
            met.append(log.append(rows(spark, (3, "x", 3), (4, "x", 4))))
        return found.where("v % 2 = 1")

    log.rewrite(change)
    assert held(log) == [(1, "x", 1), (3, "x", 3)]


def test_only_buckets_of_a_batch_are_read(spark, tmp_path):
    log = log_at(spark, tmp_path, buckets=64)
    log.append(rows(spark, *[(k, "x", k) for k in range(500)]))
    one = rows(spark, (7, "x", 1)).withColumn("_bucket", F.pmod(F.xxhash64("a", "b"), F.lit(64)).cast("int"))
    lacking = log._lacking(one, log.version().parts)
    assert lacking.count() == 0
    held = log._rows(log.version().parts, [one.first()._bucket])
    assert "_bucket#" in (plan := held._jdf.queryExecution().executedPlan().toString()).split("PartitionFilters: [")[1].split("]")[0] and held.count() < 50, plan


def test_backfill_and_missing(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.append(rows(spark, (1, "x", 1)))
    log.backfill(rows(spark, (1, "x", 5), (2, "x", 6)), "copied")
    assert sorted((r.a, r.v, r.phase) for r in log.read().collect()) == [(1, 1, None), (2, 6, "copied")]
    assert [r.a for r in log.missing(rows(spark, (2, "x", 0), (3, "x", 0))).collect()] == [3]


def test_rounds_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(6)
    calls = [(g, f"f{g % 2}", f"A{a}", r) for g in range(40) for r in range(4) for a in range(1, 4) if rng.random() < 0.9 for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(calls)
    df = spark.createDataFrame(calls, "item_id long, family string, agent_id string, round long")
    want = sorted(map(tuple, debate.open_rounds(df, 3).select("item_id", "family", "next_round").collect()))
    for stop in (None, 1, 3):
        got = rounds.replayed(df, str(tmp_path / f"rounds{stop}"), 3, batches=4, stop_after=stop)
        assert sorted(map(tuple, got.select("item_id", "family", "next_round").collect())) == want


def test_a_game_of_which_nothing_is_heard_stalls(spark, tmp_path):
    given = spark.createDataFrame([(1, "f0", "A1", 0), (1, "f0", "A2", 0)], "item_id long, family string, agent_id string, round long")
    given.write.parquet(str(tmp_path / "in"))
    kept = spark.conf.get(rounds._PROVIDER, None)
    try:
        stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
        query = rounds.opened_rounds(stream, 2, patience_ms=0).writeStream.outputMode("update").format("memory").queryName("stalls").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        for _ in range(60):
            if spark.table("stalls").where("stalled").count():
                break
            query.awaitTermination(1)
        query.stop()
        assert {(r.item_id, r.next_round, r.stalled) for r in spark.table("stalls").collect()} == {(1, 1, False), (1, 1, True)}
    finally:
        spark.conf.unset(rounds._PROVIDER) if kept is None else spark.conf.set(rounds._PROVIDER, kept)


def test_a_game_is_asked_and_told_once_a_batch():
    class Value:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, shape):
            return value

    value, game = Value(), rounds.RoundBarrier(2, None)
    game.init(Handle())
    calls = lambda *given: [Row(round=r, agent_id=a) for r, a in given]
    of = lambda *given: [tuple(x) for x in game.handleInputRows((7, "f"), iter(calls(*given)), None)]
    assert of((1, "a"), (1, "b"), (0, "a"), (0, "a"), (0, None), (None, "a")) == [(7, "f", 0, False)]
    assert of((0, "b")) == [(7, "f", 2, False)] and of((0, "c"), (2, "a")) == []
    assert value.calls == ["get", "update"] * 3 and value.held == (2, '[[2, "a"]]')


def test_a_log_is_not_broadcast(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.append(rows(spark, *[(k, "x", 0) for k in range(50)]))
    jobs = rows(spark, *[(k, "x", 0) for k in range(60)])
    bucketed = jobs.withColumn("_bucket", F.pmod(F.xxhash64("a", "b"), F.lit(4)).cast("int"))
    for lacking in (log.missing(jobs), log._lacking(bucketed, log.version().parts)):
        assert sorted(r.a for r in lacking.collect()) == list(range(50, 60))
        assert "Broadcast" not in lacking._jdf.queryExecution().executedPlan().toString()


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        log = log_at(spark, tmp_path, buckets=1)
        log.append(spark.range(20_000, numPartitions=4).select(F.col("id").alias("a"), F.lit("x").alias("b"), "id", F.lit("p").alias("phase")).toDF("a", "b", "v", "phase"))
        assert log.read().agg(F.count("*"), F.countDistinct("a")).first()[:] == (20_000, 20_000)
        assert len(list((tmp_path / "log" / "rows").rglob("*.parquet"))) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
