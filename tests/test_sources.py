import json

import pytest
from pyspark.sql import functions as F

from caselattice.sources import files
from caselattice.streaming import logs


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü", None), (2, None, ["x"])], "b int, a string, c array<string>")
    files.write_jsonl(df, f"{tmp_path}/x")
    lines = [x for p in tmp_path.glob("x/part-*") for x in p.read_text().splitlines()]
    assert sorted(lines)[0] == '{"a":"ü","b":1,"c":null}'
    assert sorted(files.read_jsonl(spark, f"{tmp_path}/x", "b int, a string, c array<string>").collect()) == sorted(df.collect())
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\n\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "b int").collect()


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "c.json").write_text('{\n "a": [1]\n}')
    (tmp_path / "l.json").write_text("[1]")
    assert files.load_json(spark, f"{tmp_path}/c.json") == {"a": [1]}
    with pytest.raises(ValueError):
        files.load_json(spark, f"{tmp_path}/l.json")
    files.write_csv(spark.createDataFrame([("k", [1, 2])], "k string, v array<int>"), f"{tmp_path}/csv")
    held = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert held.k == "k" and json.loads(held.v) == [1, 2]


def test_frozen_tables(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "i int, x string")
    files.write_or_verify(df, f"{tmp_path}/t", "i")
    files.write_or_verify(df.orderBy(F.desc("i")), f"{tmp_path}/t", "i")
    with pytest.raises(files.FrozenContentError):
        files.write_or_verify(df.withColumn("i", 1 - F.col("i")), f"{tmp_path}/t", "i")
    assert files.fingerprint(df) == files.fingerprint(df.orderBy(F.desc("i"))) != files.fingerprint(df.limit(1))


def test_keyed_logs(spark, tmp_path):
    log = spark.createDataFrame([(1, "m", None, 11, None, 1), (1, "m", 11, 11, "timeout", 2), (2, "m", 3, 33, "timeout", 3)], "item_id int, model string, run_id int, seed int, request_error string, seq int")
    keys = ["item_id", "model", "run_id"]
    assert sorted(map(tuple, files.completed_keys(log, keys).collect())) == [(1, "m", 11), (2, "m", 3)]
    assert [tuple(r) for r in files.completed_keys(log, keys, retry_failed=True).collect()] == [(1, "m", 11)]
    assert {(r.item_id, r.seq) for r in files.latest_records(log, ["item_id", "model"], "seq").collect()} == {(1, 2), (2, 3)}
    logs.drop_failed(log, f"{tmp_path}/kept")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 1
    logs.append_new(log, f"{tmp_path}/log", ["item_id"])
    logs.append_new(log.withColumn("item_id", F.col("item_id") + 1), f"{tmp_path}/log", ["item_id"])
    assert sorted(r.item_id for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2, 3]
    again = spark.createDataFrame([(8, 2, "later"), (8, 1, "first")], "item_id int, seq int, what string")
    logs.append_new(again, f"{tmp_path}/first", ["item_id"], order="seq")
    assert [r.what for r in spark.read.parquet(f"{tmp_path}/first").collect()] == ["first"]
    assert logs.backfill(log, spark.read.parquet(f"{tmp_path}/log"), ["item_id"]).count() == 0


def test_a_stream_is_appended_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i) for i in range(20)], "k int, v int")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        logs.follow(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["k"]).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]


def test_windowed_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    events = spark.read.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = logs.event_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM windowed").first().n == events.count()
