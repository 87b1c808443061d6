"""Set-similarity joins, ranks, subset numbers, frozen tables and numbered lines against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from caselattice.functions import scalar
from caselattice.operators import lexical, sampling
from caselattice.sources import files, frozen


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_overlapping_sets_equal_all_pairs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6))}"
    some = lambda n: sorted({word() for _ in range(n)})
    texts = {i: some(rng.choice([0, 1, 2, 5, 20, 60])) for i in range(120)}
    items = {i: some(rng.choice([0, 1, 4, 10, 30])) for i in range(40)}
    for i in range(0, 40, 3):
        held = texts[i] + [f"n{k}" for k in range(len(texts[i]) // 4)]
        items[i] = rng.sample(held, len(held))
    want = set()
    for (t, a), (i, b) in itertools.product(texts.items(), items.items()):
        if a and b and len(set(a) & set(b)) / min(len(a), len(b)) >= 0.8:
            want.add((t, i, round(len(set(a) & set(b)) / min(len(a), len(b)), 9)))
    df = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, tokens array<string>")
    got = [(r.text_id, r.item_id, round(r.overlap, 9)) for r in lexical.overlapping(df(texts, "text_id"), df(items, "item_id"), 0.8).collect()]
    assert set(got) == want and len(got) == len(want) > 30
    assert lexical.overlapping(df(texts, "text_id").limit(0), df(items, "item_id")).count() == lexical.overlapping(df(texts, "text_id"), df(items, "item_id").limit(0)).count() == 0


def test_ranks_with_ties_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 2, 3, rng.randint(4, 90)])) for _ in range(600)]
    got = {(r.g, r.v): (r["rank"], r.n) for r in sampling.ranks(spark.createDataFrame(rows, "g string, v int"), "v", "g").collect()}
    want = {}
    for g in ("a", "b", None):
        values = sorted(v for x, v in rows if x == g and v is not None)
        for v in set(values):
            want[g, v] = (values.index(v) + (values.count(v) + 1) / 2, values.count(v))
    assert got == want


def test_rank_correlation_of_odd_groups(spark):
    rows = [("one", 1, 1), ("flat", 1, 5), ("flat", 2, 5), ("up", 1, 1), ("up", 2, 2), ("up", 2, 3), ("down", 1, 3), ("down", 2, 2), ("down", None, 9)]
    got = {r.g: (r.n, r.rho) for r in sampling.rank_correlation(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", "g").collect()}
    assert got == {"one": (1, None), "flat": (2, None), "up": (3, 0.866025), "down": (2, -1.0)}


def test_subsets_by_their_numbers(spark):
    for k, least in ((1, 1), (3, 2), (5, 3), (7, 1)):
        want = [list(c) for n in range(least, k + 1) for c in itertools.combinations(range(1, k + 1), n)]
        df = spark.range(len(want)).select(F.col("id"), F.lit(k).alias("k"), F.lit(least).alias("least"))
        got = df.select("id", sampling.subset_at(F.col("k"), F.col("least"), F.col("id")).alias("s"), sampling.subsets(F.col("k"), F.col("least")).alias("n")).orderBy("id").collect()
        assert [r.s for r in got] == want and got[0].n == len(want)
    last = spark.range(1).select(sampling.subset_at(F.lit(60), F.lit(30), F.lit(math.comb(60, 30) - 1).cast("long")).alias("s")).first().s
    assert last == list(range(31, 61))


def test_unique_numbers(spark):
    df = spark.range(300).select("id", (F.col("id") % 5 + 1).alias("total"))
    for r in df.select("total", sampling.unique_numbers(3, F.col("total"), lambda i: scalar.draw(F.lit("t"), F.col("id"), F.lit(i))).alias("x")).collect():
        assert all(0 <= x < r.total for x in r.x) and len(r.x) == 3 and len(set(r.x)) == min(3, r.total)


def test_frozen_tables_compare_only_what_differs(spark, tmp_path):
    rows = [(i, f"v{i % 7}") for i in range(400)] + [(9, "v2")] * 2 + [(None, None)]
    df = spark.createDataFrame(rows, "i long, v string")
    path = str(tmp_path / "frozen")
    frozen.freeze_or_verify(df, path, ["i"], 32)
    frozen.freeze_or_verify(df.repartition(7).select("i", "v"), path, ["i"])
    assert frozen.root(frozen.digests(df, ["i"], 32)) == frozen.root(frozen.digests(df.orderBy(F.desc("i")), ["i"], 32)) != frozen.root(frozen.digests(df.limit(5), ["i"], 32))
    changed = df.withColumn("v", F.when(F.col("i") == 5, "new").otherwise(F.col("v"))).where("i IS NULL OR i <> 9").union(spark.createDataFrame([(9, "v2")], df.schema))
    got = sorted((r.side, r.i, r.v) for r in frozen.differences(changed, path, ["i"]).collect())
    assert got == [("frozen", 5, "v5"), ("frozen", 9, "v2"), ("frozen", 9, "v2"), ("new", 5, "new")]
    with pytest.raises(ValueError, match="differs"):
        frozen.freeze_or_verify(changed, path, ["i"])


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f'{{"i":{i}}}' if i % 50 else ("" if i % 100 else "[1]") for i in range(5000)]
    (tmp_path / "in").mkdir()
    for name, some in (("a", lines), ("b", lines[:7])):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(some) + "\n", "utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        found = files.numbered_lines(spark, str(tmp_path / "in"))
        assert found.select("file", "line", "text").rdd.getNumPartitions() >= 1
        rows = {(r.file.rsplit("/", 1)[1], r.line): r.text for r in found.collect()}
        splits = spark.read.option("lineSep", "\n").text(str(tmp_path / "in")).select("_metadata.file_block_start").distinct().count()
        bad = sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in files.malformed_lines(spark, str(tmp_path / "in")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert splits > 5 and rows == {("a.jsonl", i + 1): x for i, x in enumerate(lines)} | {("b.jsonl", i + 1): x for i, x in enumerate(lines[:7])}
    assert bad == sorted([("a.jsonl", i + 1, "[1]") for i in range(0, 5000, 100)] + [("b.jsonl", 1, "[1]")])


def test_reasoning_diagnostics(spark):
    given = [("A, B and C or D.", "B"), ("Á A_ bA don't x--y --", "A"), ("", "A"), ("A B C D", "E"), (None, "A"), ("D", None)]
    df = spark.createDataFrame(given, "t string, a string").select(scalar.reasoning_diagnostics(F.col("t"), F.col("a")).alias("d"))
    assert [tuple(r.d) for r in df.collect()] == [(6, True, True), (5, False, False), (0, False, False), (4, True, False), (None, None, None), (1, False, False)]
