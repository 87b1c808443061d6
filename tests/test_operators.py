import hashlib
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from caselattice.functions import answers, draws, scalar
from caselattice.operators import debate, diagnostics, matrix, runs, validation
from caselattice.plans.registry import ORACLES, QUERIES
from caselattice.sources import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple(repr(round(x, 9) + 0.0 if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    cur = duck.execute(ORACLES[name])
    assert sorted(x[0] for x in cur.description) == columns
    order = [[x[0] for x in cur.description].index(c) for c in columns]
    assert canonical(got.select(*columns).collect()) == canonical([r[i] for i in order] for r in cur.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def item_frames(spark):
    items = spark.createDataFrame([(1, [(i, f"C{i}", f"a{i}", True) for i in range(1, 12)])], "item_id int, constraints array<struct<pos:int,constraint_id:string,attribute:string,required_value:boolean>>")
    held = {f"a{i}": i not in (2, 10) for i in range(1, 12)}
    return items, spark.createDataFrame([(1, "A", held), (1, "B", dict.fromkeys(held, True)), (1, "C", {"a1": True})], "item_id int, label string, attributes map<string,boolean>")


def test_signatures_follow_the_order_of_constraints(spark):
    items, candidates = item_frames(spark)
    got = {r.label: r.signature for r in matrix.violation_signatures(candidates, items).collect()}
    assert got["A"] == ["C2", "C10"] and got["B"] == []
    cells = matrix.constraint_matrix(candidates, items)
    assert cells.filter("satisfied IS NULL").count() == 10
    # C has one of eleven attributes: what it lacks is not satisfied.
    assert got["C"] == [f"C{i}" for i in range(2, 12)]
    whole = matrix.item_signatures(candidates, items).first()
    assert (whole.gold, whole.valid, whole.wrong) == ("B", 1, [2, 10])
    assert matrix.missing_attributes(candidates, items).filter("label = 'C'").count() == 10


def test_tampering_is_found(spark):
    df = spark.createDataFrame([(1, 4, True), (2, 3, None), (3, 4, False)], "item_id int, labels int, sound boolean")
    found = validation.violations(df, [("labels", F.col("labels") == 4), ("sound", F.col("sound"))])
    assert sorted((r.item_id, r.rule) for r in found.collect()) == [(2, "labels"), (2, "sound"), (3, "sound")]
    assert {r.item_id: r.rule for r in validation.first_failures(found).collect()} == {2: "labels", 3: "sound"}


def test_ties_have_no_majority(spark):
    rows = [(1, "f", "A1", 0, "A"), (1, "f", "A2", 0, "B"), (1, "f", "A3", 0, None), (1, "f", "A1", 1, "C"), (1, "f", "A2", 1, "C"), (1, "f", "A3", 1, "C"), (2, "f", "A1", 0, None)]
    got = {(r.item_id, r.round): (r.majority, r.majority_size, r.consensus, r.n_invalid) for r in debate.majorities(spark.createDataFrame(rows, "item_id int, family string, agent_id string, round int, answer string")).collect()}
    assert got == {(1, 0): (None, 1, False, 1), (1, 1): ("C", 3, True, 0), (2, 0): (None, 0, False, 1)}


@pytest.mark.parametrize(
    "raw,answer,source",
    [
        ('{"answer": "B", "reasoning": "r", "confidence": 0.5}', "B", "strict_json"),
        ('{"answer": "option c", "reasoning": "{x}"}', "C", "strict_json"),
        ('{"answer": "A."}', None, "none"),
        ('text {"answer": "A", "reasoning": "a } brace"} more', "A", "embedded_json"),
        ('{"answer": "A"} {"answer": "B"}', None, "conflicting_answers"),
        ("THE FINAL ANSWER IS option d", "D", "explicit_final_answer"),
        ("I like Option B", None, "none"),
        (" c ", "C", "bare_answer"),
        ('{"answer": 1}', None, "none"),
        ("", None, "none"),
        ('say {"x": {"y": 1}, "answer": "D"} so', "D", "embedded_json"),
        ('set {A and {"reasoning": "B"}', None, "none"),
        ("A\n", "A", "bare_answer"),
        ("\n\tB ", "B", "bare_answer"),
        ('{"answer": "A", "reasoning": "r", "confidence": 1}] junk', "A", "embedded_json"),
        ('{"answer": "A"}, "<end of the response>"], [1', "A", "embedded_json"),
        ('{"answer": "B", "answer": "C", "reasoning": "", "confidence": NaN}', "C", "strict_json"),
        ('[{"answer": "D"}]', "D", "embedded_json"),
        ('{"answer": ["A"]}', None, "none"),
        ("1, 2", None, "none"),
        ('The 5" one: {"answer": "C"}', "C", "malformed_json_answer_field"),
        ("prose\nFinal answer = candidate a, surely", "A", "explicit_final_answer"),
    ],
)
def test_calibration_contract(spark, raw, answer, source):
    got = spark.createDataFrame([(raw,)], "raw string").select(answers.parse_calibration(F.col("raw")).alias("p")).first().p
    assert (got.answer, got.source) == (answer, source)


def test_screening_contract_takes_mentions(spark):
    given = ["I like Option B", '{"answer": "A.", "confidence": "0.4"}', '{"answer": "A", "confidence": 7}', "nothing", None]
    got = [r.p for r in spark.createDataFrame([(x,) for x in given], "raw string").select(answers.parse_screening(F.col("raw")).alias("p")).collect()]
    assert [(p.answer, p.parse_success) for p in got] == [("B", False), ("A", True), ("A", False), (None, False), (None, False)]


@pytest.mark.parametrize(
    "raw,answer,confidence,success,error",
    [
        ("A\n", "A", None, False, answers.NO_OBJECT),
        ('The 5" one: {"answer": "C", "confidence": 0.8}', "C", 0.8, True, None),
        ('{"reasoning": "Option B", "confidence": 0.5}', "B", 0.5, False, answers.BAD_ANSWER),
        ('{"answer": "a.", "confidence": true}', "A", 1.0, True, None),
        ('{"answer": "A", "confidence": 1.5}', "A", 1.5, False, answers.OUT_OF_RANGE),
        ('{"answer": "Q"}', None, None, False, f"{answers.BAD_ANSWER}; {answers.NO_CONFIDENCE}"),
        ('["Option C"]', "C", None, False, answers.NOT_OBJECT),
        ("{'answer': 'A'}", None, None, False, answers.NO_DECODE),
        ('{"answer": "A", "answer": "B", "confidence": 0}', "B", 0.0, True, None),
        ('x {"answer": "D", "confidence": "0.25"} {"answer": "A"}', "D", 0.25, True, None),
    ],
)
def test_screening_contract(spark, raw, answer, confidence, success, error):
    got = spark.createDataFrame([(raw,)], "raw string").select(answers.parse_screening(F.col("raw")).alias("p")).first().p
    assert (got.answer, got.confidence, got.parse_success, got.parse_error) == (answer, confidence, success, error)


def test_followup_contract(spark):
    names = ["Ann Lee", "Bo", "Cy", "Di"]
    given = ['{"answer": "ann lee", "reasoning": "r", "confidence": 0.5}', '{"answer": "b", "reasoning": "r", "confidence": 0.5}', '{"answer": "B", "reasoning": "r", "confidence": 0.5}', "Answer: Bo.", "Answer: A\nAnswer: Bo", "Bo", None]
    df = spark.createDataFrame([(x, names) for x in given], "raw string, names array<string>").withColumn("s", answers.salvage(F.col("raw")))
    df = df.withColumns({"base": answers.parse_calibration(F.col("raw"), F.col("s")), "map": answers.name_map(F.col("names"))})
    got = [r.p for r in df.select(answers.parse_followup(F.col("raw"), F.col("map"), F.col("base"), F.col("s")).alias("p")).collect()]
    assert [p.answer for p in got] == ["A", "B", "B", "B", None, None, None]
    assert [p.compliant for p in got] == [False, False, True, False, False, False, False]
    assert got[4].source == "conflicting_answers" and got[4].candidates == ["A", "B"] and got[0].name_used
    odd = spark.createDataFrame([(["a", "A", "b", "c"],), (["a", " ", "b", "c"],), (names,)], "names array<string>")
    assert [r.m is None for r in odd.select(answers.name_map(F.col("names")).alias("m")).collect()] == [True, True, False]


def test_open_rounds_stop_at_the_first_gap(spark):
    rows = [(1, "f", a, r) for r in (0, 1) for a in ("A1", "A2", "A3")] + [(2, "f", "A1", 0)] + [(2, "f", a, 1) for a in ("A1", "A2", "A3")]
    got = {r.item_id: r.next_round for r in debate.open_rounds(spark.createDataFrame(rows, "item_id int, family string, agent_id string, round int"), 3).collect()}
    assert got == {1: 2, 2: 0}


def test_positions_across_blocks(spark):
    ids = [3, 5, 9, 10, 11, 40, 41, 99, 100, 250]
    df = spark.createDataFrame([(k, i) for k in "ab" for i in ids[: len(ids) - (k == "b")]], "key string, id long")
    got = sorted((r.key, r.id, r.pos, r.size) for r in runs.placed(df, "key", "id", block=4).collect())
    assert got == [(k, i, p, len(ids) - (k == "b")) for k in "ab" for p, i in enumerate(ids[: len(ids) - (k == "b")])]


def test_balanced_objects(spark):
    given = ['a {"x": "}{"} b {"y": {"z": 1}} c {', '{"open": "no end}', None, "}{}"]
    got = [r.o for r in spark.createDataFrame([(x,) for x in given], "raw string").select(answers.json_objects(F.col("raw")).alias("o")).collect()]
    assert got == [['{"x": "}{"}', '{"y": {"z": 1}}'], [], [], ["{}"]]


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([("m", 1.0, 3.0), ("m", 1.0, 1.0), ("m", 2.0, 2.0), ("z", 5.0, 5.0), ("z", 5.0, 6.0)], "g string, x double, y double")
    ranked = df.withColumn("rx", runs.average_ranks(df, "x", "g")).withColumn("ry", runs.average_ranks(df, "y", "g"))
    assert sorted(r.rx for r in ranked.filter("g = 'm'").collect()) == [1.5, 1.5, 3.0]
    got = {r.g: r.rho for r in ranked.groupBy("g").agg(runs.spearman(F.col("rx"), F.col("ry")).alias("rho")).collect()}
    assert got == {"m": 0.0, "z": None}


def test_capacity_counts_subsets(spark):
    want = {k: sum(1 for s in range(-(-k // 2), k + 1) for _ in itertools.combinations(range(k), s)) for k in range(1, 8)}
    got = spark.range(1, 8).select(F.col("id").cast("int").alias("k")).withColumn("n", validation.signature_capacity(F.col("k")))
    assert {r.k: r.n for r in got.collect()} == want


def test_draws_are_fixed(spark):
    df = spark.range(50)
    one = [r.d for r in df.select(scalar.draw(F.lit(1), F.col("id")).alias("d")).collect()]
    assert one == [r.d for r in df.select(scalar.draw(F.lit(1), F.col("id")).alias("d")).collect()] and len(set(one)) > 45
    assert random.Random(0).random() < 1 and all(0 <= d < 2**32 for d in one)


def test_words_in_a_run_of_a_megabyte(spark):
    df = spark.createDataFrame([("ab-" * 350_000 + "x",), ("a--b c'd-e f-",), ("",), (None,)], "text string")
    assert [r.n for r in df.select(scalar.word_count(F.col("text")).alias("n")).collect()] == [1, 4, 0, None]


def test_halves_are_rounded_as_sql_rounds_them(spark):
    """162.98 / 320 is 0.5093125 as a decimal, its product with a million just below a half."""
    values = [162.98 / 320, 50 / 256, 16.83 / 32, 1 / 128, 0.0, 1.0]
    want = [r for (r,) in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x, unnest(range(6)) AS i) ORDER BY i", [values]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", scalar.rounded(F.col("x")).alias("r")).collect()
    assert [r.r for r in sorted(rows)] == want


def test_pieces_of_a_shuffle_keep_their_size(spark, sf, monkeypatch):
    """Tasks grow in number with a table, not in size; cells of candidates need no join."""
    whole = [QUERIES[n](spark, sf).collect() for n in ("agg01_attribute_statistics", "str04_retried_log")]
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    rows = views.candidates(spark, sf)
    assert rows.rdd.getNumPartitions() == views.tasks_for(spark, sf, "lineitem") > 50
    assert "Join" not in matrix.cells(views.shaped_candidates(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert [sorted(QUERIES[n](spark, sf).collect()) for n in ("agg01_attribute_statistics", "str04_retried_log")] == [sorted(w) for w in whole]


def test_responses_are_parsed_in_pieces(spark, tmp_path):
    spark.range(120_000).select(F.col("id").alias("event_id"), F.lit('{"k": 3}').alias("props")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for made in (views.responses(spark, str(tmp_path)), views.followups(spark, str(tmp_path))):
        assert made.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("name", ["top02b_missed_attributes", "agg44_rotation_behaviour"])
def test_lines_are_read_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation [" in x for x in plan.splitlines()) == 1


def test_errors_in_one_pass_equal_those_in_two(spark):
    c = lambda *names: [(f"C{i + 1}", n) for i, n in enumerate(names)]
    rows = [(1, 1, c("x", "y", "x"), "A", "B", ["C1", "C3"]), (1, 2, c("x", "y", "x"), "A", "A", []), (2, 1, c("y"), "B", None, []), (2, 2, c("y"), "B", "C", ["C1"])]
    made = spark.createDataFrame(rows, "item_id long, run long, constraints array<struct<constraint_id:string,attribute:string>>, gold string, answer string, selected array<string>")
    got = diagnostics.attribute_errors_in(made, F.col("run") == 1, 2)
    want = diagnostics.attribute_errors(made.where("run = 1"), made, 2).select(got.columns)
    assert canonical(got.collect()) == canonical(want.collect()) and {r.attribute: r.n_violations for r in got.collect()} == {"x": 2, "y": 1}


def test_many_draws_equal_single_ones():
    prefixes = [p.encode() for p in ("", "17|view|0|", "17|view|12|", "é" * 27 + "|", "x" * 63, "y" * 130)]
    for start, stop in ((0, 120), (995, 1005)):
        found = {i: [] for i in range(len(prefixes))}
        for i, numbers in draws.drawer()(prefixes, start, stop):
            found[i] += numbers.tolist()
        assert found == {i: [int(hashlib.md5(p + str(d).encode()).hexdigest()[:8], 16) for d in range(start, stop)] for i, p in enumerate(prefixes)}


def test_resamples_in_ranges_equal_whole_ones(spark, monkeypatch):
    rows = [("m", i, 30, i % 3, 3) for i in range(30)] + [("n", i, 5, 1, 1 + i) for i in range(5)]
    made = spark.createDataFrame(rows, "m string, pos long, size long, top long, bottom long")
    whole = runs.cluster_bootstrap(made, "m", "top", "bottom", 40)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert " Join " not in plan  # a draw is no row that has to meet its cluster
    want = canonical(whole.collect())
    for name, value in (("BLOCK", 4), ("RANGE", 8), ("RESAMPLES", 7), ("DRAWS", 11)):
        monkeypatch.setattr(runs, name, value)
    assert canonical(runs.cluster_bootstrap(made, "m", "top", "bottom", 40).collect()) == want
