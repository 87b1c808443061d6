import hashlib
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from caselattice.functions import scalar
from caselattice.operators import contracts, generation, pools, translations, validation
from caselattice.plans import contracts as plans
from caselattice.plans.registry import ORACLES, QUERIES
from caselattice.sources import catalog, files


@pytest.fixture(scope="module")
def pool(spark):
    return pools.pool(spark, 4, 7).cache()


def test_pools_hold_their_contracts(spark, pool):
    assert contracts.violations(pool, contracts.v4_rules()).count() == 0
    assert contracts.violations(pools.closeness_pool(spark, 60, 3), contracts.v3_rules()).count() == 0
    assert contracts.balance(pool).filter("NOT sound").count() == 0
    lame = contracts.balance(pool.filter("gold != 'A'"))
    assert {(r.level, r.n) for r in lame.filter("NOT sound").collect()} >= {("A", 0)}


def test_draws_depend_on_the_seed_alone(spark, pool):
    key = lambda df: sorted((r.item_id, r.question) for r in df.select("item_id", "question").collect())
    assert key(pool) == key(pools.pool(spark, 4, 7).repartition(3)) != key(pools.pool(spark, 4, 8))


def test_lexical_audit_against_a_loop(spark, pool):
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    pairs = []
    for r in pool.select("constraints", "entities").collect():
        by = {c.attribute: c.text for c in r.constraints}
        pairs += [(words(f.text), words(by[f.attribute])) for e in r.entities.values() for f in e.displayed]
    shares = [len(set(a) & set(b)) / min(len(set(a)), len(set(b))) for a, b in pairs]
    got = pools.lexical_audit(pool).first()
    assert (got.n_pairs, got.n_exact, got.n_high) == (len(pairs), sum(a == b for a, b in pairs), sum(x >= 0.8 for x in shares))
    assert got.mean_overlap == pytest.approx(sum(shares) / len(shares), abs=1e-6)


def test_facts_that_are_not_shown(spark, pool):
    want = []
    for r in pool.select("item_id", "constraints", "entities").collect():
        for label, e in r.entities.items():
            for c in r.constraints:
                if c.constraint_id in e.expected:
                    fact = next((f.text for f in e.displayed if f.attribute == c.attribute), None) if (r.item_id + c.pos) % 5 else None
                    want.append((r.item_id, label, c.constraint_id, fact or "<missing displayed fact>"))
    got = pools.shown_facts(pool, lambda pos: (F.col("item_id") + pos) % 5 != 0)
    assert sorted(tuple(x) for x in got.select("item_id", "label", "constraint_id", "fact").collect()) == sorted(want)


def test_candidate_blocks_and_suffixes(spark):
    df = spark.createDataFrame([("q?\nCandidates:\nA. old\n\nmore\n\nend", 1), ("no marker", 2), ("x\nCandidates:\ny\nCandidates:\nz\n\ne", 3), ("x\nCandidates:\nno end", 4)], "q string, i int")
    options = F.create_map(*[F.lit(x) for pair in zip("ABCD", "wxyz", strict=True) for x in pair])
    got = {r.i: r.n for r in df.select("i", pools.replace_candidates(F.col("q"), options).alias("n")).collect()}
    assert got == {1: "q?\nCandidates:\nA. w\nB. x\nC. y\nD. z\n\nend", 2: None, 3: None, 4: None}
    facts = spark.createDataFrame([("Bo runs. Bo sings. Bo naps.", [("Bo sings",), ("Bo naps",)]), ("Bo runs.", [("Bo sings",), ("Bo naps",)]), ("Bo runs. Bo naps.", [("Bo naps",)])], "o string, f array<struct<text:string>>")
    assert [r.w for r in facts.select(pools.without_suffix(F.col("o"), F.col("f")).alias("w")).collect()] == ["Bo runs.", None, None]


def test_rotations_keep_what_is_true(spark, pool):
    turned = pools.rotated(pool.limit(6))
    broken = contracts.violations(turned.withColumn("item_id", F.col("variant_id")), contracts.v4_rules())
    assert turned.count() == 24 and broken.count() == 0
    assert {len(set(x.g)) for x in turned.groupBy("item_id").agg(F.collect_list("gold").alias("g")).collect()} == {4}


def test_quotas_and_catalogs(spark, monkeypatch):
    assert generation.ratio_counts(101, {"a": 0.2, "b": 0.6, "c": 0.2}) == {"a": 20, "b": 61, "c": 20}
    assert contracts.catalog_violations(spark).count() == 0
    monkeypatch.setattr(catalog, "ATTRIBUTES", [("k", "other", False, [], "same", "same")])
    assert {r.rule for r in contracts.catalog_violations(spark).collect()} == {"two_texts", "some_scenario", "category_allowed"}


def test_first_failures_name_the_earliest_rule(spark, pool):
    odd = pool.withColumns({"language": F.lit("zh"), "version": F.lit(None).cast("string")})
    assert {r.rule for r in validation.first_failures(contracts.violations(odd, contracts.v4_rules())).collect()} == {"version"}


def test_configurations_and_digests(spark, tmp_path):
    config = {"models": [{"alias": "a", "api_key": "x"}], "api_key": "y", "experiments": {"one": {"runs": 3}}}
    assert files.public_config(config) == {"models": [{"alias": "a"}], "experiments": {"one": {"runs": 3}}}
    assert files.experiment_config(config, "one") == {"models": config["models"], "api_key": "y", "runs": 3}
    assert files.model_alias({"model_alias": "m"}) == "m"
    for call in (lambda: files.experiment_config(config, "two"), lambda: files.model_alias({}), lambda: files.assert_compatible({"experiment_id": 1}, {"experiment_id": 2})):
        with pytest.raises(ValueError):
            call()
    files.assert_compatible({"experiment_id": 1, "extra": 2}, {"experiment_id": 1})
    files.write_json(spark, f"{tmp_path}/o.json", {"b": "ü", "a": [1]})
    assert (tmp_path / "o.json").read_text() == '{\n  "a": [\n    1\n  ],\n  "b": "ü"\n}\n' and files.load_json(spark, f"{tmp_path}/o.json") == {"b": "ü", "a": [1]}
    assert files.canonical_hash({"b": 1, "a": 2}) == files.canonical_hash({"a": 2, "b": 1})
    assert files.file_hashes(spark, f"{tmp_path}/o.json").count() == 1
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n[2]\n{"a"\n')
    assert [(r.line, r.text) for r in files.malformed_lines(spark, f"{tmp_path}/l.jsonl").collect()] == [(3, "[2]"), (4, '{"a"')]
    cells = spark.createDataFrame([("CL1__DS2__IL1", 3, [1])], "cell string, n int, more array<int>")
    files.write_cells_csv(cells, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().asDict() == {"cl": "CL1", "ds": "DS2", "il": "IL1", "n": "3"}
    files.write_csv(cells.limit(0), f"{tmp_path}/none")
    assert spark.read.option("header", True).csv(f"{tmp_path}/none").count() == 0
    one = files.entity_json(spark.createDataFrame([(1, None)], "a int, b string"), "a", "b").first().entity
    assert json.loads(one) == {"a": 1}


def test_ids_of_one_file_are_dealt_out(spark):
    """A small table is one file and one task, its documents are not."""
    ids = spark.range(200).select(F.col("id").alias("item_id")).coalesce(1)
    assert pools.pool_for(ids, 7).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_soundness_of_a_row_is_that_of_its_violations(spark, pool):
    odd = pool.withColumn("version", F.when(F.col("item_id") % 3 == 0, "4.0").otherwise(F.col("version"))).withColumn("gold", F.when(F.col("item_id") % 5 == 0, "A").otherwise(F.col("gold")))
    broken = {r.item_id for r in contracts.violations(odd, contracts.v4_rules()).select("item_id").distinct().collect()}
    got = {r.item_id: r.sound for r in contracts.sound(odd, contracts.v4_rules()).select("item_id", "sound").collect()}
    assert {i for i, ok in got.items() if not ok} == broken and len(got) > len(broken) > 0


def test_digests_of_translations_meet_not_documents(spark, pool):
    given = translations.in_chinese(pool)
    assert translations.translation_faults(pool, given).count() == 0
    lone = given.withColumns({"source_item_id": F.lit(-1).cast("long"), "family": F.lit(None).cast("string")})
    found = {}
    for r in translations.translation_faults(pool, lone).collect():
        found.setdefault(r.item_id, set()).add(r.rule)
    # A source that is missing has null fields, as the translation's family has.
    assert len(found) == pool.count() and all({"source_item", "task", "gold", "entity_name"} <= x and not {"family", "empirical_difficulty"} & x for x in found.values())
    plan = translations.translation_faults(pool, given)._jdf.queryExecution().optimizedPlan().toString()
    sides = [x for x in plan.split("Join LeftOuter")[1].splitlines() if x.lstrip(" :+-").startswith("Project")]
    assert "AS formal#" in sides[0]


def test_first_failures_of_rows_are_those_of_all_violations(spark, pool):
    for tampers, rules in ((plans._v4(), contracts.v4_rules()), (plans._semantic(), contracts.semantics())):
        odd = plans.tampered(pool, tampers)
        got = [tuple(r) for r in contracts.first_failures(odd, rules).select("item_id", "rule").collect()]
        want = validation.first_failures(contracts.violations(odd, rules)).select("item_id", "rule").collect()
        assert sorted(got) == sorted(tuple(r) for r in want) and len({rule for _, rule in got}) > 8


@pytest.mark.parametrize("name", ["flt05_semantic_violations", "flt08_item_contract"])
def test_parts_that_stand_twice_count_twice(spark, tmp_path, name):
    """As in the SQL: rows are not gathered by item."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS p_partkey FROM range(120) UNION ALL SELECT range FROM range(40)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(ORACLES[name]).fetchall())
    assert "hashpartitioning(item_id" not in df._jdf.queryExecution().executedPlan().toString()


def test_plain_text_is_not_searched_for_cjk(spark):
    df = spark.createDataFrame([("abc",), ("",), ("é漢字",), ("\U0001f600",), (None,)], "t string")
    assert [r.n for r in df.select(scalar.cjk_count(F.col("t")).alias("n")).collect()] == [0, 0, 2, 0, None]
    assert "octet_length" in df.select(scalar.cjk_count(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_draws_sort_by_digest_then_value(spark):
    digits = lambda v: hashlib.md5(f"7|x|3|{v}".encode()).hexdigest()[:8]
    for values, strings in ((["ada", "bo|b", "", "é", "Zoe"], True), (list(range(1, 128)), False)):
        found = generation.drawn(F.array(*[F.lit(v) for v in values]), F.lit(7), F.lit("x"), F.col("id"), strings=strings)
        df = spark.range(3, 4).select(found.alias("d"))
        assert df.first().d == sorted(values, key=lambda v: (digits(v), v))
        # What the elements share is joined once, before they are digested.
        assert "md5(cast(concat_ws" not in df._jdf.queryExecution().analyzed().toString()


def test_documents_are_worked_out_once(spark):
    """Nothing is copied to be bound to a name, and a question alone does not make the options anew for each label."""
    made = pools.pool_for(spark.range(5).select(F.col("id").alias("item_id")), 7)
    plan = lambda *c: made.select(*c)._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(transform(array(" not in plan("question", "options")
    assert "element_at(transform_values(" not in plan("question")


def test_equal_pairs_are_audited_once(spark, pool):
    found = pools.lexical_audit(pool.unionAll(pool))
    once = pools.lexical_audit(pool).first()
    assert found.first().asDict() == once.asDict() | {c: 2 * once[c] for c in ("n_pairs", "n_exact", "n_high")}
    assert "Aggregate [fact" in found._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(pools.lexical_audit(pool.limit(0)).first()) == (0, None, 0, 0)
