"""Queries over item documents: contracts with tampered items, variants and generation by closeness.

The items are one for each part, its factors, gold label and scenario by its key. Each is tampered with in one way by its id, or left
alone; the SQL says which rule that way breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.functions import scalar as S
from caselattice.operators import contracts as K
from caselattice.operators import generation as G
from caselattice.operators import pools as P
from caselattice.operators import translations as L
from caselattice.operators import validation as V
from caselattice.plans.registry import query
from caselattice.sources import catalog as C
from caselattice.sources import views as X
from caselattice.sources.folders import stored

PER_CELL, N, SEED = 24, 300, 42
#: The items: one for each part.
IDS = "(SELECT p_partkey AS item_id FROM part)"
Tamper = tuple[str | None, str | None, Callable[[], dict[str, Column]]]


def _entities(field: str, make) -> dict[str, Column]:
    return {"entities": F.transform_values("entities", lambda _, e: e.withField(field, make(e)))}


def _constraints(make) -> dict[str, Column]:
    return {"constraints": F.transform("constraints", make)}


def _facts(field: str, make) -> dict[str, Column]:
    return _entities("non_target", lambda e: F.transform(e["non_target"], lambda f: f.withField(field, make(f))))


def _shown(field: str, make) -> dict[str, Column]:
    return _entities("displayed", lambda e: F.transform(e["displayed"], lambda f: f.withField(field, make(f))))


def _first() -> Column:
    return F.get("constraints", F.lit(0))


def _turned(c: str, to: dict[str, str]) -> dict[str, Column]:
    return {c: F.element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), F.col(c))}


def _semantic() -> list[Tamper]:
    """(rule first broken in an item of IL1, in one of IL2, what makes the new columns): ways that only the semantics notice."""
    renamed = lambda: _entities("attributes", lambda e: F.transform_keys(e["attributes"], lambda k, _: F.concat(F.lit("x_"), k)))
    flipped = lambda: _entities("attributes", lambda e: F.transform_values(e["attributes"], lambda _, v: ~v))
    beside = lambda: F.map_zip_with("options", "entities", lambda _, o, e: F.array_join(F.transform(e["non_target"], lambda f: F.concat(F.lit(" "), f["text"], F.lit("."))), ""))
    twice = lambda rule, new: (rule, rule, new)
    return [
        twice("no_cjk", lambda: {"question": F.concat("question", F.lit("漢"))}),
        twice("attribute_known", lambda: renamed() | _constraints(lambda c: c.withField("attribute", F.concat(F.lit("x_"), c["attribute"])))),
        twice("polarity", lambda: flipped() | _constraints(lambda c: c.withField("required_value", ~c["required_value"]))),
        twice("template_known", lambda: _constraints(lambda c: c.withField("text", F.concat(c["text"], F.lit("."))))),
        twice("display_order_is_permutation", lambda: _entities("display_order", lambda e: F.slice(e["display_order"], 1, 2))),
        twice("display_order_differs", lambda: _entities("display_order", lambda e: F.transform("constraints", lambda c: c["attribute"]))),
        twice("displayed_count", lambda: _entities("displayed", lambda e: F.slice(e["displayed"], 1, 2))),
        twice("displayed_value", lambda: _shown("value", lambda f: ~f["value"])),
        twice("displayed_text", lambda: _shown("text", lambda f: F.concat(f["text"], F.lit("!")))),
        twice("displayed_in_option", lambda: {"options": beside()}),
    ]


def _matrix() -> list[Tamper]:
    gold = lambda: F.element_at("entities", F.col("gold"))["attributes"]
    none = lambda: F.expr("cast(array() as array<string>)")
    alike = lambda: F.transform_values("entities", lambda _, e: e.withField("attributes", gold()).withField("expected", none()))
    twice = lambda rule, new: (rule, rule, new)
    return [
        twice("four_options", lambda: {"options": F.map_filter("options", lambda k, _: k != "D")}),
        twice("four_entities", lambda: {"entities": F.map_filter("entities", lambda k, _: k != "A")}),
        twice("names_unique", lambda: _entities("name", lambda e: F.lit("Ada"))),
        twice("attributes_present", lambda: _entities("attributes", lambda e: F.lit(None).cast("map<string,boolean>"))),
        twice("attributes_cover_constraints", lambda: _entities("attributes", lambda e: F.map_filter(e["attributes"], lambda k, _: k != _first()["attribute"]))),
        twice("expected_signature_present", lambda: _entities("expected", lambda e: F.lit(None).cast("array<string>"))),
        twice("matrix_recomputed", lambda: {"matrix": F.transform_values("matrix", lambda _, m: F.transform_values(m, lambda _, v: ~v))}),
        twice("signatures_recomputed", lambda: {"signatures": F.transform_values("signatures", lambda _, s: none())}),
        twice("expected_recomputed", lambda: _entities("expected", lambda e: F.array(F.lit("C9")))),
        twice("one_valid_option", lambda: {"entities": alike(), "matrix": F.transform_values("matrix", lambda _, m: F.transform_values(m, lambda _, v: F.lit(True))), "signatures": F.transform_values("signatures", lambda _, s: none())}),
        twice("gold_answer", lambda: _turned("gold", {"A": "B", "B": "C", "C": "D", "D": "A"})),
        twice("gold_marker", lambda: _entities("is_gold", lambda e: F.lit(False))),
    ]


def _fact() -> list[Tamper]:
    far = lambda: F.when(F.col("scenario") == "orchard", "cat").when(F.col("scenario") == "harbour", "tea").otherwise("attic")
    only = lambda rule, new: (None, rule, new)
    return [
        ("fact_count", "fact_count", lambda: _turned("il", {"IL1": "IL2", "IL2": "IL1"})),
        only("fact_not_empty", lambda: _facts("text", lambda f: F.lit(""))),
        only("fact_is_no_attribute", lambda: _facts("key", lambda f: F.lit("drives"))),
        only("fact_known", lambda: _facts("key", lambda f: F.lit("nothing"))),
        only("fact_scenario", lambda: _facts("key", lambda f: far())),
        only("fact_category", lambda: _facts("category", lambda f: F.lit("other"))),
        only("fact_not_repeated", lambda: _entities("non_target", lambda e: F.transform(e["non_target"], lambda f: F.get(e["non_target"], F.lit(0))))),
        only("fact_text", lambda: _facts("text", lambda f: F.concat(f["text"], F.lit("!")))),
        only("fact_in_option", lambda: {"options": F.map_zip_with("options", "entities", lambda _, o, e: F.coalesce(P.without_suffix(o, e["non_target"]), o))}),
        ("no_cue", "no_cue", lambda: {"options": F.transform_values("options", lambda _, o: F.concat(o, F.lit(" Irrelevant.")))}),
    ]


def _v4() -> list[Tamper]:
    twice = lambda rule, new: (rule, rule, new)
    meta = lambda field, value: {"metadata": F.col("metadata").withField(field, value)}
    return [
        twice("version", lambda: {"version": F.lit("4.0")}),
        twice("task", lambda: {"task": F.lit("other")}),
        twice("language", lambda: {"language": F.lit("zh")}),
        twice("known_factors", lambda: {"ds": F.lit("DS9")}),
        twice("constraint_fields", lambda: _constraints(lambda c: c.withField("text", F.lit(None).cast("string")))),
        twice("constraint_count", lambda: {"constraints": F.slice("constraints", F.lit(1), F.size("constraints") - 1)}),
        twice("constraint_ids", lambda: _constraints(lambda c: c.withField("constraint_id", F.concat(F.lit("K"), c["pos"])))),
        twice("attributes_unique", lambda: _constraints(lambda c: c.withField("attribute", _first()["attribute"]))),
        twice("distractor_level", lambda: _turned("ds", {"DS1": "DS3", "DS2": "DS3", "DS3": "DS1"})),
        twice("metadata_version", lambda: meta("version", F.lit("4.0"))),
        twice("metadata_seed", lambda: meta("seed", F.lit(None).cast("int"))),
        twice("metadata_template", lambda: meta("template_id", F.lit(" "))),
        twice("metadata_warnings", lambda: meta("warnings", F.array(F.lit("x")))),
        twice("question_holds_options", lambda: {"question": F.lit("Who?")}),
        ("scenario_known", "fact_scenario", lambda: {"scenario": F.lit("nowhere")}),
        *_matrix(), *_fact(), *_semantic(),
    ]


def _v3() -> list[Tamper]:
    twice = lambda rule, new: (rule, rule, new)
    last = lambda: F.size("constraints")
    against = lambda c: F.when(c["pos"] == last(), c.withField("attribute", _first()["attribute"]).withField("required_value", ~_first()["required_value"])).otherwise(c)
    return [
        twice("three_to_five_constraints", lambda: {"constraints": F.slice("constraints", 1, 2)}),
        twice("structural_complexity", lambda: {"structural_complexity": F.lit("other")}),
        twice("not_yet_evaluated", lambda: {"empirical_difficulty": F.lit("easy")}),
        twice("no_conflicting_constraints", lambda: _constraints(against)),
        twice("closeness_pattern", lambda: _turned("option_closeness", {"easy": "hard", "medium": "easy", "hard": "medium"})),
        twice("semantics_flag", lambda: {"metadata": F.col("metadata").withField("semantic_validation_passed", F.lit(False))}),
        *_matrix(), *_semantic(),
    ]


def tampered(items: DataFrame, tampers: list[Tamper]) -> DataFrame:
    """Way number item_id % (ways + 1) - 1, so that every so many items one is left as it is."""
    way = F.col("item_id") % (len(tampers) + 1)
    new, changes = {}, [make() for _, _, make in tampers]
    for column in sorted({c for change in changes for c in change}):
        value = F.col(column)
        for i, change in enumerate(changes):
            if column in change:
                value = F.when(way == i + 1, change[column]).otherwise(value)
        new[column] = value
    return items.withColumns(new)


def _pool(spark, sf):
    return P.pool_for(X.read(spark, sf, "part").select(F.col("p_partkey").alias("item_id")), SEED)


def _expected(tampers: list[Tamper], ids: str, il: str) -> str:
    rows = ", ".join(f"({i + 1}, {C.values_sql([(a, b)])[8:-1]})" for i, (a, b, _) in enumerate(tampers))
    return f"SELECT item_id, rule FROM (SELECT item_id, CASE WHEN {il} THEN low ELSE high END AS rule FROM {ids}, (VALUES {rows}) t(way, low, high) WHERE item_id % {len(tampers) + 1} = way) WHERE rule IS NOT NULL"


_LOW = "(item_id // 12) % 2 = 0"


@query("flt08_item_contract", _expected(_v4(), IDS, _LOW))
def flt08(spark, sf):
    """The first rule that each tampered item breaks, of the contract of factor cells (FLT-08, FLT-09, FLT-10, FLT-11)."""
    return K.first_failures(tampered(_pool(spark, sf), _v4()), K.v4_rules())


@query("flt01_item_contract", _expected(_v3(), f"(SELECT unnest(range({N})) AS item_id)", "true"))
def flt01c(spark, sf):
    """The same for the contract by closeness (FLT-01, FLT-02, FLT-03, RND-03, RND-08)."""
    return K.first_failures(tampered(P.closeness_pool(spark, N, SEED), _v3()), K.v3_rules())


@query("flt05_semantic_violations", f"SELECT rule, count(*) AS n FROM ({_expected(_semantic(), IDS, 'true')}) GROUP BY rule")
def flt05(spark, sf):
    """First semantic rules broken, counted (FLT-05, FLT-06, FLT-07, AGG-30)."""
    found = K.first_failures(tampered(_pool(spark, sf), _semantic()), K.semantics())
    return found.groupBy("rule").agg(F.count("*").alias("n"))


#: All rules of the facts that each of five ways breaks.
_COLLECTED = [(1, "fact_not_empty"), (1, "fact_text"), (2, "fact_known"), (2, "fact_scenario"), (2, "fact_category"), (2, "fact_not_repeated"), (2, "fact_text"), (3, "fact_category"), (4, "no_cue")]


def _five() -> list[Tamper]:
    by = {b: t for t in _fact() for b in [t[1]]}
    return [by["fact_not_empty"], by["fact_known"], by["fact_category"], by["no_cue"]]


@query("flt13_collected_errors", f"SELECT item_id, rule, rule_class FROM (SELECT item_id, rule, 'facts' AS rule_class FROM {IDS}, ({C.values_sql(_COLLECTED)}) t(way, rule) WHERE item_id % 5 = way AND (rule = 'no_cue' OR NOT {_LOW}))")
def flt13(spark, sf):
    """Every rule that an item breaks, not the first one alone (FLT-13, FLT-22)."""
    return K.violations(tampered(_pool(spark, sf), _five()), K.fact_rules()).select("item_id", "rule", "rule_class")


@query("flt04_dataset_balance", f"SELECT 'gold' AS scope, chr(65 + g::INT) AS level, count(*) FILTER (i % 4 = g) AS n, true AS sound FROM (SELECT p_partkey AS i FROM part), (SELECT unnest(range(4)) AS g) GROUP BY g UNION ALL SELECT 'scenario', ['harbour', 'museum', 'orchard'][s::INT + 1], count(*) FILTER (i % 3 = s), true FROM (SELECT p_partkey AS i FROM part), (SELECT unnest(range(3)) AS s) GROUP BY s")
def flt04b(spark, sf):
    """Gold labels and scenarios of a pool against what they should be (FLT-04)."""
    return K.balance(_pool(spark, sf))


@query("rnd09_rotated_items", f"SELECT item_id || '_r' || r AS variant_id, chr(65 + ((item_id % 4 + r) % 4)::INT) AS gold, true AS sound FROM {IDS}, (SELECT unnest(range(4)) AS r)")
def rnd09(spark, sf):
    """Whole items under four rotations, still valid by their contract (RND-09, JON-12, SCL-10, PRJ-16)."""
    return K.sound(P.rotated(_pool(spark, sf)), K.v4_rules()).select("variant_id", "gold", "sound")


@query("rnd10_information_pairs", f"SELECT item_id, 2::BIGINT AS n_versions, true AS same_formal, true AS sound FROM {IDS} WHERE NOT {_LOW}")
def rnd10(spark, sf):
    """Items with and without their facts: both valid, formal fields equal (RND-10, SCL-11, FLT-20, FLT-23, JON-14)."""
    pairs = K.sound(P.information_pairs(_pool(spark, sf)), K.v4_rules())
    formal = F.sha2(F.to_json(F.struct("constraints", "signatures", "gold", "scenario", "cl", "ds")), 256)
    both = pairs.select("item_id", formal.alias("formal"), "sound")
    return both.groupBy("item_id").agg(F.count("*").alias("n_versions"), (F.min("formal") == F.max("formal")).alias("same_formal"), F.bool_and("sound").alias("sound"))


@query("rnd05_closeness_schedule", f"SELECT * FROM ({C.values_sql([(x, n) for x, n in G.ratio_counts(N, {'easy': 0.2, 'medium': 0.6, 'hard': 0.2}).items()])}) t(option_closeness, n)")
def rnd05(spark, sf):
    """Quotas of a generated pool (RND-05, RND-06, MTH-04, MTH-05): only feasible numbers of constraints, gold labels even."""
    made = G.generate_by_closeness(spark, N, SEED)
    ok = F.array_contains(G.feasible_counts(F.col("option_closeness")), F.col("k"))
    per_gold = made.filter(ok).groupBy("option_closeness", "gold").agg(F.count("*").alias("n"))
    even = per_gold.groupBy("option_closeness").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n")).alias("spread"))
    return even.filter("spread <= 1").select("option_closeness", "n")


@query("prj23_catalog_invariants", f"SELECT key, CASE WHEN t = f OR t = '' OR f = '' THEN 'two_texts' ELSE 'some_scenario' END AS rule FROM ({C.values_sql(C.ATTRIBUTES)}) a(key, category, may_be_false, scenarios, t, f) WHERE t = f OR t = '' OR f = '' OR len(scenarios) = 0")
def prj23(spark, sf):
    """Catalog rows that break an invariant: none may (PRJ-23); a test breaks one on purpose."""
    return K.catalog_violations(spark)


@query("src07_exported_catalogs", f"SELECT key, category, may_be_false, array_to_string(list_sort(scenarios), ',') AS scenarios, t AS text_true, f AS text_false FROM ({C.values_sql(C.ATTRIBUTES)}) a(key, category, may_be_false, scenarios, t, f)")
def src07(spark, sf):
    """The attribute catalog's rows (SRC-07, PRJ-22)."""
    return C.attributes(spark).withColumn("scenarios", F.array_join(F.array_sort("scenarios"), ","))


@query("agg29_factor_balance", f"""WITH i AS (SELECT unnest(range({18 * PER_CELL})) AS id), c AS (SELECT id // {PER_CELL} AS cell, count(*) AS n FROM i GROUP BY 1), g AS (SELECT id // {PER_CELL} AS cell, id % 4 AS g, count(*) AS n FROM i GROUP BY 1, 2), s AS (SELECT id // {PER_CELL} AS cell, id % 3 AS s, count(*) AS n FROM i GROUP BY 1, 2)
SELECT (SELECT count(*) FROM c) = 18 AS all_cells, (SELECT max(n) = min(n) FROM c) AS equal_cells, (SELECT max(x) FROM (SELECT max(n) - min(n) AS x FROM g GROUP BY cell)) AS gold_spread, (SELECT max(x) FROM (SELECT max(n) - min(n) AS x FROM s GROUP BY cell)) AS scenario_spread, true AS three_templates, true AS ratios_close, 0::BIGINT AS n_broken""")
def agg29(spark, sf):
    """Balance checks over the cells of a pool (AGG-29): sizes, spreads of gold labels and scenarios, templates, the range of
    true requirements (0.25 at most) and broken items."""
    items = P.pool(spark, PER_CELL, SEED)
    cell, labels = F.concat_ws("__", "cl", "ds", "il"), ["A", "B", "C", "D"]
    scenarios = [s[0] for s in C.SCENARIOS]
    trues = F.sum(F.size(F.filter("constraints", lambda c: c["required_value"])))
    golds, places = [F.count_if(F.col("gold") == x) for x in labels], [F.count_if(F.col("scenario") == x) for x in scenarios]
    seen = [F.when(c > 0, c) for c in places]
    by = items.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), (F.greatest(*golds) - F.least(*golds)).alias("gold"), (F.greatest(*seen) - F.least(*seen)).alias("place"), F.countDistinct("metadata.template_id").alias("templates"), (trues / F.sum(F.size("constraints"))).alias("share"))
    broken = K.violations(items, K.v4_rules()).agg(F.countDistinct("item_id").alias("n_broken"))
    checks = by.agg((F.count("*") == 18).alias("all_cells"), (F.max("n") == F.min("n")).alias("equal_cells"), F.max("gold").alias("gold_spread"), F.max("place").alias("scenario_spread"), (F.min("templates") >= 3).alias("three_templates"), (F.max("share") - F.min("share") <= 0.25).alias("ratios_close"))
    return checks.crossJoin(broken)


@query("agg29_cell_lengths", None)
def agg29b(spark, sf):
    """Mean words of questions and options by cell; null for a cell without items (AGG-29, JON-20). No SQL: the texts are
    generated here."""
    items = _pool(spark, sf)
    options = F.aggregate(F.map_values("options"), F.lit(0), lambda a, o: a + S.word_count(o))
    by = items.groupBy("cl", "ds", "il").agg(F.count("*").alias("n"), F.round(F.avg(S.word_count(F.col("question"))), 3).alias("question_words"), F.round(F.sum(options) / F.sum(F.size("options")), 3).alias("option_words"))
    domain = G.cells(spark)
    return domain.join(by, ["cl", "ds", "il"], "left").select("cl", "ds", "il", F.coalesce("n", F.lit(0)).alias("n"), "question_words", "option_words")


@query("agg31b_lexical_audit", None)
def agg31b(spark, sf):
    """Displayed facts against their constraints' texts (AGG-31, JON-08). No SQL: the texts are generated here; a test compares
    it with a plain loop over the same documents."""
    return P.lexical_audit(_pool(spark, sf))


@query("jon15_shown_facts", None)
def jon15(spark, sf):
    """Broken constraints with the fact that the option shows for each, or a fixed text (JON-15, JON-07). Facts are hidden where
    an item's id and the constraint's number add up to a multiple of five; no SQL, as above."""
    return P.shown_facts(_pool(spark, sf), lambda pos: (F.col("item_id") + pos) % 5 != 0)


def _translations() -> list[Tamper]:
    """Ways to spoil a translation, with the check that notices."""
    way = lambda rule, new: (rule, rule, new)
    bare = lambda x: {"options": F.transform_values("options", lambda k, o: F.when(k == x, F.lit("plain")).otherwise(o))}
    return [
        way("source_item", lambda: {"source_item_id": F.col("source_item_id") + 1}),
        way("family", lambda: {"family": F.lit("other")}),
        way("scenario", lambda: {"scenario": F.lit(None).cast("string")}),
        way("empirical_difficulty", lambda: {"empirical_difficulty": F.lit("easy")}),
        way("gold", lambda: _turned("gold", {"A": "B", "B": "C", "C": "D", "D": "A"})),
        way("matrix", lambda: {"matrix": F.transform_values("matrix", lambda _, m: F.transform_values(m, lambda _, v: ~v))}),
        way("signatures", lambda: {"signatures": F.transform_values("signatures", lambda _, s: F.expr("array('C9')"))}),
        way("constraint_attribute", lambda: _constraints(lambda c: c.withField("attribute", F.lit("other")))),
        way("constraint_required_value", lambda: _constraints(lambda c: c.withField("required_value", ~c["required_value"]))),
        way("constraint_text", lambda: _constraints(lambda c: F.when(c["pos"] == 2, c.withField("text", F.lit("plain"))).otherwise(c))),
        way("option_C", lambda: bare("C")),
        way("entity_name", lambda: _entities("name", lambda e: F.upper(e["name"]))),
        way("entity_display_order", lambda: _entities("display_order", lambda e: F.reverse(e["display_order"]))),
        way("question", lambda: {"question": F.lit("Who fits?")}),
    ]


@query("flt20b_translations", _expected(_translations(), IDS, "true"))
def flt20b(spark, sf):
    """The first check that each spoilt translation fails against its source, over all formal fields and texts (FLT-20)."""
    # One pass makes both sides' rows; documents are not made twice.
    items = _pool(spark, sf).withColumn("source", L.source_row())
    made = stored(tampered(L.in_chinese(items), _translations()).select("source", L.translated_row().alias("translation")))
    return V.first_failures(L.faults(made.select("source.*"), made.select("translation.*")))
