"""The contracts of item documents: each rule is a named condition over one row, so all are checked in one pass.

A rule is (name, class, condition that holds for a sound item); a null condition counts as broken. Rules stand in the order
in which a check that stops at the first failure would ask them: `first_failures` names that one, while
`violations` collects all and `sound` says whether there is none. Documents are those of `operators.pools`; what several rules
ask of a document is worked out once, as columns of `_prepared`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.functions.scalar import LABELS, bound, cjk_count, complexity
from caselattice.operators import pools
from caselattice.operators.matrix import broken_ids
from caselattice.operators.validation import closeness, far_threshold, signature_capacity
from caselattice.sources import catalog

Rule = tuple[str, str, Column]
#: What marks facts as beside the point, and what no constraint may say.
CUES, FORBIDDEN = ("as background information", "irrelevant"), ("or else", "whatever", "it does not matter")


def _all(test) -> Column:
    """Whether a test of (label, entity, option) holds for all four labels."""
    return F.forall(pools.labels(), lambda x: F.coalesce(test(x, F.element_at("entities", x), F.element_at("options", x)), F.lit(False)))


def _keys(m: str) -> Column:
    return F.array_sort(F.map_keys(m)) == pools.labels()


def _names() -> Column:
    return F.transform(pools.labels(), lambda x: F.element_at("entities", x)["name"])


def _recomputed(x: Column) -> Column:
    return F.element_at("_broken", x)


def _wrong() -> Column:
    return F.filter(pools.labels(), lambda x: x != F.col("gold"))


def _sizes() -> Column:
    """Sorted numbers of violations of the wrong options."""
    return F.col("_sizes")


def _prepared(items: DataFrame) -> DataFrame:
    """items with the broken constraints of each label, the labels that break none, and the sizes of the wrong ones."""
    broken = F.map_from_arrays(pools.labels(), F.transform(pools.labels(), lambda x: broken_ids(F.element_at("entities", x)["attributes"], F.col("constraints"))))
    valid = F.filter(pools.labels(), lambda x: F.size(_recomputed(x)) == 0)
    return items.withColumn("_broken", broken).withColumns({"_valid": valid, "_sizes": F.array_sort(F.transform(_wrong(), lambda x: F.size(_recomputed(x))))})


def _attributes() -> Column:
    return F.transform("constraints", lambda c: c["attribute"])


def matrix_rules() -> list[Rule]:
    """What both contracts ask of stored matrices, signatures and gold labels."""
    same = lambda x: F.forall("constraints", lambda c: F.coalesce(F.element_at(F.element_at("matrix", x), c["constraint_id"]) == (F.element_at(F.element_at("entities", x)["attributes"], c["attribute"]) == c["required_value"]), F.lit(False)))
    valid = F.col("_valid")
    marked = F.filter(pools.labels(), lambda x: F.coalesce(F.element_at("entities", x)["is_gold"], F.lit(False)))
    return [
        ("attributes_present", "structure", _all(lambda x, e, o: e["attributes"].isNotNull())),
        ("attributes_cover_constraints", "structure", _all(lambda x, e, o: F.forall("constraints", lambda c: F.map_contains_key(e["attributes"], c["attribute"])))),
        ("expected_signature_present", "structure", _all(lambda x, e, o: e["expected"].isNotNull())),
        ("matrix_recomputed", "matrix", _all(lambda x, e, o: same(x) & (F.size(F.element_at("matrix", x)) == F.size("constraints")))),
        ("signatures_recomputed", "matrix", _all(lambda x, e, o: F.element_at("signatures", x) == _recomputed(x))),
        ("expected_recomputed", "matrix", _all(lambda x, e, o: e["expected"] == _recomputed(x))),
        ("one_valid_option", "gold", F.size(valid) == 1),
        ("gold_answer", "gold", F.array(F.col("gold")) == valid),
        ("gold_marker", "gold", marked == valid),
    ]


def constraint_semantics() -> list[Rule]:
    """Constraints against the catalogs. What is asked of one constraint is asked of each."""
    known = F.create_map(*[x for a in catalog.ATTRIBUTES for x in (F.lit(a[0]), F.struct(F.lit(a[1]).alias("category"), F.lit(a[2]).alias("may_be_false"), F.array(*[F.lit(s) for s in a[3]]).alias("scenarios")))])
    allowed = F.create_map(*[x for s in catalog.SCENARIOS for x in (F.lit(s[0]), F.struct(F.array(*[F.lit(c) for c in s[2]]).alias("categories"), (F.array(*[F.lit(k) for k in s[3]]) if s[3] else F.lit(None).cast("array<string>")).alias("keys")))])
    scenario = F.element_at(allowed, F.col("scenario"))
    each = lambda test: F.forall("constraints", lambda c: bound(F.element_at(known, c["attribute"]), lambda a: F.coalesce(test(c, a), F.lit(False))))
    return [
        ("language_en", "semantics", F.col("language") == "en"),
        ("no_cjk", "semantics", (cjk_count(F.col("question")) == 0) & each(lambda c, a: cjk_count(c["text"]) == 0)),
        ("scenario_known", "semantics", F.map_contains_key(allowed, F.col("scenario"))),
        ("attribute_known", "semantics", each(lambda c, a: a.isNotNull())),
        ("polarity", "polarity", each(lambda c, a: c["required_value"] | a["may_be_false"])),
        ("scenario_compatible", "scenario", each(lambda c, a: F.array_contains(a["scenarios"], F.col("scenario")) & F.array_contains(scenario["categories"], a["category"]) & F.coalesce(F.array_contains(scenario["keys"], c["attribute"]), F.lit(True)))),
        ("template_known", "semantics", each(lambda c, a: c["text"] == F.concat(F.lit("The person "), pools.said(c["attribute"], c["required_value"])))),
        ("no_forbidden_phrase", "semantics", each(lambda c, a: ~F.lower(c["text"]).rlike("|".join(FORBIDDEN)))),
    ]


def candidate_semantics() -> list[Rule]:
    """Options against what they show of the constrained attributes."""
    order = _all(lambda x, e, o: F.array_sort(e["display_order"]) == F.array_sort(_attributes()))
    return [
        ("display_order_is_permutation", "semantics", order),
        ("display_order_differs", "semantics", _all(lambda x, e, o: e["display_order"] != _attributes())),
        ("displayed_count", "semantics", _all(lambda x, e, o: F.transform(e["displayed"], lambda f: f["attribute"]) == e["display_order"])),
        ("displayed_value", "semantics", _all(lambda x, e, o: F.forall(e["displayed"], lambda f: f["value"] == F.element_at(e["attributes"], f["attribute"])))),
        ("displayed_text", "semantics", _all(lambda x, e, o: F.forall(e["displayed"], lambda f: f["text"] == F.concat(e["name"], F.lit(" "), pools.said(f["attribute"], f["value"]))))),
        ("displayed_in_option", "semantics", _all(lambda x, e, o: F.forall(e["displayed"], lambda f: F.contains(o, f["text"])))),
    ]


def semantics() -> list[Rule]:
    return constraint_semantics() + candidate_semantics()


def fact_rules() -> list[Rule]:
    """Facts beside the point: none in the first information level, two sound ones in the second."""
    of = lambda f: F.element_at(pools.fact_pool(), f["key"])
    each = lambda test: _all(lambda x, e, o: F.forall(e["non_target"], lambda f: F.coalesce(test(f, e, o), F.lit(False))))
    names = F.array(*[F.lit(a[0]) for a in catalog.ATTRIBUTES])
    keys = lambda e: F.transform(e["non_target"], lambda f: f["key"])
    # An attribute that is a fact's key is taken as true.
    value = lambda e, ks, a: F.when(ks.isNotNull() & e["attributes"].isNotNull(), F.when(F.array_contains(ks, a), True).otherwise(F.element_at(e["attributes"], a)))
    unmet = lambda e, ks: F.filter("constraints", lambda c: ~F.coalesce(value(e, ks, c["attribute"]) == c["required_value"], F.lit(False)))
    with_facts = lambda e: bound(keys(e), lambda ks: F.transform(unmet(e, ks), lambda c: c["constraint_id"]))
    return [
        ("fact_count", "facts", _all(lambda x, e, o: F.size(e["non_target"]) == F.when(F.col("il") == "IL2", 2).otherwise(0))),
        ("fact_not_empty", "facts", each(lambda f, e, o: (f["key"] != "") & (f["text"] != ""))),
        ("fact_is_no_attribute", "facts", each(lambda f, e, o: ~F.array_contains(names, f["key"]))),
        ("fact_known", "facts", each(lambda f, e, o: of(f).isNotNull())),
        ("fact_scenario", "facts", each(lambda f, e, o: F.array_contains(of(f)["scenarios"], F.col("scenario")))),
        ("fact_category", "facts", each(lambda f, e, o: f["category"] == of(f)["category"])),
        ("fact_not_repeated", "facts", _all(lambda x, e, o: F.size(F.array_distinct(keys(e))) == F.size(e["non_target"]))),
        ("fact_text", "facts", each(lambda f, e, o: f["text"] == F.concat(e["name"], F.lit(" "), of(f)["text"]))),
        ("fact_in_option", "facts", each(lambda f, e, o: F.contains(o, f["text"]))),
        ("no_cue", "facts", _all(lambda x, e, o: bound(F.lower(o), lambda t: ~F.contains(t, F.lit(CUES[0])) & ~F.contains(t, F.lit(CUES[1]))))),
        ("facts_change_nothing", "facts", _all(lambda x, e, o: F.when(F.size(e["non_target"]) == 0, F.lit(True)).otherwise(with_facts(e) == _recomputed(x)))),
    ]


def metadata_rules() -> list[Rule]:
    # Three far signatures are too few to choose from only below three constraints, which no level has.
    expected = F.when((F.col("ds") == "DS1") & (signature_capacity(F.col("k")) < 3), F.array(F.lit("few_signatures"))).otherwise(F.expr("cast(array() as array<string>)"))
    return [
        ("metadata_version", "metadata", F.col("metadata.version") == pools.VERSION),
        ("metadata_seed", "metadata", F.col("metadata.seed").isNotNull()),
        ("metadata_template", "metadata", F.trim(F.col("metadata.template_id")) != ""),
        ("metadata_warnings", "metadata", F.col("metadata.warnings") == expected),
    ]


def distractor_rules() -> list[Rule]:
    """Three wrong options, each with a violation, in the pattern of the level; far ones not all alike."""
    sizes, unlike = _sizes(), F.size(F.array_distinct(F.transform(_wrong(), _recomputed)))
    far = (F.array_min(sizes) >= far_threshold(F.col("k"))) & ((signature_capacity(F.col("k")) < 3) | (unlike > 1))
    level = F.when(F.col("ds") == "DS1", far).when(F.col("ds") == "DS2", (F.get(sizes, F.lit(0)) == 1) & (F.get(sizes, F.lit(1)) >= 2)).when(F.col("ds") == "DS3", F.array_max(sizes) == 1)
    return [("wrong_options_violate", "distractors", (F.size(sizes) == 3) & (F.array_min(sizes) >= 1)), ("distractor_level", "distractors", level)]


def v4_rules() -> list[Rule]:
    """The contract of items in factor cells."""
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(F.size("constraints"), F.lit(1))), lambda i: F.concat(F.lit("C"), i))
    levels = F.col("cl").isin("CL1", "CL2", "CL3") & F.col("ds").isin("DS1", "DS2", "DS3") & F.col("il").isin("IL1", "IL2")
    return [
        ("version", "structure", F.col("version") == pools.VERSION),
        ("task", "structure", (F.col("family") == pools.FAMILY) & (F.col("task") == pools.TASK)),
        ("language", "structure", F.col("language") == pools.LANGUAGE),
        ("four_options", "structure", _keys("options")),
        ("four_entities", "structure", _keys("entities")),
        ("known_factors", "factors", levels),
        ("constraint_fields", "structure", F.forall("constraints", lambda c: c["constraint_id"].isNotNull() & c["attribute"].isNotNull() & c["required_value"].isNotNull() & c["text"].isNotNull())),
        ("constraint_count", "factors", F.size("constraints") == F.when(F.col("cl") == "CL1", 3).when(F.col("cl") == "CL2", 5).when(F.col("cl") == "CL3", 7)),
        ("constraint_ids", "structure", F.transform("constraints", lambda c: c["constraint_id"]) == numbered),
        ("attributes_unique", "structure", F.size(F.array_distinct(_attributes())) == F.size("constraints")),
        ("names_unique", "structure", F.size(F.array_distinct(F.filter(_names(), lambda n: n != ""))) == 4),
        *matrix_rules(),
        *distractor_rules(),
        *fact_rules(),
        *metadata_rules(),
        ("question_holds_options", "structure", (F.trim("question") != "") & _all(lambda x, e, o: F.contains(F.col("question"), o))),
        *semantics(),
    ]


def v3_rules() -> list[Rule]:
    """The contract of items by closeness."""
    values = lambda x: F.transform("constraints", lambda c: F.element_at(F.element_at("entities", x)["attributes"], c["attribute"]))
    alike = F.forall("constraints", lambda c: F.forall("constraints", lambda d: (c["attribute"] != d["attribute"]) | (c["required_value"] == d["required_value"])))
    broken = F.array_distinct(F.flatten(F.transform(_wrong(), _recomputed)))
    sizes = _sizes()
    return [
        ("four_options", "structure", _keys("options")),
        ("four_entities", "structure", _keys("entities")),
        ("three_to_five_constraints", "structure", F.size("constraints").between(3, 5)),
        ("structural_complexity", "structure", F.col("structural_complexity") == complexity(F.size("constraints"))),
        ("not_yet_evaluated", "structure", F.col("empirical_difficulty").isNull()),
        ("no_conflicting_constraints", "structure", alike),
        ("names_unique", "structure", F.size(F.array_distinct(_names())) == 4),
        *matrix_rules(),
        ("wrong_options_violate", "distractors", F.array_min(sizes) >= 1),
        ("combinations_unique", "distractors", F.size(F.array_distinct(F.transform(pools.labels(), values))) == 4),
        ("each_constraint_excludes", "distractors", F.size(broken) == F.size("constraints")),
        ("closeness_pattern", "distractors", (F.size(sizes) == 3) & (closeness(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(sizes, i))) == F.col("option_closeness"))),
        *semantics(),
        ("semantics_flag", "metadata", F.col("metadata.semantic_validation_passed")),
    ]


def violations(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """(item_id, rule_order, rule, rule_class): every rule that an item breaks."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("rule_order"), F.lit(name).alias("rule"), F.lit(kind).alias("rule_class"))) for i, (name, kind, ok) in enumerate(rules)]
    return _prepared(items).select("item_id", F.explode(F.array_compact(F.array(*broken))).alias("r")).select("item_id", "r.*")


def first_failures(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """(item_id, rule): the first rule that an item breaks. The row itself tells: rules behind a broken one are not asked, and no
    rows are gathered by item, so an id that stands twice counts twice."""
    first = reduce(lambda asked, rule: asked.when(~F.coalesce(rule[2], F.lit(False)), F.lit(rule[0])), rules, F)
    # A filter would be pushed below this column and ask all rules twice.
    return _prepared(items).select("item_id", F.explode(F.array_compact(F.array(first))).alias("rule"))


def sound(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """items with `sound`: whether no rule is broken, known from the row itself."""
    every = reduce(lambda a, b: a & b, (F.coalesce(ok, F.lit(False)) for _, _, ok in rules))
    return _prepared(items).withColumn("sound", every).drop("_broken", "_valid", "_sizes")


def balance(items: DataFrame) -> DataFrame:
    """(scope, level, n, sound): gold labels at N/4 each, or within five where four does not divide N; of a hundred items at
    least 25 of each scenario. A label or scenario without items is a row of 0."""
    total = items.agg(F.count("*").alias("total"))
    gold = items.groupBy(F.col("gold").alias("level")).agg(F.count("*").alias("n"))
    wanted = items.sparkSession.createDataFrame([(x,) for x in LABELS], "level string").join(gold, "level", "left").fillna(0)
    golds = wanted.join(total).select(F.lit("gold").alias("scope"), "level", "n", F.when(F.col("total") % 4 == 0, F.col("n") * 4 == F.col("total")).otherwise(F.abs(F.col("n") - F.col("total") / 4) <= 5).alias("sound"))
    scenarios = items.groupBy(F.col("scenario").alias("level")).agg(F.count("*").alias("n"))
    known = items.sparkSession.createDataFrame([(s[0],) for s in catalog.SCENARIOS], "level string").join(scenarios, "level", "left").fillna(0)
    return golds.unionByName(known.join(total).select(F.lit("scenario").alias("scope"), "level", "n", ((F.col("total") != 100) | (F.col("n") >= 25)).alias("sound")))


def catalog_violations(spark) -> DataFrame:
    """(key, rule) of catalog rows that break an invariant: two unlike texts that are not empty, a scenario at least, a known
    category."""
    rows = catalog.attributes(spark)
    rules = [("two_texts", (F.col("text_true") != "") & (F.col("text_false") != "") & (F.col("text_true") != F.col("text_false"))), ("some_scenario", F.size("scenarios") > 0), ("category_allowed", F.col("category").isin(*sorted({c for s in catalog.SCENARIOS for c in s[2]})))]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return rows.select("key", F.explode(broken).alias("rule"))
