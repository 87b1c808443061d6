"""Rollups by factor, cell and dimension, inventories, flags and rechecks, over runs with known constraints and over debates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions import scalar as S
from caselattice.operators import debate as D
from caselattice.operators import diagnostics as G
from caselattice.operators import runs as R
from caselattice.plans.evaluation import _C, _H, _MOVES
from caselattice.plans.registry import query
from caselattice.sources import views as X
from caselattice.sources.views import PICK_SQL, RUN_SQL

_P = f"WITH {PICK_SQL}"
_R = f"WITH {RUN_SQL}"
FACTORS = {"cl": ["CL1", "CL2", "CL3"], "ds": ["DS1", "DS2", "DS3"], "il": ["IL1", "IL2"]}
_DIMENSIONS = ["model_alias", "cl", "ds", "il", "scenario", "k", "gold"]


@query("agg09b_seven_dimensions", _P + " " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS level, count(*) AS n, round(count(*) FILTER (correct) / count(*), 6) AS accuracy, round(count(*) FILTER (valid) / count(*), 6) AS valid_rate, round(count(*) FILTER (extractable) / count(*), 6) AS extractable_rate FROM picks GROUP BY {d}" for d in _DIMENSIONS))
def agg09b(spark, sf):
    """Accuracy and parse rates by seven dimensions: one grouping set each, one pass (AGG-09, AGG-05)."""
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in _DIMENSIONS])
    name = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in _DIMENSIONS])
    share = lambda c: F.round(S.rate_or_zero(F.col(c)), 6)
    found = X.picks(spark, sf).groupingSets([[F.col(d)] for d in _DIMENSIONS], *[F.col(d) for d in _DIMENSIONS])
    return found.agg(name.alias("dimension"), level.alias("level"), F.count("*").alias("n"), share("correct").alias("accuracy"), share("valid").alias("valid_rate"), share("extractable").alias("extractable_rate")).select("dimension", "level", "n", "accuracy", "valid_rate", "extractable_rate")


@query("agg19b_marginal_factors", _P + " " + " UNION ALL ".join(f"SELECT model_alias, '{f}' AS factor, {f} AS level, count(*) AS n, count(*) FILTER (valid) AS n_valid, round(count(*) FILTER (correct) / nullif(count(*) FILTER (valid), 0), 6) AS accuracy FROM picks GROUP BY model_alias, {f}" for f in FACTORS))
def agg19b(spark, sf):
    """Each factor's levels with the others pooled (AGG-19, AGG-21)."""
    m, factors = F.col("model_alias"), [F.col(f) for f in FACTORS]
    name = F.coalesce(*[F.when(F.grouping(f) == 0, F.lit(f)) for f in FACTORS])
    found = X.picks(spark, sf).groupingSets([[m, f] for f in factors], m, *factors)
    return found.agg(name.alias("factor"), F.coalesce(*[F.when(F.grouping(f) == 0, F.col(f)) for f in FACTORS]).alias("level"), F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), S.ratio(F.count_if("correct"), F.count_if("valid")).alias("accuracy")).select("model_alias", "factor", "level", "n", "n_valid", "accuracy")


def _slices_sql(f: str) -> str:
    a, b = (x for x in FACTORS if x != f)
    rate = lambda x: f"round(count(*) FILTER (correct AND {f} = '{x}') / nullif(count(*) FILTER (valid AND {f} = '{x}'), 0), 6)"
    return f"SELECT model_alias, '{f}' AS factor, {a} || '__' || {b} AS held, [{', '.join(rate(x) for x in FACTORS[f])}] AS rates FROM picks GROUP BY model_alias, {a}, {b}"


@query("agg19c_controlled_slices", _P + ", s AS (" + " UNION ALL ".join(_slices_sql(f) for f in FACTORS) + """) SELECT model_alias, factor, held, CASE WHEN len(list_filter(rates, lambda x: x IS NULL)) > 0 THEN 'incomplete' WHEN list_min(rates) = list_max(rates) THEN 'flat' WHEN rates = list_reverse_sort(rates) THEN 'higher_level_harder_or_equal' WHEN rates = list_sort(rates) THEN 'higher_level_easier_or_equal' ELSE 'nonmonotonic' END AS trend,
round(rates[len(rates)] - rates[1], 6) AS change FROM s""")
def agg19c(spark, sf):
    """Each factor along its levels with the two others held, and its trend (AGG-19, WIN-05)."""
    runs, out = X.picks(spark, sf), []
    for f, levels in FACTORS.items():
        a, b = (x for x in FACTORS if x != f)
        rates = F.array(*[S.ratio(F.count_if(F.col("correct") & (F.col(f) == x)), F.count_if(F.col("valid") & (F.col(f) == x))) for x in levels])
        out.append(runs.groupBy("model_alias", F.concat_ws("__", a, b).alias("held")).agg(F.lit(f).alias("factor"), rates.alias("rates")))
    found = reduce(lambda x, y: x.unionByName(y), out)
    r = F.col("rates")
    trend = F.when(F.exists(r, lambda x: x.isNull()), "incomplete").when(F.array_min(r) == F.array_max(r), "flat").when(r == F.sort_array(r, asc=False), "higher_level_harder_or_equal").when(r == F.sort_array(r), "higher_level_easier_or_equal").otherwise("nonmonotonic")
    return found.select("model_alias", "factor", "held", trend.alias("trend"), F.round(F.element_at(r, -1) - F.get(r, F.lit(0)), 6).alias("change"))


@query("agg21_endpoint_trends", _P + ", e AS (" + " UNION ALL ".join(f"SELECT model_alias, '{f}' AS factor, round(count(*) FILTER (correct AND {f} = '{x[0]}') / nullif(count(*) FILTER (valid AND {f} = '{x[0]}'), 0), 6) AS low, round(count(*) FILTER (correct AND {f} = '{x[-1]}') / nullif(count(*) FILTER (valid AND {f} = '{x[-1]}'), 0), 6) AS high FROM picks GROUP BY model_alias" for f, x in FACTORS.items()) + ") SELECT *, CASE WHEN low IS NULL OR high IS NULL THEN 'not_applicable' WHEN high < low THEN 'higher_level_lower_accuracy' WHEN high > low THEN 'higher_level_higher_accuracy' ELSE 'endpoint_tie' END AS trend FROM e")
def agg21(spark, sf):
    """First against last level of each factor (AGG-21)."""
    marginal = agg19b(spark, sf)
    ends = F.create_map(*[F.lit(x) for f, levels in FACTORS.items() for x in (f, levels[0])]), F.create_map(*[F.lit(x) for f, levels in FACTORS.items() for x in (f, levels[-1])])
    at = lambda m: F.max(F.when(F.col("level") == F.element_at(m, F.col("factor")), F.col("accuracy")))
    found = marginal.groupBy("model_alias", "factor").agg(at(ends[0]).alias("low"), at(ends[1]).alias("high"))
    trend = F.when(F.col("low").isNull() | F.col("high").isNull(), "not_applicable").when(F.col("high") < F.col("low"), "higher_level_lower_accuracy").when(F.col("high") > F.col("low"), "higher_level_higher_accuracy").otherwise("endpoint_tie")
    return found.withColumn("trend", trend)


_CELL = """, r AS (SELECT model_alias, cl, ds, il, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(*) FILTER (correct) AS n_correct, count(*) FILTER (valid AND NOT correct AND s.n = 1) AS single, count(*) FILTER (valid AND NOT correct AND s.n >= 2) AS multi, count(*) FILTER (valid AND NOT correct) AS wrong FROM picks p LEFT JOIN sigs s ON s.item_id = p.item_id AND s.label = p.answer GROUP BY ALL),
i AS (SELECT model_alias, cl, ds, il, item_id, count(*) FILTER (valid) AS v, count(*) FILTER (correct) AS c, count(DISTINCT answer) FILTER (valid) AS kinds FROM picks GROUP BY ALL),
b AS (SELECT model_alias, cl, ds, il, count(*) FILTER (v = 3) AS complete, count(*) FILTER (v = 3 AND kinds >= 2) AS disagree, count(*) FILTER (v = 3 AND c BETWEEN 1 AND 2) AS coexist FROM i GROUP BY ALL)"""


@query("agg17b_cells", _P + _CELL + """ SELECT r.model_alias, r.cl, r.ds, r.il, n, n_valid, round(n_correct / n, 6) AS accuracy_all, round(n_correct / nullif(n_valid, 0), 6) AS accuracy_valid, round(single / nullif(wrong, 0), 6) AS single_rate, round(multi / nullif(wrong, 0), 6) AS multi_rate, complete, round(disagree / nullif(complete, 0), 6) AS disagreement_rate, round(coexist / nullif(complete, 0), 6) AS coexist_rate FROM r JOIN b USING (model_alias, cl, ds, il)""")
def agg17b(spark, sf):
    """Cells of three factors: each rate over its own denominator, disagreement over complete items alone (AGG-17, AGG-18, AGG-16)."""
    runs, cell = X.picks(spark, sf), ["model_alias", "cl", "ds", "il"]
    wrong = F.col("valid") & ~F.col("correct")
    n = F.size("selected")
    rated = runs.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), S.ratio(F.count_if("correct"), F.count("*")).alias("accuracy_all"), S.ratio(F.count_if("correct"), F.count_if("valid")).alias("accuracy_valid"), S.ratio(F.count_if(wrong & (n == 1)), F.count_if(wrong)).alias("single_rate"), S.ratio(F.count_if(wrong & (n >= 2)), F.count_if(wrong)).alias("multi_rate"))
    whole = F.col("complete")
    items = G.behaviour(runs, 3, *cell).groupBy(*cell).agg(F.count_if(whole).alias("complete"), S.ratio(F.count_if(F.col("complete") & F.col("disagrees")), F.count_if("complete")).alias("disagreement_rate"), S.ratio(F.count_if(F.col("complete") & F.col("mixed")), F.count_if("complete")).alias("coexist_rate"))
    return rated.join(items, cell)


@query("agg16b_item_model_observations", _P + """ SELECT item_id, model_alias, count(*) AS n_runs, count(*) FILTER (valid) AS n_valid, count(*) FILTER (correct) AS n_correct, count(*) FILTER (valid AND NOT correct) AS n_valid_wrong, count(*) FILTER (NOT extractable) AS n_unrecognised, coalesce(string_agg(DISTINCT answer, ',' ORDER BY answer) FILTER (valid AND NOT correct), '') AS wrong_options, coalesce(string_agg(run_id || ':' || answer, ',' ORDER BY run_id) FILTER (valid AND NOT correct), '') AS wrong_observations, count(*) FILTER (valid) = 3 AS complete FROM picks GROUP BY item_id, model_alias""")
def agg16b(spark, sf):
    """An item under a model: counts, wrong options and observations, completeness (AGG-16, AGG-23)."""
    wrong = F.col("valid") & ~F.col("correct")
    seen = F.array_sort(F.collect_list(F.when(wrong, F.struct("run_id", "answer"))))
    return X.picks(spark, sf).groupBy("item_id", "model_alias").agg(
        F.count("*").alias("n_runs"), F.count_if("valid").alias("n_valid"), F.count_if("correct").alias("n_correct"), F.count_if(wrong).alias("n_valid_wrong"), F.count_if(~F.col("extractable")).alias("n_unrecognised"),
        F.array_join(F.array_sort(F.collect_set(F.when(wrong, F.col("answer")))), ",").alias("wrong_options"), F.array_join(F.transform(seen, lambda x: F.concat_ws(":", x["run_id"].cast("string"), x["answer"])), ",").alias("wrong_observations"), (F.count_if("valid") == 3).alias("complete"),
    )


@query("agg12b_predictiveness", _P + """, a AS (SELECT model_alias, ds, round(count(*) FILTER (correct) / count(*), 6) AS acc FROM picks WHERE ds <> 'other' GROUP BY ALL), l AS (SELECT *, lag(acc) OVER (PARTITION BY model_alias ORDER BY ds) AS before FROM a), s AS (SELECT model_alias, count(*) AS levels, round(max(acc) - min(acc), 6) AS span, bool_and(before IS NULL OR acc <= before) AS monotone FROM l GROUP BY model_alias)
SELECT *, CASE WHEN levels < 2 THEN 'insufficient_data' WHEN monotone AND span >= 0.05 THEN 'predictive_in_expected_direction' WHEN span < 0.03 THEN 'weak_or_no_observed_relationship' ELSE 'mixed_or_non_monotonic_relationship' END AS relation FROM s""")
def agg12b(spark, sf):
    """Span and fall along a factor, and what they are called (AGG-12)."""
    rates = X.picks(spark, sf).filter("ds != 'other'").groupBy("model_alias", "ds").agg(S.ratio(F.count_if("correct"), F.count("*")).alias("acc"))
    before = F.lag("acc").over(W.partitionBy("model_alias").orderBy("ds"))
    found = rates.withColumn("ok", before.isNull() | (F.col("acc") <= before)).groupBy("model_alias").agg(F.count("*").alias("levels"), F.round(F.max("acc") - F.min("acc"), 6).alias("span"), F.bool_and("ok").alias("monotone"))
    relation = F.when(F.col("levels") < 2, "insufficient_data").when(F.col("monotone") & (F.col("span") >= 0.05), "predictive_in_expected_direction").when(F.col("span") < 0.03, "weak_or_no_observed_relationship").otherwise("mixed_or_non_monotonic_relationship")
    return found.withColumn("relation", relation)


def _damaged(spark, sf):
    runs = X.runs(spark, sf)
    h = S.draw(F.col("item_id"), F.col("model_alias"), F.col("run_id")) % 50
    copies = F.when(F.col("h") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return runs, runs.withColumn("h", h).filter("h != 0").select(F.when(F.col("h") == 2, F.col("item_id") + 100000).otherwise(F.col("item_id")).alias("item_id"), "model_alias", "run_id", F.explode(copies).alias("copy")).drop("copy")


@query("agg33_duplicate_contracts", _R + f""", broken AS (SELECT CASE WHEN {_H} = 2 THEN item_id + 100000 ELSE item_id END AS item_id, model_alias, run_id FROM runs, (SELECT unnest(range(2)) AS copy) WHERE {_H} <> 0 AND (copy = 0 OR {_H} = 1)), seen AS (SELECT item_id, model_alias, run_id, count(*) AS n FROM broken GROUP BY ALL),
wanted AS (SELECT i.item_id, m.model_alias, r AS run_id FROM (SELECT DISTINCT item_id FROM runs) i, (SELECT DISTINCT model_alias FROM runs) m, (SELECT unnest(range(1, 4)) AS r))
SELECT (SELECT sum(n)::BIGINT FROM seen) AS n_rows, (SELECT count(*) FILTER (n > 1) FROM seen) AS duplicate_keys, (SELECT sum(n - 1)::BIGINT FROM seen) AS rows_beyond_first, (SELECT count(*) FROM wanted w ANTI JOIN seen s ON s.item_id = w.item_id AND s.model_alias = w.model_alias AND s.run_id = w.run_id) AS n_missing, (SELECT count(*) FROM seen s ANTI JOIN wanted w ON s.item_id = w.item_id AND s.model_alias = w.model_alias AND s.run_id = w.run_id) AS n_unknown""")
def agg33(spark, sf):
    """Two ways to count duplicates of a damaged log, with its missing and unknown keys (AGG-14, AGG-32, AGG-33)."""
    runs, damaged = _damaged(spark, sf)
    keys = ["item_id", "model_alias", "run_id"]
    seen = damaged.groupBy(*keys).agg(F.count("*").alias("n"))
    both = R.grid(runs, runs, [1, 2, 3]).withColumn("wanted", F.lit(True)).join(seen, keys, "full")
    return both.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum(F.col("n") - 1).alias("rows_beyond_first"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("wanted").isNull()).alias("n_unknown"))


@query("agg26b_consensus_rates", _C + """, r AS (SELECT item_id, family, round, count(*) = count(answer) AND count(DISTINCT answer) = 1 AS agreed FROM calls GROUP BY ALL) SELECT family, round, count(*) AS n_rounds, count(*) FILTER (agreed) AS n_agreed, round(count(*) FILTER (agreed) / count(*), 6) AS consensus_rate FROM r GROUP BY family, round""")
def agg26b(spark, sf):
    """Share of rounds in which all agree (AGG-26, AGG-28)."""
    return D.majorities(X.calls(spark, sf)).groupBy("family", "round").agg(F.count("*").alias("n_rounds"), F.count_if("consensus").alias("n_agreed"), S.ratio(F.count_if("consensus"), F.count("*")).alias("consensus_rate"))


@query("agg27b_transition_types", _C + _MOVES + """SELECT family, kind AS transition_type, count(*) AS n, count(*) FILTER (event = 'harmful_revision' AND len(list_filter(to_violations, lambda x: NOT list_contains(violations, x))) = 1) AS harmful_one, count(*) FILTER (event = 'harmful_revision' AND len(list_filter(to_violations, lambda x: NOT list_contains(violations, x))) >= 2) AS harmful_more, count(*) FILTER (valid AND len(list_filter(to_violations, lambda x: NOT list_contains(violations, x))) > 0) AS introducing FROM happened GROUP BY family, kind""")
def agg27b(spark, sf):
    """Transitions by type, harmful ones by the constraints that they break (AGG-27)."""
    harmful, n = F.col("objective_event") == "harmful_revision", F.size("introduced")
    return D.transitions(X.calls(spark, sf)).groupBy("family", "transition_type").agg(F.count("*").alias("n"), F.count_if(harmful & (n == 1)).alias("harmful_one"), F.count_if(harmful & (n >= 2)).alias("harmful_more"), F.count_if(n > 0).alias("introducing"))


@query("flt17_key_cases", _C + _MOVES + """SELECT item_id, family, agent_id, round AS from_round, event AS objective_event FROM happened WHERE event IN ('harmful_revision', 'successful_correction') OR (event = 'wrong_to_wrong_migration' AND changed)""")
def flt17(spark, sf):
    """The three selections of key cases (FLT-17)."""
    keep = F.col("objective_event").isin("harmful_revision", "successful_correction") | ((F.col("objective_event") == "wrong_to_wrong_migration") & F.col("changed"))
    return D.transitions(X.calls(spark, sf)).filter(keep).select("item_id", "family", "agent_id", "from_round", "objective_event")


@query("flt19_debate_flags", _C + _MOVES + """SELECT coalesce((SELECT bool_or(NOT correct) FROM calls WHERE family = 'f0' AND pilot_group = 'vulnerable' AND round = 0), false) AS weakness_continues, coalesce((SELECT bool_and(correct) FROM calls WHERE family = 'f1' AND pilot_group = 'stable_control'), true) AS stays_stable, coalesce((SELECT bool_and(correct) FROM calls WHERE family = 'none'), true) AS stable_without_rows, (SELECT count(*) FROM happened WHERE kind IN ('correct_to_wrong', 'wrong_to_correct') OR (kind = 'wrong_to_wrong' AND changed)) > 0 AS structured_events""")
def flt19(spark, sf):
    """Some and all over nested rounds: all of nothing holds, some of nothing does not (FLT-19)."""
    calls = X.calls(spark, sf)
    some = lambda c, where: F.coalesce(F.bool_or(F.when(where, c)), F.lit(False))
    every = lambda c, where: F.coalesce(F.bool_and(F.when(where, c)), F.lit(True))
    is_ = lambda f, g: (F.col("family") == f) & (F.col("pilot_group") == g)
    flags = calls.agg(some(~F.col("correct"), is_("f0", "vulnerable") & (F.col("round") == 0)).alias("weakness_continues"), every(F.col("correct"), is_("f1", "stable_control")).alias("stays_stable"), every(F.col("correct"), F.col("family") == "none").alias("stable_without_rows"))
    kind = F.col("transition_type")
    events = D.transitions(calls).agg((F.count_if(kind.isin("correct_to_wrong", "wrong_to_correct") | ((kind == "wrong_to_wrong") & F.col("changed"))) > 0).alias("structured_events"))
    return flags.crossJoin(events)


@query("jon19_recheck", _P + """, stored AS (SELECT item_id, model_alias, run_id, CASE WHEN x % 17 = 0 THEN NOT correct ELSE correct END AS was_correct, correct AS is_correct, x FROM (SELECT *, ('0x' || substr(md5('stored|' || item_id || '|' || model_alias || '|' || run_id), 1, 8))::UBIGINT AS x FROM picks)) SELECT item_id, model_alias, run_id, was_correct, is_correct FROM stored WHERE was_correct IS DISTINCT FROM is_correct""")
def jon19(spark, sf):
    """Stored columns against recomputed ones: the rows that differ (JON-19). One row in 17 was stored wrong."""
    picks = X.picks(spark, sf)
    x = S.draw(F.lit("stored"), F.col("item_id"), F.col("model_alias"), F.col("run_id")) % 17
    stored = picks.select("item_id", "model_alias", "run_id", F.when(x == 0, ~F.col("correct")).otherwise(F.col("correct")).alias("was_correct"))
    again = picks.select("item_id", "model_alias", "run_id", F.col("correct").alias("is_correct"))
    return stored.join(again, ["item_id", "model_alias", "run_id"]).filter(~F.col("was_correct").eqNullSafe(F.col("is_correct")))


@query("agg01b_distributions", _P + " " + " UNION ALL ".join(f"SELECT '{d}' AS distribution, {d}::VARCHAR AS level, count(*) AS n FROM signed GROUP BY {d}" for d in ("scenario", "cl", "ds", "il", "gold", "k")) + " UNION ALL SELECT 'wrong_size', n::VARCHAR, count(*) FROM sigs JOIN signed USING (item_id) WHERE n > 0 GROUP BY n UNION ALL SELECT 'polarity', required_value::VARCHAR, count(*) FROM constraints JOIN signed USING (item_id) GROUP BY 2 UNION ALL SELECT 'attribute', attr, count(*) FROM constraints JOIN signed USING (item_id) GROUP BY attr UNION ALL SELECT 'excluded_by', constraint_id, count(*) FROM matrix JOIN signed USING (item_id) WHERE NOT satisfied GROUP BY constraint_id")
def agg01b(spark, sf):
    """Ten distributions over the items: an item becomes one row for each thing that it counts for (AGG-01, AGG-02, AGG-43)."""
    one = lambda d, level: F.array(F.struct(F.lit(d).alias("distribution"), level.cast("string").alias("level")))
    many = lambda d, values: F.transform(values, lambda v: F.struct(F.lit(d).alias("distribution"), v.cast("string").alias("level")))
    broken = F.flatten(F.map_values("sigs"))
    rows = F.concat(*[one(d, F.col(d)) for d in ("scenario", "cl", "ds", "il", "gold", "k")], many("wrong_size", F.col("wrong")), many("polarity", F.transform("constraints", lambda c: c["required_value"])), many("attribute", F.transform("constraints", lambda c: c["attribute"])), many("excluded_by", broken))
    return X.signed_items(spark, sf).select(F.explode(rows).alias("r")).groupBy("r.distribution", "r.level").agg(F.count("*").alias("n"))


@query("top05b_items_per_category", _R + """, a AS (SELECT item_id, count(*) FILTER (correct) AS c FROM runs GROUP BY item_id), k AS (SELECT item_id, CASE WHEN c = 6 THEN 'stable_correct' WHEN c = 5 THEN 'mildly_vulnerable' WHEN c BETWEEN 2 AND 4 THEN 'mixed_correctness' ELSE 'mostly_wrong' END AS category FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id) AS rn FROM k) SELECT category, item_id, rn::INT AS rn FROM r WHERE rn <= CASE category WHEN 'mixed_correctness' THEN 10 ELSE 5 END""")
def top05b(spark, sf):
    """At most five items of each category, ten of the mixed ones (TOP-05): least ids of blocks first, then of all."""
    found = R.item_analysis(X.runs(spark, sf)).select("category", "item_id", F.when(F.col("category") == "mixed_correctness", 10).otherwise(5).alias("most"))
    blocks = found.groupBy("category", "most", F.floor(F.col("item_id") / 4096).alias("block")).agg(F.slice(F.array_sort(F.collect_list("item_id")), 1, 10).alias("ids"))
    few = blocks.select("category", "most", F.explode("ids").alias("item_id"))
    return few.withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy("item_id"))).filter("rn <= most").select("category", "item_id", "rn")


@query("win10b_filled_strata", _P + """, o AS (SELECT item_id, cl, scenario, ('0x' || substr(md5('42|' || item_id), 1, 8))::UBIGINT AS d FROM signed), r AS (SELECT *, row_number() OVER (PARTITION BY cl, scenario ORDER BY d, item_id) AS rn FROM o) SELECT item_id, cl, scenario, rn > 1 AS filled FROM r ORDER BY rn > 1, CASE WHEN rn > 1 THEN '' ELSE cl || scenario END, d, item_id LIMIT 30""")
def win10b(spark, sf):
    """The first of each stratum in hash order, then the rest in hash order until there are 30 (WIN-10, RND-13)."""
    strata, d = ["cl", "scenario"], S.draw(F.lit(42), F.col("item_id"))
    items = X.signed_items(spark, sf).select("item_id", *strata, d.alias("d"))
    first = items.groupBy(*strata).agg(F.min_by("item_id", F.struct("d", "item_id")).alias("first"))
    marked = items.join(first, strata).withColumn("filled", F.col("item_id") != F.col("first"))
    place = F.when(F.col("filled"), "").otherwise(F.concat(*strata))
    return marked.orderBy("filled", place, "d", "item_id").limit(30).select("item_id", *strata, "filled")


@query("set04_set_relations", _P + """, a AS (SELECT s.item_id, list(constraint_id ORDER BY pos) FILTER (NOT satisfied AND label = 'A') AS a, list(constraint_id ORDER BY pos) FILTER (NOT satisfied AND label = 'B') AS b FROM signed s JOIN matrix m USING (item_id) GROUP BY s.item_id), n AS (SELECT item_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM a)
SELECT item_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS a_in_b, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS b_in_a, a = b AS equal, len(list_intersect(a, b)) = 0 AS disjoint FROM n""")
def set04(spark, sf):
    """Subset, superset, equality and disjointness of two signatures (SET-04, SET-06, SET-08)."""
    a, b = F.element_at("sigs", "A"), F.element_at("sigs", "B")
    return X.signed_items(spark, sf).select("item_id", (F.size(F.array_except(a, b)) == 0).alias("a_in_b"), (F.size(F.array_except(b, a)) == 0).alias("b_in_a"), (F.array_sort(a) == F.array_sort(b)).alias("equal"), (~F.arrays_overlap(a, b)).alias("disjoint"))


@query("prj17_split_index", _R + """, s AS (SELECT 'dev' AS split, item_id, min(event_id) AS event_id FROM runs WHERE run_id = 1 GROUP BY item_id UNION ALL SELECT 'val', item_id, min(event_id) FROM runs WHERE run_id > 1 GROUP BY item_id) SELECT split, item_id, event_id, row_number() OVER (PARTITION BY split ORDER BY item_id) AS idx, item_id || '_' || split AS variant_id FROM s""")
def prj17(spark, sf):
    """Two splits with an index from 1 in each, and variant ids; without one the item's own (PRJ-16, PRJ-17, SET-07, WIN-08)."""
    runs = X.runs(spark, sf)
    part = lambda where, name: runs.filter(where).groupBy("item_id").agg(F.min("event_id").alias("event_id")).withColumn("split", F.lit(name))
    both = part("run_id = 1", "dev").unionByName(part("run_id > 1", "val"))
    made = F.coalesce(F.nullif(F.concat_ws("_", F.col("item_id").cast("string"), "split"), F.lit("")), F.col("item_id").cast("string"))
    return R.placed(both, "split", "item_id").select("split", "item_id", "event_id", (F.col("pos") + 1).alias("idx"), made.alias("variant_id"))
