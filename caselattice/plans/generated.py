"""Queries over catalogs, generated items and their variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselattice.functions import answers as A
from caselattice.functions import scalar as S
from caselattice.operators import debate as D
from caselattice.operators import generation as G
from caselattice.operators import matrix as M
from caselattice.operators import validation as V
from caselattice.plans.registry import query
from caselattice.sources import catalog as C
from caselattice.sources import views as X
from caselattice.sources.views import CALL_SQL, RUN_SQL

PER_CELL, SEED = 12, 42
_CATALOG = f"""WITH attrs(key, category, may_be_false, scenarios, t, f) AS ({C.values_sql(C.ATTRIBUTES)}), scen(scenario, title, categories, keys) AS ({C.values_sql(C.SCENARIOS)}), facts(key, category, text, scenarios) AS ({C.values_sql(C.FACTS)}) """


@query("src06_catalogs", _CATALOG + "SELECT 'attribute' AS catalog, category, count(*) AS n FROM attrs GROUP BY category UNION ALL SELECT 'fact', category, count(*) FROM facts GROUP BY category UNION ALL SELECT 'scenario', scenario, 1 FROM scen")
def src06(spark, sf):
    """Catalog rows by category (SRC-06, SRC-07, SRC-08)."""
    count = lambda df, name, by: df.groupBy(F.col(by).alias("category")).agg(F.count("*").alias("n")).select(F.lit(name).alias("catalog"), "category", "n")
    return count(C.attributes(spark), "attribute", "category").unionByName(count(C.facts(spark), "fact", "category")).unionByName(count(C.scenarios(spark), "scenario", "scenario"))


@query("prj21_eligible_attributes", _CATALOG + "SELECT scenario, key, a.category, may_be_false FROM attrs a JOIN scen s ON list_contains(a.scenarios, s.scenario) AND list_contains(s.categories, a.category) AND (s.keys IS NULL OR list_contains(s.keys, a.key))")
def prj21(spark, sf):
    """Attributes that a scenario allows; a null list allows all (PRJ-21, PRJ-22, PRJ-23)."""
    return G.eligible(spark)


@query("rnd08_generated_cells", f"WITH i AS (SELECT unnest(range({18 * PER_CELL})) AS id), c AS (SELECT 'CL' || (id // {6 * PER_CELL} + 1) AS cl, 'DS' || (id // {2 * PER_CELL} % 3 + 1) AS ds, 'IL' || (id // {PER_CELL} % 2 + 1) AS il, id % 4 AS gold FROM i), g AS (SELECT cl, ds, il, gold, count(*) AS n FROM c GROUP BY ALL) SELECT cl, ds, il, sum(n)::BIGINT AS n, sum(n)::BIGINT AS n_sound, min(n) AS least_gold FROM g GROUP BY ALL")
def rnd08(spark, sf):
    """Generated pools hold what they were made for: validated from their candidates alone (RND-01 to RND-08, FLT-08, FLT-12)."""
    items = G.generate(spark, PER_CELL, SEED)
    found = items.join(M.item_signatures(G.candidates_of(items), items).withColumnRenamed("wrong", "sizes").withColumnRenamed("gold", "found_gold"), "item_id")
    sound = (F.col("found_gold") == F.col("gold")) & (V.distractor_level(F.col("sizes"), F.col("k")) == F.col("ds")) & (F.size(F.array_distinct(F.transform("constraints", lambda c: c["attribute"]))) == F.col("k"))
    per_gold = found.groupBy("cl", "ds", "il", "gold").agg(F.count("*").alias("n"), F.count_if(sound).alias("s"))
    return per_gold.groupBy("cl", "ds", "il").agg(F.sum("n").alias("n"), F.sum("s").alias("n_sound"), F.min("n").alias("least_gold"))


@query("scl12b_rendered_options", f"SELECT item_id, 4::BIGINT AS n_options, 4 * [3, 5, 7][(item_id // {6 * PER_CELL} + 1)::INT]::BIGINT AS n_facts, true AS all_closed FROM (SELECT unnest(range({18 * PER_CELL})) AS item_id)")
def scl12b(spark, sf):
    items = G.generate(spark, PER_CELL, SEED)
    texts = G.rendered(spark, items, G.candidates_of(items))
    return texts.groupBy("item_id").agg(F.count("*").alias("n_options"), F.sum(F.size(F.split("option", ", "))).alias("n_facts"), F.bool_and(F.endswith("option", F.lit("."))).alias("all_closed"))


@query("scl13_translated_facts", f"SELECT a.key, v AS value, t.text, coalesce(length(t.text), 0) AS n, t.key IS NULL AS missing FROM (SELECT key, unnest([true, false]) AS v FROM ({C.values_sql(C.ATTRIBUTES)}) x(key, category, may_be_false, scenarios, t, f)) a LEFT JOIN ({C.values_sql([(k, v, t) for (k, v), t in C.TRANSLATIONS.items()])}) t(key, value, text) ON t.key = a.key AND t.value = a.v")
def scl13(spark, sf):
    """Facts looked up in the dictionary by key and value; one that it lacks is a marked row, not a row less (SCL-13, FLT-20)."""
    facts = C.attributes(spark).select("key", F.explode(F.array(F.lit(True), F.lit(False))).alias("value"))
    found = facts.join(F.broadcast(C.translations(spark)), ["key", "value"], "left")
    return found.select("key", "value", "text", F.coalesce(S.cjk_count(F.col("text")), F.lit(0)).cast("long").alias("n"), F.col("text").isNull().alias("missing"))


@query("jon17_answers_by_name", f"""WITH {RUN_SQL}, pool AS (SELECT {C.values_sql([(C.NAMES,)])[8:-1]} AS names), n AS (SELECT r.*, names[((item_id + ascii(answer) - 65) % {len(C.NAMES)} + 1)::INT] AS own, names[((item_id + event_id) % {len(C.NAMES)} + 1)::INT] AS said, names FROM runs r, pool)
SELECT item_id, model_alias, run_id, CASE list_position(list_transform(range(4), lambda i: names[((item_id + i) % {len(C.NAMES)} + 1)::INT]), said) WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' END AS label FROM n""")
def jon17(spark, sf):
    """Names said, in any case and with blanks and a dot, against the item's four candidates: others map to none (JON-17, MAP-01)."""
    names = F.array(*[F.lit(n) for n in C.NAMES])
    at = lambda i: F.element_at(names, (F.pmod(i, F.lit(len(C.NAMES))) + 1).cast("int"))
    own = A.name_map(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: at(F.col("item_id") + i)))
    said = F.concat(F.lit(" \t"), F.upper(at(F.col("item_id") + F.col("event_id"))), F.lit(".\n"))
    told = X.runs(spark, sf).withColumns({"raw": said, "names": own})
    return told.select("item_id", "model_alias", "run_id", F.element_at("names", F.lower(F.regexp_replace(A.strip(F.col("raw")), r"\.+\z", ""))).alias("label"))


@query("jsn11_polymorphic_answers", f"""WITH {RUN_SQL} SELECT ['STRING', 'ARRAY<STRING>', 'BIGINT', 'BOOLEAN', 'VOID'][(event_id % 5)::INT + 1] AS kind, count(*) AS n, count(*) FILTER (event_id % 5 = 0 AND answer IS NOT NULL) AS n_labels FROM runs GROUP BY 1""")
def jsn11(spark, sf):
    """Answers of several types in one field, by their type (JSN-11)."""
    runs = X.runs(spark, sf)
    one = F.concat(F.lit('"'), F.coalesce("answer", F.lit("?")), F.lit('"'))
    value = F.element_at(F.array(one, F.concat(F.lit("["), one, F.lit("]")), F.lit("1"), F.lit("true"), F.lit("null")), (F.col("event_id") % 5 + 1).cast("int"))
    held = F.try_variant_get(A.whole_json(F.concat(F.lit('{"a": '), value, F.lit("}"))), "$.a", "variant")
    kind = F.schema_of_variant(held)
    label = F.when(kind == "STRING", A.strict_label(F.try_variant_get(held, "$", "string")))
    return runs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count(label).alias("n_labels"))


@query("agg34_position_effects", f"WITH {RUN_SQL}, a AS (SELECT item_id, run_id - 1 AS rotation, round(count(*) FILTER (correct) / count(*), 6) AS acc, count(DISTINCT answer) FILTER (NOT correct) AS wrong_kinds, count(answer) FILTER (NOT correct) AS n_wrong FROM runs GROUP BY ALL) SELECT item_id, count(*) AS n_rotations, count(DISTINCT acc) > 1 AS changes, bool_or(n_wrong > 1 AND wrong_kinds = 1) AS same_wrong FROM a GROUP BY item_id")
def agg34(spark, sf):
    """Accuracy by rotation, and whether it changes; runs stand for rotations here (AGG-34, AGG-44, JON-13)."""
    wrong = F.when(~F.col("correct"), F.col("answer"))
    by = X.runs(spark, sf).groupBy("item_id", (F.col("run_id") - 1).alias("rotation")).agg(S.ratio(F.count_if("correct"), F.count("*")).alias("acc"), F.countDistinct(wrong).alias("kinds"), F.count(wrong).alias("n"))
    return by.groupBy("item_id").agg(F.count("*").alias("n_rotations"), (F.countDistinct("acc") > 1).alias("changes"), F.bool_or((F.col("n") > 1) & (F.col("kinds") == 1)).alias("same_wrong"))


STR05_SQL = f"WITH {CALL_SQL}, r AS (SELECT item_id, family, round, count(DISTINCT agent_id) = 3 AS whole FROM calls GROUP BY ALL) SELECT g.item_id, g.family, min(n) AS next_round FROM (SELECT DISTINCT item_id, family FROM calls) g, (SELECT unnest(range(0, (SELECT max(round) + 2 FROM calls))) AS n) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.item_id = g.item_id AND r.family = g.family AND r.round = n AND whole) GROUP BY g.item_id, g.family"


@query("str05_open_rounds", STR05_SQL)
def str05(spark, sf):
    """The first round that is not whole: it may start as all agents of the rounds before it are there (STR-05)."""
    return D.open_rounds(X.calls(spark, sf), 3)


@query("top09_review_order", f"WITH {RUN_SQL}, a AS (SELECT item_id, count(*) FILTER (correct) AS n_correct, count(DISTINCT answer) AS kinds FROM runs GROUP BY item_id) SELECT item_id, row_number() OVER (ORDER BY kinds DESC, n_correct, item_id)::INT AS position FROM a ORDER BY kinds DESC, n_correct, item_id LIMIT 15")
def top09(spark, sf):
    """The items to look at first (TOP-09, TOP-12): a top-k, then ranks over k rows."""
    from pyspark.sql import Window as W

    order = [F.desc("kinds"), "n_correct", "item_id"]
    found = X.runs(spark, sf).groupBy("item_id").agg(F.count_if("correct").alias("n_correct"), F.countDistinct("answer").alias("kinds"))
    return found.orderBy(*order).limit(15).select("item_id", F.row_number().over(W.orderBy(*order)).alias("position"))
