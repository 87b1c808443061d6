"""Queries over runs, debate calls and raw responses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions import answers as A
from caselattice.functions import scalar as S
from caselattice.operators import debate as D
from caselattice.operators import runs as R
from caselattice.operators import sampling as N
from caselattice.plans.registry import query
from caselattice.sources import views as X
from caselattice.sources.views import CALL_SQL, FOLLOWUP_SQL, PICK_SQL, RESPONSE_SQL, RUN_SQL

_R, _C = f"WITH {RUN_SQL} ", f"WITH {CALL_SQL} "
_CATEGORY = "CASE WHEN n_correct = 6 THEN 'stable_correct' WHEN n_correct = 5 THEN 'mildly_vulnerable' WHEN n_correct BETWEEN 2 AND 4 THEN 'mixed_correctness' ELSE 'mostly_wrong' END"
_DIFFICULTY = "CASE WHEN n_correct = 6 THEN 'very_easy' WHEN n_correct = 5 THEN 'easy' WHEN n_correct BETWEEN 2 AND 4 THEN 'medium' WHEN n_correct = 1 THEN 'hard' ELSE 'very_hard' END"


@query("src03_completed_keys", _R + "SELECT DISTINCT item_id, model_alias, run_id FROM runs WHERE request_error IS NULL")
def src03(spark, sf):
    return X.runs(spark, sf).filter(F.col("request_error").isNull()).select("item_id", "model_alias", "run_id").distinct()


@query("src04_last_record_wins", _R + "SELECT item_id, model_alias, arg_max(answer, event_id) FILTER (answer IS NOT NULL) AS answer, max(event_id) AS event_id FROM runs WHERE answer IS NOT NULL GROUP BY item_id, model_alias")
def src04(spark, sf):
    """The latest record of each key (SRC-04, WIN-07, STR-02): an aggregate, no window."""
    answered = X.runs(spark, sf).filter(F.col("answer").isNotNull())
    return answered.groupBy("item_id", "model_alias").agg(F.max_by("answer", "event_id").alias("answer"), F.max("event_id").alias("event_id"))


@query("prj13_valid_answers", _R + "SELECT model_alias, count(*) FILTER (answer IS NOT NULL) AS screening, count(*) FILTER (answer IS NOT NULL AND extractable) AS calibration FROM runs GROUP BY model_alias")
def prj13(spark, sf):
    return X.runs(spark, sf).groupBy("model_alias").agg(F.count(S.valid_answer(F.col("answer"))).alias("screening"), F.count(S.valid_answer(F.col("answer"), F.col("extractable"))).alias("calibration"))


@query("prj18_scored_runs", _R + "SELECT item_id, model_alias, run_id, answer, answer IS NOT NULL AS is_valid, coalesce(answer = gold_answer, false) AS is_correct, CASE WHEN answer IS NULL THEN 'none' WHEN answer = gold_answer THEN '[]' ELSE array_to_string(['C1', 'C2', 'C3'][1 : (ascii(answer) - ascii(gold_answer) + 4) % 4], ',') END AS selected FROM runs")
def prj18(spark, sf):
    """Responses scored against their items (PRJ-18, PRJ-19, JON-01)."""
    apart = F.pmod(F.ascii("answer") - F.ascii("gold_answer"), F.lit(4))
    signature = F.when(apart == 0, F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(apart, F.lit(1))), lambda i: F.concat(F.lit("C"), i)))
    return X.runs(spark, sf).select("item_id", "model_alias", "run_id", "answer", F.col("answer").isNotNull().alias("is_valid"), F.coalesce(F.col("answer") == F.col("gold_answer"), F.lit(False)).alias("is_correct"), F.coalesce(F.when(F.col("answer").isNotNull(), S.signature_key(signature)), F.lit("none")).alias("selected"))


@query("flt14_parse_audit", _R + "SELECT item_id, model_alias, run_id, json_compliant, extractable, truncated, request_error FROM runs WHERE NOT coalesce(json_compliant, false) OR NOT coalesce(extractable, false) OR truncated OR request_error IS NOT NULL")
def flt14(spark, sf):
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return X.runs(spark, sf).filter(no("json_compliant") | no("extractable") | F.col("truncated") | F.col("request_error").isNotNull()).select("item_id", "model_alias", "run_id", "json_compliant", "extractable", "truncated", "request_error")


@query("agg06_item_analysis", _R + f""", a AS (SELECT item_id, count(*) AS n_runs, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy,
count(*) FILTER (answer = 'A') AS n_a, count(*) FILTER (answer = 'B') AS n_b, count(*) FILTER (answer = 'C') AS n_c, count(*) FILTER (answer = 'D') AS n_d, count(*) FILTER (answer IS NULL) AS n_invalid,
coalesce(string_agg(DISTINCT answer, ',' ORDER BY answer), '') AS answers, coalesce(string_agg(DISTINCT answer, ',' ORDER BY answer) FILTER (NOT correct), '') AS wrong_answers FROM runs GROUP BY item_id) SELECT *, {_CATEGORY} AS category, {_DIFFICULTY} AS difficulty FROM a""")
def agg06(spark, sf):
    """Per-item aggregate with its categories (AGG-03 to AGG-06, PRJ-04, PRJ-05)."""
    return R.item_analysis(X.runs(spark, sf))


@query("jon02_items_without_runs", _R + f""", ids AS (SELECT c_custkey AS item_id FROM customer UNION SELECT item_id FROM runs), a AS (SELECT i.item_id, count(event_id) AS n_runs, count(*) FILTER (correct) AS n_correct FROM ids i LEFT JOIN runs r ON r.item_id = i.item_id GROUP BY i.item_id) SELECT *, {_CATEGORY} AS category FROM a""")
def jon02(spark, sf):
    """Items with their runs (JON-02, JON-09): the items are all customers and all items of runs; those without runs count zeros."""
    ids = X.read(spark, sf, "customer").select(F.col("c_custkey").alias("item_id")).union(X.runs(spark, sf).select("item_id")).distinct()
    return R.item_analysis(X.runs(spark, sf), ids).select("item_id", "n_runs", "n_correct", "category")


@query("agg07_disagreement", _R + """, m AS (SELECT item_id, model_alias, count(DISTINCT answer) AS kinds, count(answer) AS v, count(*) FILTER (answer = 'A') || '|' || count(*) FILTER (answer = 'B') || '|' || count(*) FILTER (answer = 'C') || '|' || count(*) FILTER (answer = 'D') AS counts FROM runs GROUP BY item_id, model_alias)
SELECT item_id, bool_or(kinds > 1) AS within_model, count(DISTINCT counts) FILTER (v > 0) > 1 AS cross_model FROM m GROUP BY item_id""")
def agg07(spark, sf):
    return R.disagreement(X.runs(spark, sf))


@query("prj06_priority", _R + """, a AS (SELECT item_id, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(DISTINCT answer) AS kinds, count(*) FILTER ((ascii(answer) - ascii(gold_answer) + 4) % 4 = 1) AS single FROM runs GROUP BY item_id)
SELECT item_id, CASE WHEN n_correct > 0 AND n_correct < n AND kinds >= 2 AND single > 0 THEN 'high' WHEN n_correct > 0 AND n_correct < n THEN 'medium' ELSE 'low' END AS priority FROM a""")
def prj06(spark, sf):
    """High is a mixed item with several answers and some wrong answer that breaks one constraint alone (PRJ-06)."""
    single = F.pmod(F.ascii("answer") - F.ascii("gold_answer"), F.lit(4)) == 1
    found = X.runs(spark, sf).groupBy("item_id").agg(F.count_if("correct").alias("n"), F.count("*").alias("runs"), F.countDistinct("answer").alias("kinds"), F.count_if(single).alias("single"))
    mixed = (F.col("n") > 0) & (F.col("n") < F.col("runs"))
    return found.select("item_id", F.when(mixed & (F.col("kinds") >= 2) & (F.col("single") > 0), "high").when(mixed, "medium").otherwise("low").alias("priority"))


@query("agg09_grouped_accuracy", _R + """SELECT 'model_alias' AS dimension, model_alias AS level, count(*) AS n, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM runs GROUP BY 2
UNION ALL SELECT 'run_id', run_id::VARCHAR, count(*), round(count(*) FILTER (correct) / count(*), 6) FROM runs GROUP BY 2
UNION ALL SELECT 'cl', cl, count(*), round(count(*) FILTER (correct) / count(*), 6) FROM runs GROUP BY 2
UNION ALL SELECT 'il', il, count(*), round(count(*) FILTER (correct) / count(*), 6) FROM runs GROUP BY 2""")
def agg09(spark, sf):
    return R.grouped_accuracy(X.runs(spark, sf), ["model_alias", "run_id", "cl", "il"])


_ROLL = """count(*) AS n, count(*) FILTER (request_error IS NOT NULL) AS n_errors, count(*) FILTER (answer IS NOT NULL AND extractable) AS n_valid, count(*) FILTER (correct AND answer IS NOT NULL AND extractable) AS n_correct,
round(count(*) FILTER (correct AND answer IS NOT NULL AND extractable) / nullif(count(*) FILTER (answer IS NOT NULL AND extractable), 0), 6) AS valid_accuracy, round(count(*) FILTER (truncated) / nullif(count(*) FILTER (request_error IS NULL), 0), 6) AS truncated_rate,
round(count(*) FILTER (json_compliant) / count(*), 6) AS compliant_rate, round(sum(confidence::DECIMAL(18, 6))::DOUBLE / count(confidence), 6) AS mean_confidence"""


@query("agg10_model_rollup", _R + f"SELECT model_alias, {_ROLL} FROM runs GROUP BY model_alias")
def agg10(spark, sf):
    return R.rollup(X.runs(spark, sf), "model_alias")


@query("agg16_item_model_analysis", _R + f"SELECT item_id, model_alias, {_ROLL} FROM runs GROUP BY item_id, model_alias")
def agg16(spark, sf):
    return R.rollup(X.runs(spark, sf), "item_id", "model_alias")


@query("agg17_cell_model_statistics", _R + f"SELECT model_alias, cl, il, {_ROLL} FROM runs GROUP BY model_alias, cl, il")
def agg17(spark, sf):
    """Model by factor cell (AGG-17, AGG-18)."""
    return R.rollup(X.runs(spark, sf), "model_alias", "cl", "il")


@query("agg11_seed_agreement", _R + "SELECT model_alias, round(avg(one::INT), 6) AS agreement FROM (SELECT model_alias, item_id, count(DISTINCT answer) = 1 AS one FROM runs GROUP BY ALL HAVING count(answer) > 0) GROUP BY model_alias")
def agg11(spark, sf):
    per_item = X.runs(spark, sf).groupBy("model_alias", "item_id").agg(F.countDistinct("answer").alias("kinds")).filter("kinds > 0")
    return per_item.groupBy("model_alias").agg(F.round(F.avg((F.col("kinds") == 1).cast("int")), 6).alias("agreement"))


@query("agg12_predictiveness", _R + """, a AS (SELECT model_alias, cl, round(count(*) FILTER (correct) / count(*), 6) AS acc FROM runs GROUP BY ALL), l AS (SELECT *, lag(acc) OVER (PARTITION BY model_alias ORDER BY cl) AS before FROM a)
SELECT model_alias, round(max(acc) - min(acc), 6) AS span, bool_and(before IS NULL OR acc <= before) AS monotone FROM l GROUP BY model_alias""")
def agg12(spark, sf):
    """Span and monotone fall along a factor (AGG-12, WIN-05); the window is over a model's few levels."""
    rates = X.runs(spark, sf).groupBy("model_alias", "cl").agg(S.ratio(F.count_if("correct"), F.count("*")).alias("acc"))
    before = F.lag("acc").over(W.partitionBy("model_alias").orderBy("cl"))
    return rates.withColumn("ok", before.isNull() | (F.col("acc") <= before)).groupBy("model_alias").agg(F.round(F.max("acc") - F.min("acc"), 6).alias("span"), F.bool_and("ok").alias("monotone"))


@query("agg14_global_counters", _R + """SELECT count(*) AS n_rows, count(DISTINCT (item_id, model_alias, run_id)) AS n_keys, count(*) - count(DISTINCT (item_id, model_alias, run_id)) AS n_duplicates, count(*) FILTER (answer IS NOT NULL) AS n_valid FROM runs""")
def agg14(spark, sf):
    keyed = X.runs(spark, sf).groupBy("item_id", "model_alias", "run_id").agg(F.count("*").alias("n"), F.count("answer").alias("v"))
    return keyed.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("v").alias("n_valid"))


_H = "('0x' || substr(md5(item_id || '|' || model_alias || '|' || run_id), 1, 8))::UBIGINT % 50"


@query("agg32_run_inventory", _R + f""", broken AS (SELECT CASE WHEN {_H} = 2 THEN item_id + 100000 ELSE item_id END AS item_id, model_alias, run_id FROM runs, (SELECT unnest(range(2)) AS copy) WHERE {_H} <> 0 AND (copy = 0 OR {_H} = 1)),
seen AS (SELECT item_id, model_alias, run_id, count(*) AS n FROM broken GROUP BY ALL), wanted AS (SELECT i.item_id, m.model_alias, r AS run_id FROM (SELECT DISTINCT item_id FROM runs) i, (SELECT DISTINCT model_alias FROM runs) m, (SELECT unnest(range(1, 4)) AS r))
SELECT coalesce(w.item_id, s.item_id) AS item_id, coalesce(w.model_alias, s.model_alias) AS model_alias, coalesce(w.run_id, s.run_id) AS run_id, CASE WHEN s.n IS NULL THEN 'missing' WHEN w.item_id IS NULL THEN 'unknown' ELSE 'duplicate' END AS problem, coalesce(s.n, 0) AS n
FROM wanted w FULL JOIN seen s ON w.item_id = s.item_id AND w.model_alias = s.model_alias AND w.run_id = s.run_id WHERE s.n IS NULL OR w.item_id IS NULL OR s.n > 1""")
def agg32(spark, sf):
    """Missing, duplicate and unknown keys of a damaged log (AGG-32, AGG-33, JON-03, JON-04, SET-02)."""
    r = X.runs(spark, sf)
    h = S.draw(F.col("item_id"), F.col("model_alias"), F.col("run_id")) % 50
    damaged = r.withColumn("h", h).filter("h != 0").select(F.when(F.col("h") == 2, F.col("item_id") + 100000).otherwise(F.col("item_id")).alias("item_id"), "model_alias", "run_id", F.explode(F.when(F.col("h") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return R.inventory(R.grid(r, r, [1, 2, 3]), damaged.drop("copy"))


@query("agg19_factor_contrasts", _R + """, a AS (SELECT model_alias, il, round(count(*) FILTER (correct AND cl = 'CL1') / nullif(count(*) FILTER (cl = 'CL1'), 0), 6) AS "CL1", round(count(*) FILTER (correct AND cl = 'CL2') / nullif(count(*) FILTER (cl = 'CL2'), 0), 6) AS "CL2", round(count(*) FILTER (correct AND cl = 'CL3') / nullif(count(*) FILTER (cl = 'CL3'), 0), 6) AS "CL3" FROM runs GROUP BY ALL)
SELECT *, CASE WHEN "CL1" IS NULL OR "CL2" IS NULL OR "CL3" IS NULL THEN 'incomplete' WHEN "CL1" = "CL2" AND "CL2" = "CL3" THEN 'flat' WHEN "CL2" <= "CL1" AND "CL3" <= "CL2" THEN 'harder' WHEN "CL2" >= "CL1" AND "CL3" >= "CL2" THEN 'easier' ELSE 'nonmonotonic' END AS trend FROM a""")
def agg19(spark, sf):
    return R.controlled_contrasts(X.runs(spark, sf), "cl", ["CL1", "CL2", "CL3"], ["model_alias", "il"])


_ENDS = {"cl": ("CL1", "CL3"), "ds": ("DS1", "DS3"), "il": ("IL1", "IL2")}


@query("agg22_factor_replication", f"WITH {PICK_SQL}" + """, s AS (SELECT *, run_id = 1 AS dev FROM picks), f AS (SELECT * FROM (VALUES ('cl', 'CL1', 'CL3'), ('ds', 'DS1', 'DS3'), ('il', 'IL1', 'IL2')) t(factor, low, high)),
d AS (SELECT model_alias, factor, dev, count(*) FILTER (correct AND level = high) / nullif(count(*) FILTER (valid AND level = high), 0) - count(*) FILTER (correct AND level = low) / nullif(count(*) FILTER (valid AND level = low), 0) AS delta
  FROM (SELECT s.*, f.*, CASE factor WHEN 'cl' THEN cl WHEN 'ds' THEN ds ELSE il END AS level FROM s, f) GROUP BY ALL)
SELECT d.model_alias, d.factor, round(d.delta, 6) AS dev_delta, round(v.delta, 6) AS val_delta, sign(d.delta) = sign(v.delta) AS same_direction, CASE WHEN sign(d.delta) = sign(v.delta) AND d.delta <> 0 THEN 'direction replicated on the independent extension' ELSE 'direction did not replicate clearly' END AS interpretation
FROM d JOIN d v ON d.model_alias = v.model_alias AND d.factor = v.factor AND d.dev AND NOT v.dev""")
def agg22(spark, sf):
    """Endpoint change of each factor among valid answers in two splits, and whether its sign agrees; no change in either is
    the same direction but no replication (AGG-21, AGG-22)."""
    dev = F.col("run_id") == 1
    share = lambda split, level: F.try_divide(F.count_if(F.col("correct") & split & (F.col("level") == level)).cast("double"), F.count_if(F.col("valid") & split & (F.col("level") == level)).cast("double"))
    factors = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level"), F.lit(a).alias("low"), F.lit(b).alias("high")) for f, (a, b) in _ENDS.items()]))
    each = X.picks(spark, sf).select("model_alias", "run_id", "correct", "valid", factors.alias("f")).select("model_alias", "run_id", "correct", "valid", "f.*")
    change = lambda split: share(split, F.col("high")) - share(split, F.col("low"))
    delta = each.groupBy("model_alias", "factor").agg(change(dev).alias("d"), change(~dev).alias("v"))
    same = F.signum("d") == F.signum("v")
    said = F.when(same & (F.col("d") != 0), "direction replicated on the independent extension").otherwise("direction did not replicate clearly")
    return delta.select("model_alias", "factor", F.round("d", 6).alias("dev_delta"), F.round("v", 6).alias("val_delta"), same.alias("same_direction"), said.alias("interpretation"))


@query("agg23_item_behaviour", _R + """SELECT item_id, model_alias, count(answer) = 3 AS complete, bool_and(correct) AS all_correct, NOT bool_or(correct) AS all_wrong, bool_or(correct) AND NOT bool_and(correct) AS mixed, count(DISTINCT answer) > 1 AS disagrees FROM runs GROUP BY ALL""")
def agg23(spark, sf):
    """Three-run behaviour of an item and model (AGG-23, AGG-24, FLT-19)."""
    return X.runs(spark, sf).groupBy("item_id", "model_alias").agg((F.count("answer") == 3).alias("complete"), F.bool_and("correct").alias("all_correct"), (~F.bool_or("correct")).alias("all_wrong"), (F.bool_or("correct") & ~F.bool_and("correct")).alias("mixed"), (F.countDistinct("answer") > 1).alias("disagrees"))


@query("agg36_cluster_bootstrap", _R + """, i AS (SELECT model_alias, item_id, count(*) FILTER (correct) AS top, count(answer) AS bottom FROM runs GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY model_alias ORDER BY item_id) - 1 AS pos, count(*) OVER (PARTITION BY model_alias) AS size FROM i),
draws AS (SELECT model_alias, size, r, unnest(range(size)) AS d FROM (SELECT DISTINCT model_alias, size FROM p), (SELECT unnest(range(1000)) AS r)),
s AS (SELECT w.model_alias, w.r, sum(top)::DOUBLE / sum(bottom) AS rate FROM (SELECT model_alias, r, ('0x' || substr(md5('17|' || model_alias || '|' || r || '|' || d), 1, 8))::UBIGINT % size AS pos FROM draws) w JOIN p ON p.model_alias = w.model_alias AND p.pos = w.pos GROUP BY w.model_alias, w.r)
SELECT model_alias, round(list_sort(list(rate))[floor(0.025 * (count(*) - 1))::INT + 1], 6) AS lower, round(list_sort(list(rate))[floor(0.975 * (count(*) - 1))::INT + 1], 6) AS upper FROM s WHERE rate IS NOT NULL GROUP BY model_alias""")
def agg36(spark, sf):
    """Percentile interval of the share of right among valid answers over 1,000 resamples of items (AGG-36, MTH-03)."""
    per_item = X.runs(spark, sf).groupBy("model_alias", "item_id").agg(F.count_if("correct").alias("top"), F.count("answer").alias("bottom"))
    return R.cluster_bootstrap(R.placed(per_item, "model_alias", "item_id"), "model_alias", "top", "bottom")


@query("agg38_spearman", _R + """, c AS (SELECT model_alias, item_id % 18 AS cell, round(count(*) FILTER (correct) / count(*), 6) AS acc FROM runs GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY model_alias ORDER BY acc) + (count(*) OVER (PARTITION BY model_alias, acc) - 1) / 2.0::DOUBLE AS rk FROM c)
SELECT a.model_alias AS model_a, b.model_alias AS model_b, round(corr(a.rk, b.rk), 6) AS rho FROM k a JOIN k b ON a.cell = b.cell AND a.model_alias < b.model_alias GROUP BY 1, 2""")
def agg38(spark, sf):
    """Rank correlation of models over cells (AGG-38, WIN-01)."""
    cells = X.runs(spark, sf).groupBy("model_alias", (F.col("item_id") % 18).alias("cell")).agg(S.ratio(F.count_if("correct"), F.count("*")).alias("acc"))
    ranked = cells.select("model_alias", "cell", R.average_ranks(cells, "acc", "model_alias").alias("rk"))
    a, b = ranked.select(F.col("model_alias").alias("model_a"), "cell", F.col("rk").alias("x")), ranked.select(F.col("model_alias").alias("model_b"), "cell", F.col("rk").alias("y"))
    return a.join(b, "cell").filter("model_a < model_b").groupBy("model_a", "model_b").agg(R.spearman(F.col("x"), F.col("y")).alias("rho"))


@query("win01_rank_correlation", """WITH r AS (SELECT l_returnflag AS flag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem)
SELECT flag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY flag""")
def win01(spark, sf):
    """Rank correlation of two columns over all lines of a flag (WIN-01, AGG-38)."""
    return N.rank_correlation(X.read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").withColumnRenamed("l_returnflag", "flag")


@query("agg42_error_histogram", _R + "SELECT kind, count(*) AS n FROM (SELECT unnest([CASE WHEN request_error IS NOT NULL THEN 'request' END, CASE WHEN truncated THEN 'truncated' END, CASE WHEN NOT json_compliant THEN 'format' END]) AS kind FROM runs) WHERE kind IS NOT NULL GROUP BY kind")
def agg42(spark, sf):
    """One failure may count in several classes (AGG-41, AGG-42)."""
    flags = F.array_compact(F.array(F.when(F.col("request_error").isNotNull(), "request"), F.when(F.col("truncated"), "truncated"), F.when(~F.col("json_compliant"), "format")))
    return X.runs(spark, sf).select(F.explode(flags).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("top01_ranked_cells", _R + "SELECT cl || '__' || il AS cell, acc, row_number() OVER (ORDER BY acc DESC NULLS LAST, cl || '__' || il)::INT AS position FROM (SELECT cl, il, round(count(*) FILTER (correct) / count(*), 6) AS acc FROM runs GROUP BY ALL)")
def top01(spark, sf):
    """Cells from easiest to hardest (TOP-01, TOP-03, TOP-07, TOP-08); the window is over a handful of cells."""
    cells = X.runs(spark, sf).groupBy(F.concat_ws("__", "cl", "il").alias("cell")).agg(S.ratio(F.count_if("correct"), F.count("*")).alias("acc"))
    return cells.withColumn("position", F.row_number().over(W.orderBy(F.desc_nulls_last("acc"), "cell")))


@query("top02_frequent_wrong_answers", _R + "SELECT item_id, answer, n, row_number() OVER (ORDER BY n DESC, item_id, answer)::INT AS position FROM (SELECT item_id, answer, count(*) AS n FROM runs WHERE NOT correct AND answer IS NOT NULL GROUP BY ALL) ORDER BY n DESC, item_id, answer LIMIT 20")
def top02(spark, sf):
    """The top 20, with their rank (TOP-02, TOP-04)."""
    found = X.runs(spark, sf).filter(~F.col("correct") & F.col("answer").isNotNull()).groupBy("item_id", "answer").agg(F.count("*").alias("n"))
    top = found.orderBy(F.desc("n"), "item_id", "answer").limit(20)
    return top.withColumn("position", F.row_number().over(W.orderBy(F.desc("n"), "item_id", "answer")))


@query("top05_items_per_category", _R + f""", a AS (SELECT item_id, count(*) FILTER (correct) AS n_correct FROM runs GROUP BY item_id), c AS (SELECT item_id, {_CATEGORY} AS category FROM a) SELECT category, item_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id) AS rn FROM c) WHERE rn <= 5""")
def top05(spark, sf):
    analysed = R.item_analysis(X.runs(spark, sf)).select("category", "item_id")
    return analysed.withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy("item_id"))).filter("rn <= 5")


@query("set07_union_of_splits", _R + "SELECT split, count(*) AS n FROM (SELECT 'dev' AS split FROM runs WHERE run_id = 1 UNION ALL SELECT 'val' FROM runs WHERE run_id > 1) GROUP BY split")
def set07(spark, sf):
    r = X.runs(spark, sf)
    return r.filter("run_id = 1").withColumn("split", F.lit("dev")).unionByName(r.filter("run_id > 1").withColumn("split", F.lit("val"))).groupBy("split").agg(F.count("*").alias("n"))


@query("str01_missing_jobs", _R + "SELECT item_id, model_alias, run_id FROM (SELECT DISTINCT item_id FROM runs) i, (SELECT DISTINCT model_alias FROM runs) m, (SELECT unnest(range(1, 5)) AS run_id) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.item_id = i.item_id AND r.model_alias = m.model_alias AND r.run_id = run_id.run_id AND request_error IS NULL)".replace("run_id.run_id", "j.run_id").replace("AS run_id) WHERE", "AS run_id) j WHERE"))
def str01(spark, sf):
    """Work still to do: the grid without what is done (STR-01, STR-03, and the anti and semi joins)."""
    r = X.runs(spark, sf)
    keys = ["item_id", "model_alias", "run_id"]
    return R.grid(r, r, [1, 2, 3, 4]).join(src03(spark, sf), keys, "left_anti")


@query("agg25_round_majorities", _C + """, v AS (SELECT item_id, family, round, answer, count(*) AS n FROM calls WHERE answer IS NOT NULL GROUP BY ALL), t AS (SELECT item_id, family, round, max(n) AS most FROM v GROUP BY ALL), l AS (SELECT v.item_id, v.family, v.round, count(*) AS leaders, min(answer) AS who FROM v JOIN t USING (item_id, family, round) WHERE n = most GROUP BY ALL),
c AS (SELECT item_id, family, round, count(*) AS agents, count(answer) AS valid FROM calls GROUP BY ALL)
SELECT c.item_id, c.family, c.round, CASE WHEN leaders = 1 THEN who END AS majority, coalesce(most, 0) AS majority_size, valid = agents AND coalesce(most, 0) = agents AS consensus, agents - valid AS n_invalid FROM c LEFT JOIN t USING (item_id, family, round) LEFT JOIN l USING (item_id, family, round)""")
def agg25(spark, sf):
    return D.majorities(X.calls(spark, sf))


_MOVES = """, v AS (SELECT item_id, family, round, answer, count(*) AS n FROM calls WHERE answer IS NOT NULL GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY item_id, family, round) AS most FROM v), l AS (SELECT item_id, family, round, CASE WHEN count(*) = 1 THEN min(answer) END AS led FROM t WHERE n = most GROUP BY ALL),
m AS (SELECT a.*, b.answer AS to_answer, b.correct AS to_correct, b.violations AS to_violations, a.answer IS NOT NULL AND b.answer IS NOT NULL AS valid, led FROM calls a JOIN calls b ON a.item_id = b.item_id AND a.family = b.family AND a.agent_id = b.agent_id AND b.round = a.round + 1 LEFT JOIN l ON l.item_id = a.item_id AND l.family = a.family AND l.round = a.round),
moves AS (SELECT *, valid AND answer <> to_answer AS changed, CASE WHEN valid THEN CASE WHEN correct THEN 'correct' ELSE 'wrong' END || '_to_' || CASE WHEN to_correct THEN 'correct' ELSE 'wrong' END ELSE 'unparsed_transition' END AS kind,
 (SELECT count(*) FROM calls p WHERE p.item_id = m.item_id AND p.family = m.family AND p.round = m.round AND p.agent_id <> m.agent_id AND p.answer = m.to_answer) AS n_sources FROM m),
events AS (SELECT *, CASE WHEN kind = 'unparsed_transition' THEN 'format_failure_transition' WHEN kind = 'correct_to_wrong' THEN 'harmful_revision' WHEN kind = 'wrong_to_correct' THEN 'successful_correction' WHEN kind = 'wrong_to_wrong' AND changed THEN 'wrong_to_wrong_migration' WHEN kind = 'correct_to_correct' AND NOT changed THEN 'stable_correct' ELSE 'stable_wrong' END AS event FROM moves) """
_MOVES = _MOVES.replace("events AS", "happened AS")


@query("win02_transitions", _C + _MOVES + """SELECT item_id, family, agent_id, round AS from_round, kind AS transition_type, event AS objective_event, changed, CASE WHEN valid THEN array_to_string(list_sort(list_filter(to_violations, lambda x: NOT list_contains(violations, x))), ',') ELSE '' END AS introduced,
CASE WHEN valid THEN array_to_string(list_sort(list_filter(violations, lambda x: NOT list_contains(to_violations, x))), ',') ELSE '' END AS resolved, n_sources, changed AND n_sources > 0 AS adopted, coalesce(changed AND to_answer = led, false) AS toward_majority FROM happened""")
def win02(spark, sf):
    """Transitions of agents with set differences and peers (WIN-02, WIN-03, JON-10, JON-11, SET-01, PRJ-07, PRJ-08)."""
    moves = D.transitions(X.calls(spark, sf))
    return moves.select("item_id", "family", "agent_id", "from_round", "transition_type", "objective_event", "changed", F.array_join("introduced", ",").alias("introduced"), F.array_join("resolved", ",").alias("resolved"), F.size("sources").cast("long").alias("n_sources"), "adopted", "toward_majority")


@query("agg27_transition_statistics", _C + _MOVES + """SELECT family, pilot_group, round AS from_round, count(*) AS n, count(*) FILTER (valid) AS n_valid, count(*) FILTER (event = 'harmful_revision') AS harmful, count(*) FILTER (event = 'successful_correction') AS corrected, count(*) FILTER (event = 'wrong_to_wrong_migration') AS migrated,
round(count(*) FILTER (event = 'harmful_revision') / nullif(count(*) FILTER (valid), 0), 6) AS harmful_rate, sum(CASE WHEN valid THEN len(list_filter(to_violations, lambda x: NOT list_contains(violations, x))) ELSE 0 END)::BIGINT AS introduced,
sum(CASE WHEN valid THEN len(list_filter(violations, lambda x: NOT list_contains(to_violations, x))) ELSE 0 END)::BIGINT AS resolved, count(*) FILTER (changed AND n_sources > 0) AS adopted FROM happened GROUP BY CUBE (family, pilot_group, round)""")
def agg27(spark, sf):
    """Counts by every combination of family, group and round (AGG-27, AGG-28)."""
    return D.transition_statistics(D.transitions(X.calls(spark, sf)))


@query("agg26_round_statistics", _C + "SELECT family, round, count(*) AS n, round(count(*) FILTER (correct) / count(*), 6) AS accuracy, round(count(*) FILTER (correct) / nullif(count(answer), 0), 6) AS valid_accuracy FROM calls GROUP BY ALL")
def agg26(spark, sf):
    return X.calls(spark, sf).groupBy("family", "round").agg(F.count("*").alias("n"), S.ratio(F.count_if("correct"), F.count("*")).alias("accuracy"), S.ratio(F.count_if("correct"), F.count("answer")).alias("valid_accuracy"))


@query("win04_consensus_formed", _C + """, r AS (SELECT item_id, family, round, count(*) = count(answer) AND count(DISTINCT answer) = 1 AS agreed FROM calls GROUP BY ALL), n AS (SELECT *, lead(agreed) OVER (PARTITION BY item_id, family ORDER BY round) AS next_agreed FROM r) SELECT item_id, family, round FROM n WHERE NOT agreed AND next_agreed""")
def win04(spark, sf):
    rounds = D.majorities(X.calls(spark, sf))
    then = F.lead("consensus").over(W.partitionBy("item_id", "family").orderBy("round"))
    return rounds.withColumn("then", then).filter("NOT consensus AND then").select("item_id", "family", "round")


@query("top06_migrations", _C + _MOVES + "SELECT item_id, family, agent_id, round AS from_round FROM happened WHERE event = 'wrong_to_wrong_migration' ORDER BY (violations <> to_violations) DESC, item_id, family, agent_id, round LIMIT 10")
def top06(spark, sf):
    """Case lists (FLT-17, TOP-06): migrations whose violations changed come first."""
    moves = D.transitions(X.calls(spark, sf)).filter("objective_event = 'wrong_to_wrong_migration'")
    differs = (F.size("introduced") + F.size("resolved") > 0).cast("int")
    return moves.orderBy(F.desc(differs), "item_id", "family", "agent_id", "from_round").limit(10).select("item_id", "family", "agent_id", "from_round")


@query("flt18_stable_controls", _C + _MOVES + "SELECT item_id, family FROM happened WHERE family = 'f0' AND pilot_group = 'stable_control' GROUP BY item_id, family HAVING bool_and(event = 'stable_correct') ORDER BY item_id LIMIT 5")
def flt18(spark, sf):
    """The first five stable controls of a family whose every move is stable and right (FLT-18)."""
    moves = D.transitions(X.calls(spark, sf)).filter("family = 'f0' AND pilot_group = 'stable_control'")
    return moves.groupBy("item_id", "family").agg(F.bool_and(F.col("objective_event") == "stable_correct").alias("all")).filter("all").orderBy("item_id").limit(5).select("item_id", "family")


_CAL = """SELECT event_id, CASE WHEN template IN (2, 5, 11, 13) THEN NULL ELSE x END AS answer,
CASE WHEN template IN (0, 10, 12) THEN 'strict_json' WHEN template IN (1, 9) THEN 'embedded_json' WHEN template IN (2, 11, 13) THEN 'none' WHEN template IN (3, 7) THEN 'bare_answer' WHEN template = 4 THEN 'explicit_final_answer' WHEN template = 5 THEN 'conflicting_answers' ELSE 'malformed_json_answer_field' END AS source,
CASE WHEN template IN (0, 2, 10, 11, 12, 13) THEN '' WHEN template = 5 THEN least(x, y) || ',' || greatest(x, y) ELSE x END AS candidates, template IN (0, 10) AS compliant, template NOT IN (2, 5, 11, 13) AS extractable, template IN (1, 3, 4, 6, 7, 8, 9) AS fallback_used, template = 5 AS ambiguous, template IN (0, 10, 11, 12) AS strict_syntax,
CASE WHEN template IN (0, 1, 9) THEN 'option A' WHEN template IN (10, 12) THEN 'r' ELSE '' END AS reasoning, CASE WHEN template IN (0, 1, 9) THEN k / 100.0::DOUBLE WHEN template = 10 THEN 0.5::DOUBLE END AS confidence,
CASE WHEN template IN (0, 10) THEN NULL WHEN template = 12 THEN 'JSON object is missing or has an invalid required field' WHEN template = 5 THEN 'Conflicting explicit answers were found' WHEN template = 11 THEN 'Strict JSON does not contain an unambiguous valid answer' WHEN template IN (2, 13) THEN 'No unambiguous final answer found' ELSE 'Answer recovered from noncompliant output' END AS parse_error FROM raws"""


def _salvaged(df):
    """df with what the parsers share, made once a response."""
    return df.withColumn("salvaged", A.salvage(F.col("raw"))).withColumn("strict", A.strict_json(F.col("raw"), F.col("salvaged")))


@query("jsn09_calibration_parse", f"WITH {RESPONSE_SQL} " + _CAL)
def jsn09(spark, sf):
    """Claims gathered and compared (JSN-04, JSN-06, JSN-09); the SQL knows what each shape of text says."""
    parsed = _salvaged(X.responses(spark, sf)).select("event_id", A.parse_calibration(F.col("raw"), F.col("salvaged"), F.col("strict")).alias("p"))
    return parsed.select("event_id", "p.*").withColumn("candidates", F.array_join("candidates", ","))


@query("jsn01_screening_parse", f"""WITH {RESPONSE_SQL} SELECT event_id, CASE WHEN template IN (2, 6) THEN NULL ELSE x END AS answer, CASE WHEN template IN (0, 1, 8, 9) THEN k / 100.0::DOUBLE WHEN template IN (10, 11) THEN 0.5 WHEN template = 12 THEN 1.0 END AS confidence, template IN (0, 1, 8, 9, 10, 12) AS parse_success, template IN (0, 10, 12) AS strict_json_success, template IN (1, 8, 9) AS fallback_parse_success,
CASE WHEN template IN (0, 1, 8, 9, 10, 12) THEN NULL WHEN template = 2 THEN 'JSON decode error' WHEN template = 11 THEN 'Answer is not one of A/B/C/D' ELSE 'No JSON object found' END AS parse_error FROM raws""")
def jsn01(spark, sf):
    """Strict JSON, then an object in the text, then a mention (JSN-01 to JSN-03, JSN-05, JSN-07, JSN-08)."""
    return _salvaged(X.responses(spark, sf)).select("event_id", A.parse_screening(F.col("raw"), F.col("salvaged"), F.col("strict")).alias("p")).select("event_id", "p.*")


@query("jsn10_followup_parse", f"""WITH {FOLLOWUP_SQL} SELECT event_id, CASE WHEN template IN (5, 7) THEN NULL ELSE x END AS answer,
['strict_json_label', 'strict_json_label', 'strict_json_candidate_name', 'fallback_candidate_name', 'fallback_candidate_name', 'conflicting_answers', 'bare_answer', 'none'][template + 1] AS source, CASE WHEN template = 7 THEN '' WHEN template = 5 THEN least(x, y) || ',' || greatest(x, y) ELSE x END AS candidates,
template NOT IN (5, 7) AS extractable, template = 0 AS compliant, template = 0 AS strict_format, template IN (2, 3, 4, 5) AS name_used, template IN (2, 3, 4, 5, 6) AS fallback_used, template = 5 AS ambiguous,
CASE WHEN template = 0 THEN NULL WHEN template IN (1, 2) THEN 'Answer used a non-protocol representation' WHEN template IN (3, 4) THEN 'Candidate name recovered from noncompliant output' WHEN template = 5 THEN 'Conflicting explicit answers were found' WHEN template = 6 THEN 'Answer recovered from noncompliant output' ELSE 'Strict JSON does not contain an unambiguous valid answer' END AS parse_error FROM told""")
def jsn10(spark, sf):
    """Labels or whole names of candidates (JSN-10, JON-17): a name is right but never compliant."""
    told = _salvaged(X.followups(spark, sf)).withColumns({"map": A.name_map(F.col("names")), "base": A.parse_calibration(F.col("raw"), F.col("salvaged"), F.col("strict"))})
    parsed = told.select("event_id", A.parse_followup(F.col("raw"), F.col("map"), F.col("base"), F.col("salvaged"), F.col("strict")).alias("p"))
    return parsed.select("event_id", "p.*").withColumn("candidates", F.array_join("candidates", ","))


@query("agg39_reparse_audit", f"WITH {RESPONSE_SQL} SELECT template, count(*) AS n, count(*) FILTER (template NOT IN (2, 6)) AS before, count(*) FILTER (template NOT IN (2, 5, 11, 13)) AS after, count(*) FILTER (template IN (5, 6, 11, 13)) AS n_changed, true AS raw_unchanged FROM raws GROUP BY template")
def agg39(spark, sf):
    """What another contract recovers from the same text, and whether the text itself stayed (AGG-39, JON-19, STR-06)."""
    raw = F.col("raw")
    both = _salvaged(X.responses(spark, sf)).select("template", F.xxhash64(raw).alias("was"), raw, A.parse_screening(raw, F.col("salvaged"), F.col("strict"))["answer"].alias("old"), A.parse_calibration(raw, F.col("salvaged"), F.col("strict"))["answer"].alias("new"))
    return both.groupBy("template").agg(F.count("*").alias("n"), F.count("old").alias("before"), F.count("new").alias("after"), F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("n_changed"), F.bool_and(F.col("was") == F.xxhash64("raw")).alias("raw_unchanged"))
