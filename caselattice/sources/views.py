"""The engine's tables over the star-schema Parquet files: candidates, constraints, runs, calls and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions.scalar import draw
from caselattice.operators.matrix import broken_ids, gathered
from caselattice.operators.validation import distractor_level
from caselattice.sources import catalog

ATTRIBUTES = ["qty_ge_10", "disc_le_08", "not_returned", "tax_le_06", "price_lt_60k", "status_open", "shipped_from_1997"]
LETTERS = ["A", "B", "C", "D"]
#: What the ids of an order's second and further fours of lines, or of a user's second and further threes of runs, are apart.
NEXT_ITEM = 10_000_000_000


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: Rows that one task of a shuffle of a table takes, about.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, sf: str, table: str) -> int | None:
    """So many tasks that a shuffle of the table is in pieces of one size, however large it is; None where Spark's own number
    will do. The count reads footers alone."""
    tasks = -(-read(spark, sf, table).count() // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(spark: SparkSession, sf: str, table: str, *keys: str) -> DataFrame:
    tasks = tasks_for(spark, sf, table)
    return read(spark, sf, table).repartition(tasks, *keys) if tasks else read(spark, sf, table)


#: Rows of responses that one task reads: they are few bytes each but dear to parse.
RESPONSE_ROWS = 25_000


def _spread(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """These columns of the table in pieces of one size: a file of many rows may be small enough for one task to read."""
    rows = read(spark, sf, table)
    return rows.select(*columns).repartition(max(1, -(-rows.count() // RESPONSE_ROWS)))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, label, attributes map): an order's lines, dealt to items in fours; an order's last item may have fewer."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    line = _dealt(spark, sf, "lineitem", "l_orderkey").withColumn("rn", F.row_number().over(order) - 1)
    tests = [F.col("l_quantity") >= 10, F.col("l_discount") <= 0.08, F.col("l_returnflag") != "R", F.col("l_tax") <= 0.06, F.col("l_extendedprice") < 60000, F.col("l_linestatus") == "O", F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")]
    held = F.create_map(*[x for name, test in zip(ATTRIBUTES, tests, strict=True) for x in (F.lit(name), test)])
    return line.select(_numbered(F.col("l_orderkey"), F.floor(F.col("rn") / 4)).alias("item_id"), F.char(F.col("rn") % 4 + 65).alias("label"), held.alias("attributes"))


def _numbered(key: Column, block: Column) -> Column:
    return key.cast("long") + block.cast("long") * NEXT_ITEM


def constraints_of(item_id: Column) -> Column:
    """Array of (pos, constraint_id, attribute, required_value): three, five or seven by the id."""
    k = F.element_at(F.array(F.lit(3), F.lit(5), F.lit(7)), (item_id % 3 + 1).cast("int"))
    names = F.array(*[F.lit(a) for a in ATTRIBUTES])
    return F.transform(
        F.sequence(F.lit(1), k),
        lambda p: F.struct(p.alias("pos"), F.concat(F.lit("C"), p).alias("constraint_id"), F.element_at(names, p).alias("attribute"), F.when(p == 6, item_id % 2 == 0).otherwise(True).alias("required_value")),
    )


def _shaped(found: DataFrame) -> DataFrame:
    """found (item_id, …) with k, cl, il and constraints, which depend on the id alone."""
    k = F.size("constraints")
    level = F.when(k == 3, "CL1").when(k == 5, "CL2").otherwise("CL3")
    return found.withColumn("constraints", constraints_of(F.col("item_id"))).withColumns({"k": k, "cl": level, "il": F.when(F.col("item_id") % 2 == 0, "IL1").otherwise("IL2")})


def shaped_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """candidates with their item's constraints: as these follow from the id, no join has to bring them."""
    return candidates(spark, sf).filter("item_id IS NOT NULL").withColumn("constraints", constraints_of(F.col("item_id")))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, k, cl, il, constraints)."""
    orders = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.floor((F.count("*") - 1) / 4).alias("last"))
    ids = orders.select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block")).select(_numbered(F.col("l_orderkey"), F.col("block")).alias("item_id"))
    return _shaped(ids).select("item_id", "k", "cl", "il", "constraints")


def item_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """items with sigs, valid, wrong and gold of matrix.item_signatures. Constraints follow from the id, so one shuffle of
    the lines by it is all that this takes."""
    lines = candidates(spark, sf)
    signed = lines.select("item_id", "label", broken_ids(F.col("attributes"), constraints_of(F.col("item_id"))).alias("signature"))
    return _shaped(gathered(signed)).select("item_id", "k", "cl", "il", "constraints", "sigs", "valid", "wrong", "gold")


def _letter(n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), n.cast("int"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a run: a user's events of a type, dealt to items in threes; the last item may have fewer."""
    order = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    place = F.row_number().over(order).cast("long") - 1
    e = _dealt(spark, sf, "events", "user_id", "event_type").withColumns({"place": place, "k": k}).withColumns({"run_id": F.col("place") % 3 + 1, "user_id": _numbered(F.col("user_id"), F.floor(F.col("place") / 3))})
    answer, gold = _letter(F.col("k") % 5), _letter(F.col("user_id") % 4)
    return e.select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("model_alias"), "run_id", (F.col("run_id") * 11).alias("seed"), "event_id",
        answer.alias("answer"), gold.alias("gold_answer"), F.coalesce(answer == gold, F.lit(False)).alias("correct"), (F.col("k") / 100.0).alias("confidence"),
        (F.col("k") % 5 < 4).alias("extractable"), (F.col("k") % 3 != 0).alias("json_compliant"), (F.col("k") % 17 == 0).alias("truncated"),
        F.when(F.col("k") % 13 == 0, "timeout").alias("request_error"), F.when(F.col("user_id") % 3 == 0, "CL1").when(F.col("user_id") % 3 == 1, "CL2").otherwise("CL3").alias("cl"),
        F.when(F.col("user_id") % 2 == 0, "IL1").otherwise("IL2").alias("il"),
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, family, agent_id, pilot_group, round, answer, correct, violations)."""
    r = runs(spark, sf).filter(F.col("model_alias").isin("click", "purchase", "view"))
    agent = F.when(F.col("model_alias") == "click", "A1").when(F.col("model_alias") == "purchase", "A2").otherwise("A3")
    apart = F.pmod(F.ascii("answer") - F.ascii("gold_answer"), F.lit(4))
    violations = F.coalesce(F.transform(F.when(apart > 0, F.sequence(F.lit(1), apart)), lambda i: F.concat(F.lit("C"), i)), F.expr("cast(array() as array<string>)"))
    return r.select("item_id", F.concat(F.lit("f"), F.col("item_id") % 2).alias("family"), agent.alias("agent_id"), F.when(F.col("item_id") % 3 == 0, "vulnerable").otherwise("stable_control").alias("pilot_group"), (F.col("run_id") - 1).alias("round"), "answer", "correct", violations.alias("violations"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, template, raw): fourteen shapes of raw text."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = _spread(spark, sf, "events", "event_id", "props").select("event_id", (F.col("event_id") % 14).cast("int").alias("template"), _letter(k % 4).alias("x"), _letter((k + 1) % 4).alias("y"), k.alias("k"))
    x, y, sure = F.col("x"), F.col("y"), (F.col("k") / 100.0).cast("string")
    json = F.concat(F.lit('{"answer": "'), x, F.lit('", "reasoning": "option A", "confidence": '), sure, F.lit("}"))
    shapes = [
        json,
        F.concat(json, F.lit(" and that is all")),
        F.concat(F.lit("{'answer': '"), x, F.lit("'}")),
        F.concat(F.lit(" "), F.lower(x), F.lit(" ")),
        F.concat(F.lit("Some thought.\nFinal answer: "), x),
        F.concat(F.lit("Answer: "), x, F.lit("\nFinal answer: "), y),
        F.concat(F.lit('{"answer": "'), x, F.lit('", "confidence": ')),
        F.concat(F.lit("\n"), x, F.lit("\t\n")),
        F.concat(F.lit('The 5" one: '), json),
        F.concat(json, F.lit("] and more")),
        F.concat(F.lit('{"answer": "'), y, F.lit('", "answer": "'), x, F.lit('", "reasoning": "r", "confidence": 0.5}')),
        F.concat(F.lit('{"reasoning": "Option '), x, F.lit('", "confidence": 0.5}')),
        F.concat(F.lit('{"answer": "'), x, F.lit('", "reasoning": "r", "confidence": true}')),
        F.concat(F.lit("I would take option "), x, F.lit(" over the rest")),
    ]
    return e.select("event_id", "template", F.element_at(F.array(*shapes), F.col("template") + 1).alias("raw"))


def followups(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, template, raw, names): eight shapes of answers by label or by candidate's name."""
    k = F.get_json_object("props", "$.k").cast("int")
    pool = F.array(*[F.lit(n) for n in catalog.NAMES])
    names = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(pool, (F.pmod(F.col("event_id") + i, F.lit(len(catalog.NAMES))) + 1).cast("int")))
    e = _spread(spark, sf, "events", "event_id", "props").select("event_id", (F.col("event_id") % 8).cast("int").alias("template"), _letter(k % 4).alias("x"), _letter((k + 1) % 4).alias("y"), (k % 4).alias("at"), names.alias("names"))
    x, name = F.col("x"), F.get("names", F.col("at"))
    rest = F.lit('", "reasoning": "r", "confidence": 0.5}')
    shapes = [
        F.concat(F.lit('{"answer": "'), x, rest),
        F.concat(F.lit('{"answer": "option '), F.lower(x), rest),
        F.concat(F.lit('{"answer": " '), F.upper(name), F.lit("."), rest),
        F.concat(F.lit('So: {"answer": "'), name, F.lit('"}')),
        F.concat(F.lit("Thought.\nFinal answer: "), F.lower(name), F.lit(". ")),
        F.concat(F.lit("Answer: "), F.col("y"), F.lit("\nFinal answer: "), name),
        F.concat(F.lit(" "), x, F.lit("\n")),
        F.lit('{"answer": "Nobody", "reasoning": "r", "confidence": 0.5}'),
    ]
    return e.select("event_id", "template", F.element_at(F.array(*shapes), F.col("template") + 1).alias("raw"), "names")


MODELS = ["m1", "m2"]


def signed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of four candidates with exactly one valid: (item_id, k, cl, ds, il, scenario, gold, constraints, sigs, wrong)."""
    return item_signatures(spark, sf).filter("valid = 1 AND size(sigs) = 4").select("item_id", "k", "cl", F.coalesce(distractor_level(F.col("wrong"), F.col("k")), F.lit("other")).alias("ds"), "il", F.concat(F.lit("s"), F.col("item_id") % 4).alias("scenario"), "gold", "constraints", "sigs", "wrong")


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs over the one-gold items: two models, three runs each, an answer drawn for each; (signed_items' columns,
    model_alias, run_id, answer, extractable, valid, correct, selected signature)."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(r).cast("long").alias("r")) for m in MODELS for r in (1, 2, 3)]))
    each = signed_items(spark, sf).select("*", grid.alias("g")).select("*", F.col("g.m").alias("model_alias"), F.col("g.r").alias("run_id")).drop("g")
    d = draw(F.lit("pick"), F.col("item_id"), F.col("model_alias"), F.col("run_id")) % 10
    drawn = each.withColumn("d", d).withColumn("answer", F.when(F.col("d") < 4, _letter(F.col("d"))).when(F.col("d") != 8, F.col("gold")))
    valid = F.col("answer").isNotNull() & (F.col("d") < 8)
    return drawn.withColumns({"extractable": F.col("d") < 8, "valid": valid, "correct": valid & (F.col("answer") == F.col("gold"))}).withColumn("selected", F.coalesce(F.element_at("sigs", F.col("answer")), F.expr("cast(array() as array<string>)"))).drop("d")


# The same tables for the DuckDB side, to stand before a query after WITH.
ITEM_SQL = """
placed_lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS place FROM lineitem),
lines AS (SELECT l_orderkey + place // 4 * 10000000000 AS item_id, place % 4 + 1 AS rn,
  [l_quantity >= 10, l_discount <= 0.08, l_returnflag <> 'R', l_tax <= 0.06, l_extendedprice < 60000, l_linestatus = 'O', l_shipdate >= TIMESTAMP '1997-01-01'] AS held FROM placed_lines),
candidates AS (SELECT item_id, chr(64 + rn::INT) AS label, unnest(['qty_ge_10', 'disc_le_08', 'not_returned', 'tax_le_06', 'price_lt_60k', 'status_open', 'shipped_from_1997']) AS attr, unnest(held) AS value FROM lines),
items AS (SELECT item_id, [3, 5, 7][(item_id % 3 + 1)::INT] AS k, 'CL' || (item_id % 3 + 1) AS cl, 'IL' || (item_id % 2 + 1) AS il FROM (SELECT DISTINCT item_id FROM candidates)),
constraints AS (SELECT item_id, pos, 'C' || pos AS constraint_id, ['qty_ge_10', 'disc_le_08', 'not_returned', 'tax_le_06', 'price_lt_60k', 'status_open', 'shipped_from_1997'][pos] AS attr, CASE WHEN pos = 6 THEN item_id % 2 = 0 ELSE true END AS required_value FROM items, (SELECT unnest(range(1, 8)) AS pos) WHERE pos <= k),
matrix AS (SELECT c.item_id, c.label, k.pos, k.constraint_id, k.attr, c.value = k.required_value AS satisfied FROM candidates c JOIN constraints k ON c.item_id = k.item_id AND c.attr = k.attr),
sigs AS (SELECT item_id, label, coalesce(string_agg(constraint_id, ',' ORDER BY pos) FILTER (NOT satisfied), '[]') AS signature, count(*) FILTER (NOT satisfied) AS n FROM matrix GROUP BY item_id, label),
golds AS (SELECT item_id, max(label) FILTER (n = 0) AS gold, count(*) FILTER (n = 0) AS valid, list_sort(list(n) FILTER (n > 0)) AS wrong, count(*) AS options FROM sigs GROUP BY item_id)
"""
RUN_SQL = """
placed_events AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS place, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ev AS (SELECT * REPLACE (user_id + place // 3 * 10000000000 AS user_id), place % 3 + 1 AS run_id FROM placed_events),
runs AS (SELECT user_id AS item_id, event_type AS model_alias, run_id, run_id * 11 AS seed, event_id, ['A', 'B', 'C', 'D', NULL][k % 5 + 1] AS answer, ['A', 'B', 'C', 'D'][(user_id % 4 + 1)::INT] AS gold_answer,
  coalesce(['A', 'B', 'C', 'D', NULL][k % 5 + 1] = ['A', 'B', 'C', 'D'][(user_id % 4 + 1)::INT], false) AS correct, k / 100.0::DOUBLE AS confidence, k % 5 < 4 AS extractable, k % 3 <> 0 AS json_compliant, k % 17 = 0 AS truncated,
  CASE WHEN k % 13 = 0 THEN 'timeout' END AS request_error, 'CL' || (user_id % 3 + 1) AS cl, 'IL' || (user_id % 2 + 1) AS il FROM ev)
"""
CALL_SQL = RUN_SQL + """,
calls AS (SELECT item_id, 'f' || (item_id % 2) AS family, CASE model_alias WHEN 'click' THEN 'A1' WHEN 'purchase' THEN 'A2' ELSE 'A3' END AS agent_id, CASE WHEN item_id % 3 = 0 THEN 'vulnerable' ELSE 'stable_control' END AS pilot_group,
  run_id - 1 AS round, answer, correct, CASE WHEN answer IS NULL THEN [] ELSE ['C1', 'C2', 'C3'][1 : (ascii(answer) - ascii(gold_answer) + 4) % 4] END AS violations FROM runs WHERE model_alias IN ('click', 'purchase', 'view'))
"""
RESPONSE_SQL = """
raws AS (SELECT event_id, (event_id % 14)::INT AS template, ['A', 'B', 'C', 'D'][CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] AS x, ['A', 'B', 'C', 'D'][(CAST(json_extract_string(props, '$.k') AS INT) + 1) % 4 + 1] AS y, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""
FOLLOWUP_SQL = """
told AS (SELECT event_id, (event_id % 8)::INT AS template, ['A', 'B', 'C', 'D'][CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] AS x, ['A', 'B', 'C', 'D'][(CAST(json_extract_string(props, '$.k') AS INT) + 1) % 4 + 1] AS y FROM events)
"""
# The one-gold items and the runs over them.
DS_SQL = "CASE WHEN wrong[3] IS NULL THEN 'other' WHEN wrong[3] = 1 THEN 'DS3' WHEN wrong[1] >= ceil(k / 2.0) THEN 'DS1' WHEN wrong[1] = 1 AND wrong[2] >= 2 THEN 'DS2' ELSE 'other' END"
PICK_SQL = ITEM_SQL + f""",
signed AS (SELECT item_id, k, cl, {DS_SQL} AS ds, il, 's' || (item_id % 4) AS scenario, gold, wrong FROM items JOIN golds USING (item_id) WHERE valid = 1 AND options = 4),
drawn AS (SELECT *, ('0x' || substr(md5('pick|' || item_id || '|' || model_alias || '|' || run_id), 1, 8))::UBIGINT % 10 AS d FROM signed, (VALUES ('m1'), ('m2')) m(model_alias), (SELECT unnest(range(1, 4)) AS run_id)),
chosen AS (SELECT *, CASE WHEN d < 4 THEN ['A', 'B', 'C', 'D'][d::INT + 1] WHEN d <> 8 THEN gold END AS answer, d < 8 AS extractable FROM drawn),
picks AS (SELECT *, answer IS NOT NULL AND extractable AS valid, answer IS NOT NULL AND extractable AND answer = gold AS correct FROM chosen)
"""
