"""Constraint items made by construction: every draw is a hash of the seed and the item, so no row depends on another.

An item of a cell has k constraints, a gold candidate that meets all, and three wrong ones whose broken constraints are
bit masks of the level that the cell asks for; nothing is drawn and thrown away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions.scalar import bound, complexity, draw
from caselattice.operators.validation import far_threshold
from caselattice.sources import catalog


def eligible(spark: SparkSession) -> DataFrame:
    """(scenario, key, category, may_be_false): a null list of keys allows all of the categories allowed."""
    found = catalog.attributes(spark).join(F.broadcast(catalog.scenarios(spark)), F.array_contains("scenarios", F.col("scenario")) & F.array_contains("categories", F.col("category")))
    return found.filter(F.coalesce(F.array_contains("keys", F.col("key")), F.lit(True))).select("scenario", "key", "category", "may_be_false")


def drawn(values: Column, *parts: Column, strings: bool = True) -> Column:
    """An array, without nulls, in the order of its elements' draws. Eight hex digits sort as `draw`'s numbers do; a string follows
    its digits in one string, which sorts quicker than a struct. What the elements share is joined once, not for each of them."""
    shared = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(""))
    digits = lambda p, v: F.substr(F.md5(F.concat(p, v.cast("string"))), F.lit(1), F.lit(8))
    key = (lambda p, v: F.concat(digits(p, v), v)) if strings else (lambda p, v: F.struct(digits(p, v).alias("d"), v.alias("v")))
    keyed = bound(shared, lambda p: F.transform(values, lambda v: key(p, v)))
    return F.transform(F.sort_array(keyed), lambda x: F.substr(x, F.lit(9)) if strings else x["v"])


def cells(spark: SparkSession) -> DataFrame:
    """The 18 cells of the three factors: constants, not rows of a table."""
    level = lambda name, n: F.explode(F.array(*[F.lit(f"{name.upper()}{i + 1}") for i in range(n)])).alias(name)
    return spark.range(1).select(level("cl", 3)).select("cl", level("ds", 3)).select("cl", "ds", level("il", 2))


def generate(spark: SparkSession, per_cell: int, seed: int) -> DataFrame:
    """(item_id, scenario, cl, ds, il, gold, constraints, wrong masks): per_cell items of each of the 18 cells."""
    level = lambda n, name: spark.range(n).select(F.col("id").alias(name))
    base = level(3, "c").crossJoin(level(3, "d")).crossJoin(level(2, "i")).crossJoin(level(per_cell, "n"))
    return _made(spark, base.withColumn("number", ((F.col("c") * 3 + F.col("d")) * 2 + F.col("i")) * per_cell + F.col("n")), seed)


def generate_for(ids: DataFrame, seed: int) -> DataFrame:
    """As generate, an item for each id of `ids` (item_id, whole numbers from 0): twelve ids in a row, with all pairs of a gold label
    and a scenario, are of one cell, the next twelve of the next."""
    cell = F.expr("(item_id div 12) % 18")
    # An id is eight bytes, a document thousands: ids are dealt out first, as the files of a small table are few.
    context = ids.sparkSession.sparkContext
    ids = ids.select("item_id").repartition(max(4 * context.defaultParallelism, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return _made(ids.sparkSession, ids.select(F.col("item_id").cast("long").alias("number"), F.expr("(item_id div 12) % 18 div 6").alias("c"), F.expr("(item_id div 12) % 18 div 2 % 3").alias("d"), (cell % 2).alias("i")), seed)


def _made(spark: SparkSession, base: DataFrame, seed: int) -> DataFrame:
    """Items for rows of a number and the places c, d and i of the levels of their factors."""
    number = F.col("number")
    scenario = F.element_at(F.array(*[F.lit(s[0]) for s in catalog.SCENARIOS]), (number % len(catalog.SCENARIOS) + 1).cast("int"))
    items = base.select(number.alias("item_id"), scenario.alias("scenario"), (F.col("c") * 2 + 3).cast("int").alias("k"), F.concat(F.lit("CL"), F.col("c") + 1).alias("cl"), F.concat(F.lit("DS"), F.col("d") + 1).alias("ds"), F.concat(F.lit("IL"), F.col("i") + 1).alias("il"), F.char(65 + number % 4).alias("gold"))
    # Catalogs are constants of this module's size; a scenario's attributes are one array.
    pools = eligible(spark).groupBy("scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "may_be_false")))).alias("flags"))
    chosen = items.join(F.broadcast(pools), "scenario")
    keys = F.slice(drawn(F.map_keys("flags"), F.lit(seed), F.col("item_id")), F.lit(1), F.col("k"))
    required = lambda a: ~(F.element_at("flags", a) & (draw(F.lit(seed), F.lit("required"), F.col("item_id"), a) % 2 == 0))
    constraints = F.transform(keys, lambda a, p: F.struct((p + 1).alias("pos"), F.concat(F.lit("C"), p + 1).alias("constraint_id"), a.alias("attribute"), required(a).alias("required_value")))
    # Masks that the level cannot take are left out before the draws, which do not depend on what else is drawn.
    every = F.sequence(F.lit(1), (F.pow(F.lit(2), F.col("k")) - 1).cast("int"))
    of = lambda test, n: F.slice(drawn(F.filter(every, test), F.lit(seed), F.lit("mask"), F.col("item_id"), strings=False), 1, n)
    single, several = (lambda m: F.bit_count(m) == 1), (lambda m: F.bit_count(m) >= 2)
    far = lambda m: F.bit_count(m) >= far_threshold(F.col("k"))
    wrong = F.when(F.col("ds") == "DS1", of(far, 3)).when(F.col("ds") == "DS2", F.concat(of(single, 1), of(several, 2))).otherwise(of(single, 3))
    return chosen.withColumns({"constraints": constraints, "wrong": wrong}).select("item_id", "scenario", "k", "cl", "ds", "il", "gold", "constraints", "wrong")


def feasible_counts(closeness: Column) -> Column:
    """Numbers of constraints that a closeness can be made with."""
    return F.when(closeness == "hard", F.array(F.lit(3))).when(closeness == "medium", F.array(F.lit(3), F.lit(4))).when(closeness == "easy", F.array(F.lit(3), F.lit(4), F.lit(5)))


def ratio_counts(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole numbers in these shares: floors, then one each for the largest shares, in the order given."""
    counts = {k: int(total * r) for k, r in ratios.items()}
    for k in sorted(ratios, key=lambda k: -ratios[k])[: total - sum(counts.values())]:
        counts[k] += 1
    return counts


def generate_by_closeness(spark: SparkSession, n: int, seed: int, ratios: dict[str, float] | None = None) -> DataFrame:
    """n items in shares of closeness (0.2 easy, 0.6 medium, 0.2 hard), shuffled; scenarios and gold labels take turns in
    each closeness. Wrong options' masks are made to fit and to exclude by every constraint, not drawn until they do."""
    counts = ratio_counts(n, ratios or {"easy": 0.2, "medium": 0.6, "hard": 0.2})
    quota = F.posexplode(F.concat(*[F.array_repeat(F.lit(k), c) for k, c in counts.items()])).alias("slot", "closeness")
    slots = spark.range(1).select(quota).withColumn("slot", F.col("slot").cast("long"))
    turn = F.row_number().over(W.partitionBy("closeness").orderBy(draw(F.lit(seed), F.lit("slot"), F.col("slot")), "slot")) - 1
    number = lambda xs, i: F.element_at(xs, (i % F.size(xs) + 1).cast("int"))
    names = F.array(*[F.lit(s[0]) for s in catalog.SCENARIOS])
    items = slots.withColumn("turn", turn).select(F.col("slot").alias("item_id"), F.col("closeness").alias("option_closeness"), number(names, F.col("turn")).alias("scenario"), number(feasible_counts(F.col("closeness")), F.floor(F.col("turn") / 4)).alias("k"), F.char(65 + F.col("turn") % 4).alias("gold"))
    pools = eligible(spark).groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("key", "may_be_false"))).alias("pool"))
    flags = F.map_from_entries("pool")
    keys = F.slice(drawn(F.map_keys(flags), F.lit(seed), F.col("item_id")), F.lit(1), F.col("k"))
    required = lambda a: ~(F.element_at(flags, a) & (draw(F.lit(seed), F.lit("required"), F.col("item_id"), a) % 2 == 0))
    constraints = F.transform(keys, lambda a, p: F.struct((p + 1).alias("pos"), F.concat(F.lit("C"), p + 1).alias("constraint_id"), a.alias("attribute"), required(a).alias("required_value")))
    places = drawn(F.sequence(F.lit(0), F.col("k") - 1), F.lit(seed), F.lit("place"), F.col("item_id"), strings=False)
    of = lambda *at: sum((F.pow(F.lit(2), F.get("places", F.lit(i))) for i in at), F.lit(0)).cast("int")
    wrong = (
        F.when(F.col("option_closeness") == "hard", F.array(of(0), of(1), of(2)))
        .when(F.col("option_closeness") == "medium", F.when(F.col("k") == 3, F.array(of(0), of(1), of(2, 0))).otherwise(F.array(of(0), of(1), of(2, 3))))
        .when(F.col("k") == 3, F.array(of(0, 1), of(1, 2), of(0, 1, 2)))
        .when(F.col("k") == 4, F.array(of(0, 1), of(2, 3), of(0, 1, 2)))
        .otherwise(F.array(of(0, 1), of(2, 3), of(4, 0)))
    )
    made = items.join(F.broadcast(pools), "scenario").withColumns({"constraints": constraints, "places": places}).withColumn("wrong", wrong)
    cl = F.when(F.col("k") == 3, "CL1").when(F.col("k") == 5, "CL2")
    return made.select("item_id", "scenario", "k", cl.alias("cl"), F.lit(None).cast("string").alias("ds"), F.lit("IL1").alias("il"), "gold", "constraints", "wrong", "option_closeness", complexity(F.col("k")).alias("structural_complexity"))


def candidates_of(items: DataFrame) -> DataFrame:
    """(item_id, label, attributes map): the gold label's values are those required, the others' flipped by their mask."""
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    others = F.array_except(labels, F.array("gold"))
    each = items.select("item_id", "constraints", F.explode(F.zip_with(F.concat(F.array("gold"), others), F.concat(F.array(F.lit(0)), F.col("wrong")), lambda label, mask: F.struct(label.alias("label"), mask.alias("mask")))).alias("o"))
    bit = lambda p: F.floor(F.col("o.mask") / F.pow(F.lit(2), p)) % 2 == 1
    values = F.transform("constraints", lambda c: c["required_value"] != bit(c["pos"] - 1))
    return each.select("item_id", F.col("o.label").alias("label"), F.map_from_arrays(F.transform("constraints", lambda c: c["attribute"]), values).alias("attributes"))


def rendered(spark: SparkSession, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, label, option): a candidate's facts in an order that a hash gives, joined by the catalog's texts. A fact that
    the catalog lacks makes the option null, not shorter."""
    texts = F.broadcast(catalog.attributes(spark).select("key", "text_true", "text_false"))
    each = candidates.select("item_id", "label", F.explode("attributes").alias("key", "value")).join(texts, "key", "left")
    said = F.struct(draw(F.lit("order"), F.col("item_id"), F.col("label"), F.col("key")).alias("d"), F.when(F.col("value"), F.col("text_true")).otherwise(F.col("text_false")).alias("t"))
    said = F.array_sort(F.collect_list(said))
    return each.groupBy("item_id", "label").agg(F.when(F.forall(said, lambda x: x["t"].isNotNull()), F.concat(F.array_join(F.transform(said, lambda x: x["t"]), ", "), F.lit("."))).alias("option"))
