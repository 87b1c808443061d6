"""Whole item documents: generated ones with all their texts, and the variants of an item.

An item is one wide row: constraints (array), options (label to text), entities (label to a struct), the stored matrix and
signatures, factors and metadata. Catalogs are constants of fixed size and stand in the plan as maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselattice.functions.scalar import LABELS, bound, draw, normalized, overlap, tokens
from caselattice.operators.generation import drawn, generate, generate_by_closeness, generate_for
from caselattice.sources import catalog

# The names of the contract that items follow.
VERSION, FAMILY, TASK, LANGUAGE = "4.1", "multi_constraint", "attribute_filter", "en"
MARKER = "\nCandidates:\n"


def labels() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def texts() -> Column:
    """Map from attribute to a struct of its texts if true and if false."""
    return F.create_map(*[x for a in catalog.ATTRIBUTES for x in (F.lit(a[0]), F.struct(F.lit(a[4]).alias("true"), F.lit(a[5]).alias("false")))])


def fact_pool() -> Column:
    """Map from fact to a struct of category, text and scenarios."""
    return F.create_map(*[x for f in catalog.FACTS for x in (F.lit(f[0]), F.struct(F.lit(f[1]).alias("category"), F.lit(f[2]).alias("text"), F.array(*[F.lit(x) for x in f[3]]).alias("scenarios")))])


def said(attribute: Column, value: Column) -> Column:
    """The catalog's text of an attribute's value; null if it does not know the attribute."""
    t = F.element_at(texts(), attribute)
    return F.when(value, t["true"]).otherwise(t["false"])


def _bit(mask: Column, pos: Column) -> Column:
    return F.getbit(mask, pos - 1) == 1


def documents(items: DataFrame, seed: int) -> DataFrame:
    """items (item_id, scenario, k, cl, ds, il, gold, constraints, wrong) as whole documents."""
    attributes = F.transform("constraints", lambda c: c["attribute"])
    place = F.ascii("gold") - 65
    names = F.slice(drawn(F.array(*[F.lit(n) for n in catalog.NAMES]), F.lit(seed), F.lit("name"), F.col("item_id")), 1, 4)
    facts = F.create_map(*[x for s in catalog.SCENARIOS for x in (F.lit(s[0]), F.array(*[F.lit(f[0]) for f in catalog.FACTS if s[0] in f[3]]).cast("array<string>"))])

    def entity(label: Column, mask: Column, name: Column, keys: Column) -> Column:
        held = F.map_from_arrays(keys, F.transform("constraints", lambda c: c["required_value"] != _bit(mask, c["pos"])))
        shuffled = drawn(keys, F.lit(seed), F.lit("order"), F.col("item_id"), label)
        # Facts are never shown in the order of the constraints.
        order = bound(shuffled, lambda s: F.when(s == keys, F.concat(F.slice(s, F.lit(2), F.size(s)), F.slice(s, 1, 1))).otherwise(s))
        beside = F.when(F.col("il") == "IL2", F.slice(drawn(F.element_at(facts, F.col("scenario")), F.lit(seed), F.lit("fact"), F.col("item_id"), label), 1, 2)).otherwise(F.expr("cast(array() as array<string>)"))
        shown = lambda a, v: F.struct(a.alias("attribute"), v.alias("value"), F.concat(name, F.lit(" "), said(a, v)).alias("text"))
        made = lambda b: F.struct(
            name.alias("name"),
            b["held"].alias("attributes"),
            F.transform(F.filter("constraints", lambda c: _bit(mask, c["pos"])), lambda c: c["constraint_id"]).alias("expected"),
            (label == F.col("gold")).alias("is_gold"),
            b["order"].alias("display_order"),
            F.transform(b["order"], lambda a: bound(F.element_at(b["held"], a), lambda v: shown(a, v))).alias("displayed"),
            F.transform(beside, lambda f: bound(F.element_at(fact_pool(), f), lambda p: F.struct(f.alias("key"), p["category"].alias("category"), F.concat(name, F.lit(" "), p["text"]).alias("text")))).alias("non_target"),
        )
        return bound(F.struct(held.alias("held"), order.alias("order")), made)

    all_four = lambda k: F.zip_with(labels(), k["names"], lambda x, n: bound(F.ascii(x) - 65, lambda i: entity(x, F.when(x == F.col("gold"), F.lit(0)).otherwise(F.get(k["wrong"], F.when(i < place, i).otherwise(i - 1))), n, k["keys"])))
    entities = F.map_from_arrays(labels(), bound(F.struct(attributes.alias("keys"), names.alias("names"), F.col("wrong").alias("wrong")), all_four))
    held = items.withColumn("entities", entities).withColumn("constraints", F.transform("constraints", lambda c: c.withField("text", F.concat(F.lit("The person "), said(c["attribute"], c["required_value"])))))
    option = lambda e: F.concat(F.array_join(F.transform(e["displayed"], lambda f: f["text"]), ", "), F.lit("."), F.array_join(F.transform(e["non_target"], lambda f: F.concat(F.lit(" "), f["text"], F.lit("."))), ""))
    told = held.withColumn("options", F.transform_values("entities", lambda _, e: option(e)))
    # Options by their map, not by label: if only the question is asked for, Spark puts what makes them in place of the map, and
    # inside a lambda over labels that would be worked out four times.
    lines = F.array_join(F.transform(F.map_entries("options"), lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")
    wanted = F.array_join(F.transform("constraints", lambda c: F.concat(c["text"], F.lit("."))), " ")
    return told.withColumns({
        "question": F.concat(F.lit("Who fits? "), wanted, F.lit(MARKER), lines, F.lit("\n\nName one letter.")),
        "matrix": F.transform_values("entities", lambda _, e: F.map_from_entries(F.transform("constraints", lambda c: F.struct(c["constraint_id"], F.element_at(e["attributes"], c["attribute"]) == c["required_value"])))),
        "signatures": F.transform_values("entities", lambda _, e: e["expected"]),
        "version": F.lit(VERSION), "family": F.lit(FAMILY), "task": F.lit(TASK), "language": F.lit(LANGUAGE),
        "empirical_difficulty": F.lit(None).cast("string"),
        "metadata": F.struct(F.lit(VERSION).alias("version"), F.lit(seed).alias("seed"), F.concat(F.lit("t"), draw(F.lit(seed), F.lit("template"), F.col("item_id")) % 4).alias("template_id"), F.expr("cast(array() as array<string>)").alias("warnings"), F.lit(True).alias("semantic_validation_passed")),
    }).drop("wrong")


def pool(spark: SparkSession, per_cell: int, seed: int) -> DataFrame:
    """per_cell documents of each of the 18 cells."""
    return documents(generate(spark, per_cell, seed), seed)


def pool_for(ids: DataFrame, seed: int) -> DataFrame:
    """A document for each id."""
    return documents(generate_for(ids, seed), seed)


def closeness_pool(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n documents of three to five constraints, by closeness."""
    made = generate_by_closeness(spark, n, seed)
    more = made.select("item_id", "option_closeness", "structural_complexity")
    return documents(made.drop("option_closeness", "structural_complexity"), seed).join(more, "item_id")


def replace_candidates(question: Column, options: Column) -> Column:
    """The question with other options between the marker and the last blank line; null unless both are there once."""
    parts = F.split(question, MARKER, -1)
    tail = F.get(parts, F.lit(1))
    lines = F.array_join(F.transform(labels(), lambda x: F.concat(x, F.lit(". "), F.element_at(options, x))), "\n")
    sound = (F.size(parts) == 2) & F.contains(tail, F.lit("\n\n"))
    return F.when(sound, F.concat(F.get(parts, F.lit(0)), F.lit(MARKER), lines, F.lit("\n\n"), F.substring_index(tail, "\n\n", -1)))


def rotated(items: DataFrame, rotations: int = 4) -> DataFrame:
    """Each document with its labels moved on by 0 to rotations - 1 places: whole items, not the gold letter alone."""
    each = items.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(rotations - 1))))
    to = lambda x: F.char(65 + F.pmod(F.ascii(x) - 65 + F.col("rotation"), F.lit(4)))
    moved = lambda m: F.map_from_entries(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(to(e["key"]).alias("key"), e["value"].alias("value")))))
    turned = each.withColumns({"options": moved("options"), "signatures": moved("signatures"), "gold": to(F.col("gold"))})
    # Maps of structs with maps cannot be sorted; their order does not matter.
    loose = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(to(e["key"]).alias("key"), e["value"].alias("value"))))
    turned = turned.withColumns({"entities": loose("entities"), "matrix": loose("matrix")})
    return turned.withColumns({"question": replace_candidates(F.col("question"), F.col("options")), "variant_id": F.concat_ws("_r", F.col("item_id").cast("string"), F.col("rotation").cast("string"))})


def without_suffix(option: Column, facts: Column) -> Column:
    """An option without its facts beside the point; null unless there are two and they are its exact end."""
    suffix = F.array_join(F.transform(facts, lambda f: F.concat(F.lit(" "), f["text"], F.lit("."))), "")
    sound = (F.size(facts) == 2) & F.endswith(option, suffix)
    return F.when(sound, F.left(option, F.char_length(option) - F.char_length(suffix)))


def information_pairs(items: DataFrame) -> DataFrame:
    """Each document of the second information level in both versions: as it is, and without its facts beside the point."""
    high = items.filter("il = 'IL2'").select("*", F.explode(F.array(F.lit("IL1"), F.lit("IL2"))).alias("pair_version"))
    low = F.col("pair_version") == "IL1"
    bare = F.map_zip_with("options", "entities", lambda _, o, e: F.when(low, without_suffix(o, e["non_target"])).otherwise(o))
    entities = F.transform_values("entities", lambda _, e: F.when(low, e.withField("non_target", F.slice(e["non_target"], 1, 0))).otherwise(e))
    made = high.withColumn("options", bare).withColumns({"entities": entities, "il": F.col("pair_version")})
    return made.withColumns({"question": replace_candidates(F.col("question"), F.col("options")), "variant_id": F.concat_ws("_", F.col("item_id").cast("string"), "pair_version")})


def lexical_audit(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(n_pairs, mean_overlap, n_exact, n_high) of displayed facts and the constraints on their attributes, of which the last
    counts where several are on one."""
    constraint = lambda f: F.element_at(F.filter("constraints", lambda c: c["attribute"] == f["attribute"]), -1)["text"]
    shown = F.flatten(F.transform(F.map_values("entities"), lambda e: e["displayed"]))
    held = F.transform(F.filter(shown, lambda f: F.exists("constraints", lambda c: c["attribute"] == f["attribute"])), lambda f: F.struct(f["text"].alias("fact"), constraint(f).alias("constraint")))
    # Texts come from catalogs, so pairs are often the same: they are counted before their words are taken.
    pairs = items.select(F.explode(held).alias("p")).select("p.*").groupBy("fact", "constraint").agg(F.count("*").alias("n"))
    told = pairs.select("n", overlap(tokens(F.col("fact")), tokens(F.col("constraint"))).alias("o"), (normalized(F.col("fact")) == normalized(F.col("constraint"))).alias("same"))
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return told.agg(number(F.lit(True)).alias("n_pairs"), F.round(F.sum(F.col("o") * F.col("n")) / F.sum("n"), 6).alias("mean_overlap"), number(F.col("same")).alias("n_exact"), number(F.col("o") >= threshold).alias("n_high"))


def shown_facts(items: DataFrame, shows: Callable[[Column], Column]) -> DataFrame:
    """(item_id, label, constraint_id, attribute, category, fact): each broken constraint with what the option shows of its
    attribute, or a fixed text where it shows nothing; shows(pos) says for which constraints to look."""
    categories = F.create_map(*[F.lit(x) for a in catalog.ATTRIBUTES for x in (a[0], a[1])])

    def of(entry: Column) -> Column:
        broken = F.filter("constraints", lambda c: F.array_contains(entry["value"]["expected"], c["constraint_id"]))

        def told(c: Column) -> Column:
            fact = F.get(F.transform(F.filter(entry["value"]["displayed"], lambda f: f["attribute"] == c["attribute"]), lambda f: f["text"]), F.lit(0))
            return F.struct(entry["key"].alias("label"), c["constraint_id"].alias("constraint_id"), c["attribute"].alias("attribute"), F.element_at(categories, c["attribute"]).alias("category"), F.coalesce(F.when(shows(c["pos"]), fact), F.lit("<missing displayed fact>")).alias("fact"))

        return F.transform(broken, told)

    return items.select("item_id", F.explode(F.flatten(F.transform(F.map_entries("entities"), of))).alias("f")).select("item_id", "f.*")
