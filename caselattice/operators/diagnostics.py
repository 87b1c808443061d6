"""What runs over items with known constraints say: errors by attribute, exposures, paired versions, positions, reviews.

Runs here are wide rows: the item's constraints and signatures ride with each (views.picks), so nothing is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.functions.scalar import draw, lower_rank, ratio

# The outcomes of the suitability decision and the classes of reasoning.
TOO_DIFFICULT, TOO_EASY, SUITABLE = "RESULT: TASK TOO DIFFICULT FOR CLEAN DRIFT ANALYSIS", "RESULT: TASK TOO EASY FOR PRIMARY MAD DIAGNOSIS", "RESULT: SUITABLE FOR BASELINE MAD PILOT"
RELAXED, SUBSTITUTED, MISREAD = "explicit_requirement_relaxation", "unsupported_constraint_substitution", "selected_fact_misread_or_not_applied"
MISSING_FACT = "<missing displayed fact>"


def suitability(accuracy: Column, items: Column, stable: Column, mild_or_mixed: Column, mostly_wrong: Column, disagreement: Column, single_rate: Column) -> Column:
    """The ordered decision over one row of counts."""
    return (
        F.when((accuracy < 0.5) | (mostly_wrong >= 50), TOO_DIFFICULT)
        .when((stable / F.greatest(items, F.lit(1)) >= 0.85) & (mild_or_mixed < 10) & (disagreement < 10), TOO_EASY)
        .when((mild_or_mixed >= 10) & (disagreement >= 10) & (single_rate >= 0.5), SUITABLE)
        .when((accuracy >= 0.95) & (disagreement < 10), TOO_EASY)
        .otherwise(SUITABLE)
    )


def reasoning_class(text: Column) -> Column:
    """By the first of three kinds of phrase that the lower-cased text holds."""
    has = lambda *words: F.greatest(*[F.contains(F.lower(text), F.lit(w)) for w in words]) if len(words) > 1 else F.contains(F.lower(text), F.lit(words[0]))
    return F.when(has("not required", "isn't required"), RELAXED).when(has("implied", " via ", "equivalent"), SUBSTITUTED).otherwise(MISREAD)


def at_risk(constraints: Column, attributes: list[str]) -> Column:
    """The constraints on attributes of a risk set."""
    return F.filter(constraints, lambda c: c["attribute"].isin(attributes))


def wrong_sizes(runs: DataFrame) -> DataFrame:
    """(bucket, n_wrong, share) of the signatures of chosen wrong options. An empty one counts as three or more."""
    n = F.size("selected")
    counts = runs.filter(F.col("answer").isNotNull() & (F.col("answer") != F.col("gold"))).groupBy(F.when(n == 1, "1_constraint").when(n == 2, "2_constraints").otherwise("3_or_more_constraints").alias("bucket")).agg(F.count("*").alias("n_wrong"))
    total = counts.agg(F.sum("n_wrong").alias("total"))
    return counts.crossJoin(total).select("bucket", "n_wrong", ratio(F.col("n_wrong"), F.col("total")).alias("share"))


def attribute_errors(items: DataFrame, runs: DataFrame, runs_per_item: int) -> DataFrame:
    """(attribute, n_violations, n_items, run_exposure, rate, per_item): violations by chosen wrong options over items that
    hold the attribute, times the runs that each was to have."""
    held = items.select("item_id", F.explode(F.array_distinct(F.transform("constraints", lambda c: c["attribute"]))).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n_items"))
    wrong = runs.filter(F.col("answer").isNotNull() & (F.col("answer") != F.col("gold")))
    broken = F.transform(F.filter("constraints", lambda c: F.array_contains("selected", c["constraint_id"])), lambda c: c["attribute"])
    errors = wrong.select(F.explode(broken).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n_violations"))
    return _error_rates(held.join(errors, "attribute", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0))), runs_per_item)


def attribute_errors_in(runs: DataFrame, first: Column, runs_per_item: int) -> DataFrame:
    """attribute_errors where each item has runs, of which `first` marks one: as its constraints ride with them, one pass counts
    items and errors."""
    wrong = F.col("answer").isNotNull() & (F.col("answer") != F.col("gold"))
    broken = lambda a: F.size(F.filter("constraints", lambda c: (c["attribute"] == a) & F.array_contains("selected", c["constraint_id"])))
    each = F.transform(F.array_distinct(F.transform("constraints", lambda c: c["attribute"])), lambda a: F.struct(a.alias("attribute"), F.when(wrong, broken(a)).otherwise(0).alias("broken")))
    seen = runs.where(first | wrong).select(first.alias("first"), F.explode(each).alias("e")).select("first", "e.*")
    return _error_rates(seen.groupBy("attribute").agg(F.sum("broken").alias("n_violations"), F.count_if("first").alias("n_items")), runs_per_item)


def _error_rates(counts: DataFrame, runs_per_item: int) -> DataFrame:
    found = counts.select("attribute", "n_violations", "n_items", (F.col("n_items") * runs_per_item).alias("run_exposure"))
    return found.withColumns({"rate": ratio(F.col("n_violations"), F.col("run_exposure")), "per_item": ratio(F.col("n_violations"), F.col("n_items"))})


def exposure(items: DataFrame, runs: DataFrame) -> DataFrame:
    """(model_alias, null for all, attribute, n_errors, n_items, valid_exposure, violatable_exposure and two rates). A valid run
    exposes each of its item's constraints, and those violatably that some wrong option breaks."""
    wrong = F.map_filter("sigs", lambda label, _: label != F.col("gold"))
    breakable = F.array_distinct(F.flatten(F.map_values(wrong)))
    each = F.transform("constraints", lambda c: F.struct(c["attribute"].alias("attribute"), F.array_contains(breakable, c["constraint_id"]).alias("violatable"), (~F.col("correct") & F.array_contains("selected", c["constraint_id"])).alias("error")))
    seen = runs.filter("valid").select("model_alias", F.explode(each).alias("e")).select("model_alias", "e.*")
    held = items.select(F.explode(F.array_distinct(F.transform("constraints", lambda c: c["attribute"]))).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n_items"))
    counts = seen.groupingSets([[F.col("model_alias"), F.col("attribute")], [F.col("attribute")]], "model_alias", "attribute").agg(F.count_if("error").alias("n_errors"), F.count("*").alias("valid_exposure"), F.count_if("violatable").alias("violatable_exposure"))
    found = counts.join(held, "attribute")
    return found.withColumns({"rate_per_violatable": ratio(F.col("n_errors"), F.col("violatable_exposure")), "rate_per_valid": ratio(F.col("n_errors"), F.col("valid_exposure"))})


def paired_deltas(runs: DataFrame, runs_per_version: int) -> DataFrame:
    """runs (item_id, model_alias, version, valid, correct, …): a row for each item and model with both versions' valid runs,
    accuracies and their difference, null unless all runs of both are valid."""
    low, high = F.col("version") == "IL1", F.col("version") == "IL2"
    share = lambda v: F.try_divide(F.count_if(F.col("correct") & v).cast("double"), F.count_if(F.col("valid") & v).cast("double"))
    kinds = lambda v: F.size(F.collect_set(F.when(F.col("valid") & v, F.col("answer")))) >= 2
    paired = runs.groupBy("item_id", "model_alias", "cl", "ds").agg(F.count_if(F.col("valid") & low).alias("low_valid"), F.count_if(F.col("valid") & high).alias("high_valid"), share(low).alias("low"), share(high).alias("high"), kinds(low).alias("low_disagrees"), kinds(high).alias("high_disagrees"))
    whole = (F.col("low_valid") == runs_per_version) & (F.col("high_valid") == runs_per_version)
    return paired.withColumn("delta", F.when(whole, F.round(F.col("high") - F.col("low"), 6)))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """By model, overall and by each of two factors: complete pairs, mean difference and how many it is below, above, at 0."""
    scope = F.when(F.grouping("cl") == 0, "cl").when(F.grouping("ds") == 0, "ds").otherwise("all")
    m, cl, ds = (F.col(x) for x in ("model_alias", "cl", "ds"))
    return pairs.groupingSets([[m], [m, cl], [m, ds]], m, cl, ds).agg(
        scope.alias("scope"), F.count("*").alias("n_items"), F.count("delta").alias("n_complete"), F.round(F.avg("delta"), 6).alias("mean_delta"),
        F.count_if(F.col("delta") < 0).alias("harder"), F.count_if(F.col("delta") > 0).alias("easier"), F.count_if(F.col("delta") == 0).alias("unchanged"),
    ).select("model_alias", "scope", F.coalesce("cl", "ds", F.lit("all")).alias("level"), "n_items", "n_complete", "mean_delta", "harder", "easier", "unchanged")


def mean_interval(values: DataFrame, key: str, value: str, resamples: int = 5000, seed: int = 17) -> DataFrame:
    """(key, lower, upper) of the mean of `value` over resampled rows.

    values: one row a value and a group `key`, with `kind` (equal values, numbered from 0), `upto` (rows up to this kind in the
    group) and `size`. A draw falls on a kind with the chance of its rows, so a group's few kinds stand for its many rows."""
    kinds = values.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct("upto", value))).alias("kinds"))
    each = kinds.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition(max(1, resamples // 50), key, "r")
    at = lambda d: draw(F.lit(seed), F.col(key), F.col("r"), d) % F.col("size")
    drawn = lambda d: F.element_at(F.transform(F.array(at(d)), lambda x: F.get(F.filter("kinds", lambda k: k["upto"] > x), F.lit(0))[value]), 1)
    total = F.aggregate(F.sequence(F.lit(0), (F.col("size") - 1).cast("int")), F.lit(0.0), lambda acc, d: acc + drawn(d))
    rates = each.select(key, (total / F.col("size")).alias("mean")).groupBy(key).agg(F.array_sort(F.collect_list("mean")).alias("means"))
    return rates.select(key, F.round(lower_rank(F.col("means"), 0.025), 6).alias("lower"), F.round(lower_rank(F.col("means"), 0.975), 6).alias("upper"))


def behaviour(runs: DataFrame, runs_per_item: int, *keys: str) -> DataFrame:
    """A row for each item and keys: runs, valid and right ones, and what they say together."""
    answer = F.when(F.col("valid"), F.col("answer"))
    found = runs.groupBy("item_id", *keys).agg(F.count("*").alias("n_runs"), F.count_if("valid").alias("n_valid"), F.count_if("correct").alias("n_correct"), F.array_sort(F.collect_set(answer)).alias("answers"), F.array_sort(F.collect_set(F.when(F.col("valid") & ~F.col("correct"), F.col("answer")))).alias("wrong_options"))
    whole = F.col("n_valid") == runs_per_item
    return found.withColumns({
        "accuracy": ratio(F.col("n_correct"), F.col("n_valid")),
        "complete": whole,
        "all_correct": whole & (F.col("n_correct") == runs_per_item),
        "all_wrong": whole & (F.col("n_correct") == 0),
        "mixed": (F.col("n_correct") > 0) & (F.col("n_correct") < F.col("n_valid")),
        "disagrees": F.size("answers") >= 2,
    })
