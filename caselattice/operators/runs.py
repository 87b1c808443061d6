"""Runs of models over items: rollups, disagreement, inventories, factor contrasts, intervals and ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions.draws import drawer
from caselattice.functions.scalar import LABELS, empirical_difficulty, lower_rank, rate_or_zero, ratio, rounded, screening_category, valid_answer


def answer_counts(answer: Column) -> list[Column]:
    """A count for each label, and of the rest."""
    return [F.count_if(answer == x).alias(f"n_{x.lower()}") for x in LABELS] + [F.count_if(answer.isNull() | ~answer.isin(LABELS)).alias("n_invalid")]


def item_analysis(runs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row an item; items without runs count zeros if items are given."""
    answer = valid_answer(F.col("answer"))
    found = runs.groupBy("item_id").agg(
        F.count("*").alias("n_runs"),
        F.count_if("correct").alias("n_correct"),
        rounded(rate_or_zero(F.col("correct"))).alias("accuracy"),
        *answer_counts(F.col("answer")),
        F.array_join(F.array_sort(F.collect_set(answer)), ",").alias("answers"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("correct"), answer))), ",").alias("wrong_answers"),
    )
    if items is not None:
        found = items.select("item_id").join(found, "item_id", "left").fillna(0).fillna("")
    return found.withColumns({"category": screening_category(F.col("n_correct")), "difficulty": empirical_difficulty(F.col("n_correct"))})


def disagreement(runs: DataFrame) -> DataFrame:
    """(item_id, within_model, cross_model): more than one valid answer of one model; unlike counts between models."""
    per_model = runs.groupBy("item_id", "model_alias").agg(F.countDistinct(valid_answer(F.col("answer"))).alias("kinds"), F.struct(*answer_counts(F.col("answer"))[:4]).alias("counts"), F.count(valid_answer(F.col("answer"))).alias("valid"))
    shown = F.when(F.col("valid") > 0, F.col("counts"))
    return per_model.groupBy("item_id").agg(F.coalesce(F.bool_or(F.col("kinds") > 1), F.lit(False)).alias("within_model"), (F.size(F.collect_set(shown)) > 1).alias("cross_model"))


def rollup(runs: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates by keys, each rate over its own denominator."""
    valid = valid_answer(F.col("answer"), F.col("extractable"))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("request_error").isNotNull()).alias("n_errors"),
        F.count(valid).alias("n_valid"),
        F.count_if(F.col("correct") & valid.isNotNull()).alias("n_correct"),
        ratio(F.count_if(F.col("correct") & valid.isNotNull()), F.count(valid)).alias("valid_accuracy"),
        ratio(F.count_if("truncated"), F.count_if(F.col("request_error").isNull())).alias("truncated_rate"),
        ratio(F.count_if("json_compliant"), F.count("*")).alias("compliant_rate"),
        # Sums of decimals do not depend on the order of rows.
        rounded(F.try_divide(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double"), F.count("confidence").cast("double"))).alias("mean_confidence"),
    )


def grouped_accuracy(runs: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, level, n, accuracy) for every dimension in one pass: one grouping set each."""
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dimensions])
    name = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    sets = [[F.col(d)] for d in dimensions]
    return runs.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(name.alias("dimension"), level.alias("level"), F.count("*").alias("n"), rounded(rate_or_zero(F.col("correct"))).alias("accuracy")).select("dimension", "level", "n", "accuracy")


def grid(items: DataFrame, models: DataFrame, run_ids: list[int]) -> DataFrame:
    """Every key that should be there. Models are a configuration's; both factors but the items are small."""
    return items.select("item_id").distinct().crossJoin(F.broadcast(models.select("model_alias").distinct())).select("item_id", "model_alias", F.explode(F.array(*[F.lit(i).cast("long") for i in run_ids])).alias("run_id"))


def inventory(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Problems by key: missing, duplicate and unknown keys, with how often each is there."""
    keys = ["item_id", "model_alias", "run_id"]
    seen = runs.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.withColumn("wanted", F.lit(True)).join(seen, keys, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(*keys, problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).filter("problem IS NOT NULL")


def controlled_contrasts(runs: DataFrame, factor: str, levels: list[str], held: list[str]) -> DataFrame:
    """Accuracy along a factor's levels with the other factors held, and its trend."""
    rates = runs.groupBy(*held).pivot(factor, levels).agg(ratio(F.count_if("correct"), F.count(F.lit(1))))
    cols = [F.col(x) for x in levels]
    missing = F.lit(False)
    for c in cols:
        missing = missing | c.isNull()
    flat = F.greatest(*cols) == F.least(*cols)
    down, up = F.lit(True), F.lit(True)
    for a, b in zip(cols, cols[1:], strict=False):
        down, up = down & (b <= a), up & (b >= a)
    return rates.withColumn("trend", F.when(missing, "incomplete").when(flat, "flat").when(down, "harder").when(up, "easier").otherwise("nonmonotonic"))


def average_ranks(df: DataFrame, value: str, *within: str) -> Column:
    """Rank with ties at their mean. The window is over cells, few a group."""
    whole = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    return F.rank().over(whole.orderBy(value)) + (F.count("*").over(W.partitionBy(*(within or (F.lit(0),)), value)) - 1) / F.lit(2.0)


def spearman(x: Column, y: Column) -> Column:
    """Pearson's correlation of two ranks, from sums; null without two rows or without variance."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    top = n * F.sum(x * y) - sx * sy
    low = F.sqrt((n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy))
    return F.when(n >= 2, F.round(F.try_divide(top, low), 6))


def placed(items: DataFrame, key: str, order: str, block: int = 1024) -> DataFrame:
    """items with `pos` (from 0, by the whole number `order` within `key`) and `size` of their key. Rows are numbered inside
    blocks of `order`; only windows over blocks, of one row for up to `block` rows and again for up to `block` blocks, cross
    them."""
    each = items.withColumn("_block", F.floor(F.col(order) / block))
    sizes = each.groupBy(key, "_block").agg(F.count("*").alias("_n")).withColumn("_wide", F.floor(F.col("_block") / block))
    ahead = lambda by, *keys: F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wides = sizes.groupBy(key, "_wide").agg(F.sum("_n").alias("_n"))
    wides = wides.select(key, "_wide", ahead("_wide", key).alias("_from_wide"), F.sum("_n").over(W.partitionBy(key)).alias("size"))
    starts = sizes.select(key, "_block", "_wide", ahead("_block", key, "_wide").alias("_from_block")).join(wides, [key, "_wide"])
    inside = F.row_number().over(W.partitionBy(key, "_block").orderBy(order)) - 1
    return each.withColumn("_in", inside).join(starts, [key, "_block"]).withColumn("pos", F.col("_in") + F.col("_from_block") + F.col("_from_wide")).drop("_block", "_wide", "_in", "_from_block", "_from_wide")


#: Positions in an array and in a task, resamples of a task, and draws made at once.
BLOCK, RANGE, RESAMPLES, DRAWS = 1 << 14, 1 << 23, 100, 1 << 14


def cluster_bootstrap(items: DataFrame, key: str, top: str, bottom: str, resamples: int = 1000, seed: int = 17) -> DataFrame:
    """(lower, upper) of a ratio of sums over resampled clusters: draw number d of resample r takes the cluster whose
    position a hash gives. items: one row a cluster and group `key`, with `pos` from 0, `size` of its group and whole numbers.

    A group's numbers lie by position in arrays of BLOCK, which go to the tasks of its resamples; there draws are made and
    looked up in pieces, so that no draw is a row. A task holds RANGE positions at most; in a larger group each range of it
    makes the draws anew and takes those that fall into it."""
    lists = items.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), F.floor(F.col("pos") / BLOCK).alias("block"))
    numbers = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(top, F.lit(0)).alias("t"), F.coalesce(bottom, F.lit(0)).alias("b"))))
    blocks = lists.agg(F.max("size").alias("size"), numbers.alias("x")).select("key", "block", "size", F.transform("x", lambda x: x["t"].cast("long")).alias("tops"), F.transform("x", lambda x: x["b"].cast("long")).alias("bottoms"))
    chunks = -(-resamples // RESAMPLES)
    dealt = blocks.withColumns({"range": F.floor(F.col("block") / (RANGE // BLOCK)), "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
    make = drawer()

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        tops, bottoms = (np.concatenate(list(rows[c])) for c in ("tops", "bottoms"))
        size, low, name, chunk = int(rows["size"].iloc[0]), int(rows["block"].iloc[0]) * BLOCK, rows["key"].iloc[0], int(rows["chunk"].iloc[0])
        of = range(chunk * RESAMPLES, min(resamples, (chunk + 1) * RESAMPLES))
        sums = np.zeros((2, len(of)), np.int64)
        for at in range(0, size, DRAWS):
            for r, found in make([f"{seed}|{name}|{r}|".encode() for r in of], at, min(size, at + DRAWS)):
                place = found.astype(np.int64) % size - low
                if len(tops) < size:
                    place = place[(place >= 0) & (place < len(tops))]
                sums[0, r] += tops[place].sum(dtype=np.int64)
                sums[1, r] += bottoms[place].sum(dtype=np.int64)
        return pd.DataFrame({key: name, "r": list(of), "top": sums[0], "bottom": sums[1]})

    parts = dealt.repartition(8 * chunks, "key", "range", "chunk").groupBy("key", "range", "chunk").applyInPandas(resample, f"{key} string, r long, top long, bottom long")
    sums = parts.groupBy(key, "r").agg(F.try_divide(F.sum("top").cast("double"), F.sum("bottom").cast("double")).alias("rate"))
    ordered = sums.groupBy(key).agg(F.array_sort(F.collect_list("rate")).alias("rates"))
    return ordered.select(key, F.round(lower_rank(F.col("rates"), 0.025), 6).alias("lower"), F.round(lower_rank(F.col("rates"), 0.975), 6).alias("upper"))


def matched_once(stable: DataFrame, group: str, factors: list[str]) -> DataFrame:
    """stable (item_id, group, factors, target): (item_id, group, control_id), greedy and without replacement.

    Targets of equal factors want the same controls in the same order, so what is chosen follows from ids by cell alone: a
    group's cells come to one task as sorted lists of ids, sixteen bytes a row, and are walked once."""
    cells = stable.groupBy(group, *factors).agg(F.array_sort(F.collect_list(F.when(F.col("target"), F.col("item_id")))).alias("targets"), F.array_sort(F.collect_list(F.when(~F.col("target"), F.col("item_id")))).alias("controls"))
    shape = f"item_id long, {group} string, control_id long"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [tuple(r) for r in rows[factors].itertuples(index=False)]
        controls, at = [list(x) for x in rows["controls"]], [0] * len(rows)
        wanted = sorted((int(i), k) for k, ids in enumerate(rows["targets"]) for i in ids)
        unlike = [[sum(a != b for a, b in zip(x, y, strict=True)) for y in keys] for x in keys]
        out = []
        for item, k in wanted:
            free = [(unlike[k][c], controls[c][at[c]], c) for c in range(len(keys)) if at[c] < len(controls[c])]
            best = min(free, default=None)
            if best:
                at[best[2]] += 1
            out.append((item, rows[group].iloc[0], int(best[1]) if best else None))
        return pd.DataFrame(out, columns=["item_id", group, "control_id"]).astype({"control_id": "Int64"})

    return cells.groupBy(group).applyInPandas(walk, shape)
