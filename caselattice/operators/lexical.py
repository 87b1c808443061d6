"""Set-similarity joins by overlap coefficient: which texts share most of the smaller one's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.functions.scalar import overlap
from caselattice.sources.folders import stored

#: Rows that are broadcast at most; with more a join shuffles both sides.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _prefix(ordered: Column, least: float) -> Column:
    """So many tokens of a set that any set with a share of `least` of it has one of them."""
    n = F.size(ordered)
    # A product that should be whole may come out just above it.
    return F.slice(ordered, 1, n - F.greatest(F.lit(1), F.ceil(n * F.lit(least) - 1e-9)).cast("int") + 1)


def overlapping(texts: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """(text_id, item_id, overlap): all pairs whose sets of tokens share at least `least` of the smaller set.

    texts (text_id, tokens) may be of any size, items (item_id, tokens) are the fewer. Where the item is the smaller set, one of
    its tokens that fewest texts hold must be in the text; where the text is, one of those of its own that fewest items hold, which
    for most texts are tokens of no item. Only pairs that share such a token are compared. Empty sets are in no pair."""
    # Texts are asked four times for their tokens, which are dear to find.
    texts, items = stored(texts.where(F.size("tokens") > 0)), stored(items.where(F.size("tokens") > 0))
    held = items.select("item_id", F.size("tokens").alias("item_size"), F.explode("tokens").alias("token"))
    by_items = stored(held.groupBy("token").agg(F.count("*").alias("n_items")))
    tokens = by_items.count()
    spread = texts.select("text_id", F.size("tokens").alias("text_size"), F.explode("tokens").alias("token"))
    by_texts = spread.join(_small(by_items.select("token"), tokens), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n_texts"))
    ranked = held.join(by_texts, "token", "left").groupBy("item_id", "item_size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n_texts", F.lit(0)).alias("n"), "token"))).alias("ranked"))
    asked = stored(ranked.select("item_id", "item_size", F.explode(_prefix(F.col("ranked"), least)).alias("x")).select("item_id", "item_size", "x.token"))
    n_asked = asked.count()
    in_texts = spread.join(_small(asked, n_asked), "token").where("item_size <= text_size").select("text_id", "item_id")
    most = items.agg(F.max(F.size("tokens"))).first()[0] or 0
    # Texts that are smaller than some item.
    few = texts.where(F.size("tokens") < most).select("text_id", F.size("tokens").alias("text_size"), F.explode("tokens").alias("token"))
    rare = few.join(_small(by_items, tokens), "token", "left").groupBy("text_id", "text_size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n_items", F.lit(0)).alias("n"), "token"))).alias("ranked"))
    offered = rare.select("text_id", "text_size", F.explode(_prefix(F.col("ranked"), least)).alias("x")).where("x.n > 0").select("text_id", "text_size", "x.token")
    in_items = offered.join(held, "token").where("text_size < item_size").select("text_id", "item_id")
    pairs = in_texts.unionByName(in_items).distinct()
    met = pairs.join(items.withColumnRenamed("tokens", "item_tokens"), "item_id").join(texts, "text_id")
    return met.select("text_id", "item_id", overlap(F.col("tokens"), F.col("item_tokens")).alias("overlap")).where(F.col("overlap") >= least - 1e-12)

