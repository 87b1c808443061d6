r"""Benchmark decontamination by size-partitioned MinHash containment search, with built-in functions only.

A document holds an item if at least `threshold` of the item's distinct shingles stand in it. Items are partitioned by
their number q of shingles, at powers of two. A partition up to `most` shingles has a MinHash signature of its own length,
2 * (most - ceil(threshold * most)) + 1 least hashes of an item's shingles, and asks a document for so many of them that
one which holds the item cannot have fewer: the length of the signature less the q - ceil(threshold * q) shingles that may
be missing. So no document that holds an item is lost, however long it is, and one with a few common shingles is no
candidate. Candidates have their shingles themselves compared.

Items are a stored table, whatever their number. The corpus is read once for candidates: a document's distinct shingles
meet the table of signature values, which is broadcast if it has at most BROADCAST_ROWS rows, else joined by shuffle. Hits
are counted before they are sent on. Documents are known by 128 bits of a hash of their text, so equal texts are compared
once; the few findings then meet the rows by that hash.

Defined results: words are runs of letters and digits of the lower-cased text; items of fewer than `size` words are one
shingle of all their words, looked for among the documents' shingles of that length; items without words are held by
none; null text counts as empty; repeated rows are each judged for themselves; very long texts are judged whole; an
item_id that stands in several rows is reported once, with its best containment. Other columns pass through; `leaks`
replaces one of that name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.llm.arrays import bound
from caselattice.llm.names import unused
from caselattice.llm.storage import discard, stored

SIZE, THRESHOLD = 5, 0.8
#: Signature values, of 24 bytes, that go to every executor at most.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words: Column, n: int) -> Column:
    """Hashes of the shingles of n words, from the array of the words' hashes."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def _shingles(words: Column, n: int) -> Column:
    # Not by slices: each one would copy the whole array first.
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])))


def _missing(q: Column, threshold: float) -> Column:
    """How many of q shingles may be missing."""
    return (q - F.ceil(q * F.lit(threshold) - 1e-9)).cast("int")


def signatures(items: DataFrame, item_id: str, text: str, size: int, threshold: float) -> DataFrame:
    """(item, item_id, n words in a shingle, shingles, part, signature, need) of the items that have words."""
    rows = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0).withColumn("n", F.least(F.lit(size), F.size("w")))
    # As for the documents, a shingle's hash is that of its words' hashes, by its own number of words.
    hashed = F.transform("w", lambda w: F.xxhash64(w))
    least = lambda n: lambda h: F.array_sort(F.array_distinct(_hashes(h, n)))
    by_length = lambda make: F.coalesce(*[F.when(F.col("n") == n, make(n)) for n in range(1, size + 1)])
    values = by_length(lambda n: bound(hashed, least(n)))
    q = F.size("shingles")
    most = F.pow(F.lit(2), F.col("part")).cast("int")
    made = rows.withColumns({"shingles": by_length(lambda n: _shingles(F.col("w"), n)), "values": values}).withColumn("part", F.ceil(F.log2(q)).cast("int"))
    signed = made.withColumn("signature", F.slice("values", F.lit(1), 2 * _missing(most, threshold) + 1))
    return signed.select(F.monotonically_increasing_id().alias("item"), "item_id", "n", "shingles", "part", "signature", (F.size("signature") - _missing(q, threshold)).alias("need"))


def find_leaks(df: DataFrame, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `leaks`: array of (item_id, containment) of the items that the row's text holds, by item_id."""
    none = F.expr(f"cast(array() as array<struct<item_id:{items.schema[item_id].dataType.simpleString()},containment:double>>)")
    known = stored(signatures(items, item_id, item_text, size, threshold))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # at most `size` rows
    if not lengths:
        return df.withColumn("leaks", none)
    said = F.coalesce(F.col(text), F.lit(""))
    keys = {"_t1": F.xxhash64(said), "_t2": F.xxhash64(F.lit("text"), said)}

    def own(words: Column) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        return bound(hashed, lambda h: F.array_distinct(F.flatten(F.array(*[F.coalesce(_hashes(h, n), F.expr("cast(array() as array<bigint>)")) for n in lengths]))))

    each = df.select(*[v.alias(k) for k, v in keys.items()], F.explode(bound(words_of(F.col(text)), own)).alias("h"))
    values = known.select("item", "need", F.explode("signature").alias("value"))
    small = known.agg(F.sum(F.size("signature")).alias("n")).first()["n"] <= BROADCAST_ROWS
    hits = each.join(F.broadcast(values) if small else values, F.col("h") == F.col("value"))
    # Copies of a text add up to more than its own hits: its need is met all the sooner, and what holds is compared below.
    candidates = hits.groupBy("_t1", "_t2", "item").agg(F.count("*").alias("hits"), F.first("need").alias("need")).filter("hits >= need")
    pairs = stored(candidates.select("_t1", "_t2", "item"))
    # Few documents are candidates: their keys, not the corpus, go where the other is, as long as they fit a broadcast.
    texts = df.select(*[v.alias(k) for k, v in keys.items()], F.col(text).alias("text"))
    held = stored(texts.join(pairs.select("_t1", "_t2").distinct(), ["_t1", "_t2"], "left_semi").dropDuplicates(["_t1", "_t2"]))
    near = pairs.join(known.select("item", "item_id", "n", "shingles"), "item").groupBy("_t1", "_t2").agg(F.collect_list(F.struct("item_id", "n", "shingles")).alias("near"))
    # Stored before it is filtered: a filter would be pushed below with a copy of all the comparing in it.
    found = stored(_compared(held.join(near, ["_t1", "_t2"]), lengths, threshold)).filter(F.size("leaks") > 0)
    discard(pairs, held)

    own1, own2 = unused(df, "_t1", "_t2")
    told = found.select(F.col("_t1").alias(f"{own1}_of"), F.col("_t2").alias(f"{own2}_of"), F.col("leaks").alias(f"{own1}_leaks"))
    joined = df.withColumns({own1: keys["_t1"], own2: keys["_t2"]}).join(told, (F.col(own1) == F.col(f"{own1}_of")) & (F.col(own2) == F.col(f"{own2}_of")), "left")
    return joined.withColumn("leaks", F.coalesce(f"{own1}_leaks", none)).drop(own1, own2, f"{own1}_of", f"{own2}_of", f"{own1}_leaks")


def _compared(candidates: DataFrame, lengths: list[int], threshold: float) -> DataFrame:
    """(_t1, _t2, leaks) of candidates (_t1, _t2, text, near: array of items)."""

    def held(n: int):
        def by(own: Column) -> Column:
            share = lambda x: F.size(F.array_intersect(own, x["shingles"])) / F.size(x["shingles"])
            asked = F.filter("near", lambda x: x["n"] == n)
            return F.filter(F.transform(asked, lambda x: F.struct(x["item_id"].alias("item_id"), share(x).alias("containment"))), lambda x: x["containment"] >= threshold - 1e-9)

        return by

    none = F.expr("cast(array() as array<string>)")
    def every(words: Column) -> Column:
        # A document's shingles are made once, not once an item.
        return F.flatten(F.array(*[bound(F.coalesce(_shingles(words, n), none), held(n)) for n in lengths]))

    best = lambda all_: F.transform(
        F.array_distinct(F.transform(all_, lambda x: x["item_id"])),
        lambda i: F.struct(i.alias("item_id"), F.array_max(F.transform(F.filter(all_, lambda x: x["item_id"].eqNullSafe(i)), lambda x: x["containment"])).alias("containment")),
    )
    return candidates.select("_t1", "_t2", F.array_sort(bound(bound(words_of(F.col("text")), every), best)).alias("leaks"))
