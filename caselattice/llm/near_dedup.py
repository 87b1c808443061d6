"""Near-duplicates by Order MinHash and banded alignment.

A document is its sequence of words. Its k-mers (SHINGLE words, next to each other or, for half the functions, spaced) are
labelled by their occurrence; for each of N_SKETCHES hash functions the LENGTH labelled k-mers of least hash are taken and kept in the order of the text, and their hash is
one sketch value. Two documents that share a value are candidates, and near-duplicates if aligning their words takes edits of
at most 1 - SIMILARITY of the longer one's words. Classes are the connected components.

Texts with the same words are one node from the start, so groups of copies cost one row each. In the buckets of a value,
first every member is aligned with one other: the bucket's least node or, in a bucket of more than STAR, the least of its
part, and the parts' least with the bucket's. Where all members are then one component, nothing is left to be found. In
other buckets the pairs across components follow, less those whose lengths or word counts rule a link out: in buckets of
up to LARGE, one part, inside a task, each pair in the least of the buckets that it shares and no more once its components have met;
in larger ones only pairs that share one of their rarest words, of which near texts must share one (see _rare_pairs).
So no link between candidates that would change a class is lost, and no group is paired with itself for nothing.

Defined results: documents of fewer words than a k-mer are one k-mer; those without words (null and empty texts among
them) are copies of each other. Rows without an id are named by a hash of their text, beyond all ids. Rows that share an
id and differ in text are documents of their own, each in its own class; two classes may then have one name. Very long
texts are sketched whole, in pieces of bounded memory. Other columns are not carried: the result is one row per input
row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.llm import alignment
from caselattice.llm.components import components, with_least
from caselattice.llm.names import unused
from caselattice.llm.storage import discard, stored
from caselattice.llm.text_kernel import as_bytes, mix, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
N_SKETCHES, LENGTH = 96, 2
#: Members of a bucket's part, which are aligned with the part's least.
STAR = 512
#: One bucket in so many is aligned before the others.
EARLY = 12
#: Members of a bucket that are paired in a task, one part; those of larger ones meet by their rarest words.
LARGE = STAR
#: Members with a rare word, and words in a bucket, that one task pairs with as many others.
BLOCK, WEIGHT = 2048, 1 << 22
_BINS = 256
#: Bins of word counts where large buckets are paired.
_WIDE = 1024
_STEP = 256


def fingerprint(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sequence of words."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        first = mix(words + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        second = mix((words ^ np.uint64(0x5851F42D4C957F2D)) * (place + place + np.uint64(1))).sum(dtype=np.uint64)
    return tuple(int(x) for x in np.array([first, second], np.uint64).view(np.int64))


def spaced(k: int) -> tuple[int, ...]:
    """Places of k words with a gap before and after the middle one: 0, 1, 3, 5, 6 for five."""
    return tuple(i + (i >= k // 2) + (i > k // 2) for i in range(k))


def labelled_kmers(words: np.ndarray, k: int, places: tuple[int, ...] | None = None) -> np.ndarray:
    """A hash of each k-mer together with the number of its occurrence, in text order. The k words stand at `places`,
    counted from the first one, or next to each other."""
    places = places or tuple(range(k))
    n = len(words) - places[-1]
    with np.errstate(over="ignore"):
        if n < 1:
            kmers = np.array([mix(words * np.arange(3, 2 * len(words) + 3, 2, dtype=np.uint64)).sum(dtype=np.uint64)], np.uint64)
        else:
            kmers = words[:n].copy()
            for i in places[1:]:
                kmers = kmers * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
            kmers = mix(kmers)
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if new.all():
            return kmers
        number = np.arange(len(ranked)) - np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
        labelled = np.empty_like(kmers)
        labelled[order] = np.where(number > 0, mix(ranked + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), ranked)
        return labelled


def order_minhash(words: np.ndarray, k: int, sketches: int, length: int, places: tuple[int, ...] | None = None, start: int = 1) -> np.ndarray:
    """The sketch values of a sequence of words, as int64; functions are numbered from `start`."""
    kmers = labelled_kmers(words, k, places)
    odd = mix(np.arange(start, start + sketches, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    rows = np.arange(sketches)
    least: np.ndarray | None = None
    with np.errstate(over="ignore"):
        # Blocks bound the memory; of each block only the least places of every function go on.
        for at in range(0, len(kmers), 1 << 14):
            part = kmers[at : at + (1 << 14)]
            hashed = part[None, :] * odd[:, None]
            picked = []
            for _ in range(min(length, len(part))):
                place = hashed.argmin(axis=1)
                picked.append(place + at)
                hashed[rows, place] = np.uint64(0xFFFFFFFFFFFFFFFF)
            now = np.stack(picked, 1)
            if least is not None:
                both = np.concatenate([least, now], 1)
                keep = np.argsort(kmers[both] * odd[:, None], axis=1, kind="stable")[:, :length]
                now = np.take_along_axis(both, keep, 1)
            least = now
        least = np.sort(least, axis=1)
        value = mix(odd)
        for c in range(least.shape[1]):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + kmers[least[:, c]])
    return value.view(np.int64)


def sketch_of(words: np.ndarray, k: int, sketches: int, length: int) -> np.ndarray:
    """Half the functions over neighbouring words, half over spaced ones: words replaced at even distances of k or k + 1
    break every k-mer of neighbours, but not all spaced ones; inserted words break fewer of the former."""
    half = sketches // 2
    return np.concatenate([order_minhash(words, k, sketches - half, length), order_minhash(words, k, half, length, spaced(k), sketches - half + 1)])


def _bag(words: np.ndarray) -> bytes:
    """Counts of words by hash, then of pairs of neighbouring words, for bounds on the edits between two texts: one edit
    changes the first by two at most and the second by four."""
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    bags = [np.bincount((x >> np.uint64(40)).astype(np.int64) % _BINS, minlength=_BINS) for x in (words, pairs)]
    return np.minimum(np.concatenate(bags), 255).astype(np.uint8).tobytes()


#: Ids from here up stand for rows without one.
_NAMELESS = 1 << 61


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _id(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_NAMELESS) + F.abs(F.xxhash64(_text(text)) % (1 << 60)))


def _mark(text: str) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(F.lit("mark"), _text(text))


def _map_words(df: DataFrame, column: str, schema: str, read: Callable, make: Callable) -> DataFrame:
    """A row of make(words) after the columns other than `column`, from which read makes words, for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(column)
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                made = [make(read(x)) for x in as_bytes(part.column(where))]
                fixed = [part.column(i) for i in range(part.num_columns) if i != where]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True))], names=names)

    empty = df.sparkSession.createDataFrame([], schema)
    names, kinds = empty.columns, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[t] for _, t in empty.dtypes[len(df.columns) - 1 :]]
    return df.mapInArrow(run, schema)


def _allowed(a: int, b: int, similarity: float) -> int:
    """The edits that texts of a and b words may differ by."""
    return round((1 - similarity) * 1_000_000) * max(int(a), int(b)) // 1_000_000


def near_enough(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether aligning two sequences of words takes few enough edits; lengths and counts of words are asked first."""
    most = _allowed(len(a), len(b), similarity)
    if abs(len(a) - len(b)) > most or np.abs(np.bincount(a & (_BINS - 1), minlength=_BINS) - np.bincount(b & (_BINS - 1), minlength=_BINS)).sum() > 2 * most:
        return False
    return alignment.distance_within(a, b, most) is not None


def verify(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose alignment is near enough; words has (node, words)."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [near_enough(*(np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (2, 3)), similarity) for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """members dealt to blocks by a hash of the node, once for each block that theirs is paired with (low, high)."""
    dealt = members.withColumn("_blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("_blocks", "other")


def _bags(rows: pa.Table) -> tuple:
    """(counts, edits' weight) of words in few bins, in many, and of pairs of neighbouring words."""
    held = np.frombuffer(b"".join(rows.column("bag").to_pylist()), np.uint8).reshape(rows.num_rows, -1).astype(np.int16)
    single, double = held[:, :_BINS], held[:, _BINS:]
    return (single.reshape(rows.num_rows, -1, 8).sum(2, dtype=np.int16), 2), (single, 2), (double, 4)


def _wide_bags(rows: pa.Table) -> tuple:
    """The same of counts by _labelled_words, for few bins and all."""
    packed = np.frombuffer(b"".join(rows.column("bag").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    single = np.concatenate([packed & 15, packed >> 4], 1).astype(np.int16)
    return (single.reshape(rows.num_rows, -1, 32).sum(2, dtype=np.int16), 2), (single, 2)


def _partners(i: int, n: np.ndarray, may: np.ndarray, bags: tuple, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows after i that lengths (n ascends) and bags leave as its partners, and how far off the last bag has them.

    An edit that also makes up for a difference in length changes a bag by one less: of two texts with k edits between them,
    the longer one has at most k words (2 k pairs of words) that the other has not."""
    # Sorted by length: the longer partner may have no more words than this.
    j = np.arange(i + 1, np.searchsorted(n, n[i] / similarity + 1e-9, "right"))
    j = j[may[j]]
    far = np.zeros(len(j), np.int64)
    for held, each in bags:
        far = np.abs(held[j] - held[i]).sum(1)
        near = far <= each * (round((1 - similarity) * 1_000_000) * n[j].astype(np.int64) // 1_000_000) - (n[j] - n[i])
        j, far = j[near], far[near]
    return j, far


def _in_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (a, b) that run makes of each group of rows with equal keys. A task sorts its rows and works off run after run
    of a group, which is cheaper than a data frame a group where most are of a few rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for x in values:
                new[1:] |= x[1:] != x[:-1]
            new[0] = last is not None and last != tuple(x[0] for x in values)
            last = tuple(x[-1] for x in values)
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            found = []
            for k, (at, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if k and held:
                    found.append(run(pa.Table.from_batches(held)))
                    held = []
                if end > at:
                    held.append(batch.slice(at, end - at))
            yield from told(found)
        if held:
            yield from told([run(pa.Table.from_batches(held))])

    def told(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found]).astype(np.int64)) for i in (0, 1)], names=["a", "b"])

    return df.repartition(*keys).sortWithinPartitions(*keys, "n", "node").mapInArrow(work, "a long, b long")


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """members (key, size, least, node, comp, n, bag, keys, words, weight): links (a, b) of nodes in a bucket that unite
    components. Pairs with the least node of a bucket of up to STAR have been aligned before and are left out."""
    dealt = _dealt(members, F.greatest(F.lit(1), F.ceil(F.col("weight") / WEIGHT)))

    def pair(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n, comp, nodes, own = (rows.column(c).to_numpy() for c in ("n", "comp", "node", "own"))
        key, size, least, low, high = (rows.column(c)[0].as_py() for c in ("key", "size", "least", "low", "high"))
        words, bags = [np.frombuffer(x, np.uint32) for x in rows.column("words").to_pylist()], _bags(rows)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        done = (nodes == least) & (size <= STAR)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        out = []
        for i in range(len(n)):
            if done[i]:
                continue
            j, far = _partners(i, n, (comp != comp[i]) & ((low == high) | (own != own[i])) & ~done, bags, similarity)
            if not len(j):
                continue
            # A sketch value stands at its function's place: the least common one says whose pair this is.
            same = np.where(keys[j] == keys[i], keys[j], np.iinfo(np.int64).max).min(1) == key
            for k in j[same][np.argsort(far[same], kind="stable")].tolist():
                a, b = find(int(comp[i])), find(int(comp[k]))
                if a != b and alignment.distance_within(words[i], words[k], _allowed(n[i], n[k], similarity)) is not None:
                    root[max(a, b)] = min(a, b)
                    out.append((nodes[i], nodes[k]))
        return tuple(np.array(out, np.int64).reshape(-1, 2).T)

    return _in_groups(dealt, ["key", "low", "high"], pair)


def _labelled_words(words: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Each word together with the number of its occurrence, and counts of words in many bins, up to 15 and two to a byte."""
    counts = np.minimum(np.bincount(words & (_WIDE - 1), minlength=_WIDE), 15).astype(np.uint8)
    return labelled_kmers(words.astype(np.uint64), 1).view(np.int64), (counts[: _WIDE // 2] | counts[_WIDE // 2 :] << 4).tobytes()


def _rare_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """members (node, comp, n, words) of large buckets: pairs (a, b) across components that may be near.

    Of a text of n words a near one has all but allowed(n) at least. With both texts' words in one order, those two then
    share one of the first allowed(n) + 1. In the order of how many members have a word, these are its rarest, so members
    meet in small groups. Words of more than BLOCK members are not counted but come last, by hash; where texts have little
    else, their groups are dealt to blocks of BLOCK. Words are counted in more bins than elsewhere, as each pair left is a row
    that is joined with both texts. Members of all large buckets are one set: a pair that no bucket
    holds but that is near is a link all the same."""
    texts = stored(_map_words(members.select("node", "comp", "n", "words"), "words", "node long, comp long, n int, tokens array<bigint>, bag binary", lambda x: np.frombuffer(x, np.uint32), _labelled_words))
    each = texts.select("node", F.explode("tokens").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("c")).filter(F.col("c") <= BLOCK)
    rare = each.join(counts, "w").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("rare"))
    none = F.expr("cast(array() as array<struct<c:bigint,w:bigint>>)")
    ranked = texts.join(rare, "node", "left").withColumn("rare", F.coalesce("rare", none))
    common = F.transform(F.array_sort(F.array_except("tokens", F.transform("rare", lambda x: x["w"]))), lambda w: F.struct(F.lit(BLOCK + 1).cast("long").alias("c"), w.alias("w")))
    allowed = F.floor(F.lit(round((1 - similarity) * 1_000_000)) * F.col("n") / 1_000_000).cast("int")
    first = F.filter(F.slice(F.concat("rare", common), F.lit(1), allowed + 1), lambda x: x["c"] > 1)
    # Lengths and bags ride along: as equal values in a row of rows they take little room.
    met = stored(ranked.select("node", "comp", "n", "bag", F.explode(F.transform(first, lambda x: x["w"])).alias("w")))
    # Groups of one component have no pair across.
    groups = met.groupBy("w").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("w", "size")
    dealt = _dealt(met.join(groups, "w"), F.ceil(F.col("size") / BLOCK))

    def pair(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n, comp, nodes, own = (rows.column(c).to_numpy() for c in ("n", "comp", "node", "own"))
        low, high = (rows.column(c)[0].as_py() for c in ("low", "high"))
        bags = _wide_bags(rows)
        found = [(i, _partners(i, n, (comp != comp[i]) & ((low == high) | (own != own[i])), bags, similarity)[0]) for i in range(len(n))]
        left, right = np.concatenate([np.full(len(j), nodes[i]) for i, j in found]), np.concatenate([nodes[j] for _, j in found])
        return np.minimum(left, right), np.maximum(left, right)

    return _in_groups(dealt, ["w", "low", "high"], pair).distinct()


def _stars(members: DataFrame) -> DataFrame:
    """The pairs (a, b) that are aligned first: each member with the least of its bucket or of its part of it."""
    small = members.filter(F.col("size") <= STAR).select(F.col("least").alias("a"), F.col("node").alias("b"))
    parts = members.filter(F.col("size") > STAR).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / STAR)))
    centres = parts.groupBy("key", "part").agg(F.min("node").alias("a"), F.min("least").alias("top"))
    spokes = parts.join(centres.drop("top"), ["key", "part"]).select("a", F.col("node").alias("b"))
    return small.unionByName(spokes).unionByName(centres.select(F.col("top").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, sketches: int = N_SKETCHES, length: int = LENGTH) -> DataFrame:
    """One row per row of df: id, mark (a hash of the text), and group_id and group_mark, those of its class's first row
    by id and mark."""
    texts = df.select(_id(doc_id, text).alias("id"), _mark(text).alias("mark"), F.col(text).alias("text"))

    def sketch(words: np.ndarray) -> tuple:
        return (*fingerprint(words), len(words), sketch_of(words, shingle, sketches, length))

    def body(words: np.ndarray) -> tuple:
        return _bag(words), words.astype(np.uint32).tobytes()

    made = stored(_map_words(texts, "text", "id long, mark long, f1 long, f2 long, n int, keys array<bigint>", word_hashes, sketch))
    # Nodes are numbered by the rows of a stored table, so that they stay the same whoever reads them.
    nodes = stored(made.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min_by("mark", "id").alias("mark")).withColumn("node", F.monotonically_increasing_id()))
    first = nodes.select("f1", "f2", "node", F.col("id").alias("own_id"), F.col("mark").alias("own_mark"))
    owners = stored(made.select("id", "mark", "f1", "f2").join(first, ["f1", "f2"]).drop("f1", "f2"))

    # From here on each set of copies is the one row of its node.
    sketched = stored(made.dropDuplicates(["id", "mark", "f1", "f2"]).join(nodes, ["id", "mark", "f1", "f2"]).select("node", "n", "keys"))
    discard(made)
    keyed = sketched.select("node", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter("size > 1")
    members = stored(keyed.join(buckets, "key"))

    wanted = members.select("node").distinct().join(nodes.select("node", "id", "mark"), "node")
    held = texts.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark", "node"]).select("node", "text")
    words = stored(_map_words(held, "text", "node long, bag binary, words binary", word_hashes, body).join(sketched, "node"))
    # Most of a group of near copies meets in a few of its buckets: the others give only pairs of what is then still apart.
    some = F.pmod(F.col("key"), F.lit(EARLY)) == 0
    near = stored(verify(_stars(members.where(some)), words, similarity))
    early = stored(components(near))
    apart = lambda df, c: df.join(early.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    left = apart(apart(_stars(members.where(~some)), "a"), "b").where("a_root != b_root").select("a", "b")
    further = stored(verify(left, words, similarity))
    roots = stored(components(early.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(further)))
    placed = members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    # Only pairs without the least of a small bucket are left to be aligned.
    mixed = placed.filter((F.col("size") > STAR) | (F.col("node") != F.col("least"))).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    open_members = stored(placed.join(mixed, "key", "left_semi"))
    discard(members)
    small, large = open_members.filter(F.col("size") <= LARGE), open_members.filter(F.col("size") > LARGE)
    # A window over a bucket of at most LARGE.
    weighed = small.withColumn("weight", F.sum("n").over(W.partitionBy("key")))
    more = stored(_across(weighed.join(words.drop("n"), "node"), similarity))
    late = stored(verify(_rare_pairs(large.select("node", "comp").distinct().join(words.drop("keys"), "node"), similarity), words, similarity))
    discard(sketched, open_members, words)

    # Later links unite whole components: those few are the nodes of a graph of their own.
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    links = more.unionByName(late).join(root("a"), "a", "left").join(root("b"), "b", "left")
    merged = components(links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    # A node that is in no earlier component is its own.
    alone = merged.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    moved = merged.select(F.col("node").alias("root"), F.col("root").alias("new"))
    final = stored(roots.unionByName(alone).join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
    named = with_least(nodes.select("node", "id", "mark").join(final, "node"), "root", "node", F.struct("id", "mark"), "first").select("node", "first")
    return owners.join(named, "node", "left").select("id", "mark", F.coalesce("first.id", "own_id").alias("group_id"), F.coalesce("first.mark", "own_mark").alias("group_mark"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, group_id, kept): group_id is the class's least id, kept marks its row. A null doc_id stays null, as does
    the name of a class without ids."""
    found = near_duplicates(df, doc_id, text, **settings)
    real = lambda c: F.when(F.col(c) < _NAMELESS, F.col(c))
    kept = (F.col("id") == F.col("group_id")) & (F.col("mark") == F.col("group_mark"))
    return found.select(real("id").alias("doc_id"), real("group_id").alias("group_id"), kept.alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of df of which one stays from each class; of repeated rows one."""
    found = near_duplicates(df, doc_id, text, **settings)
    own, own_mark, one, one_mark = unused(df, "_id", "_mark", "_kept", "_kept_mark")
    kept = found.select(F.col("group_id").alias(one), F.col("group_mark").alias(one_mark)).distinct()
    marked = df.withColumns({own: _id(doc_id, text), own_mark: _mark(text)})
    return marked.join(kept, (F.col(own) == F.col(one)) & (F.col(own_mark) == F.col(one_mark)), "left_semi").dropDuplicates([own, own_mark]).drop(own, own_mark)
