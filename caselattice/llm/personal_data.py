r"""Information-theoretic sanitisation of personal data, with built-in functions only.

Fixed patterns give the protected entities: e-mail and IP addresses, payment cards and phone numbers. How strongly a term
reveals an entity is estimated over the whole corpus: of N texts, c hold the entity, d the term, and k the term within
CONTEXT characters of the entity; so the term tells log2(N k / (c d)) of the entity's log2(N / c) bits. Where that share
reaches REMOVE the term is removed, where it reaches GENERALISE it is replaced by its class, each time at every place of a
text that has the entity and the term beside it. Every row counts, but entities and pairs in fewer than SUPPORT different
texts say nothing.

Terms are words that begin with a letter, lower-cased. Each mention gives its neighbouring words, not all words of its text,
so work grows with the mentions; counts are combined before they are shuffled. Documents meet their terms by a digest of the
text: at most BROADCAST candidate terms, and a tenth as many flagged texts, are broadcast; more are joined by shuffles, in which
only documents that hold an entity take part.

Defined results: null text counts as empty and has no spans; repeated rows have the same spans each; ties are sorted by kind,
then start; spans of different kinds may overlap, and the redaction merges them. Very long texts are read whole, in time
proportional to their length and hits. An empty table gives an empty table. Other columns pass through; the operator's own
replace those of the same names. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.llm.arrays import before, bound
from caselattice.llm.names import unused
from caselattice.llm.secret_scan import _matches, joined
from caselattice.llm.storage import stored

__all__ = ["find_personal", "joined", "sanitise"]

# The base patterns, with loops that neither recurse nor begin within a run of their own characters.
_LOCAL = "[A-Za-z0-9._%+-]"
_ADDRESS = rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_ADDRESS}"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: What a text must hold for its pattern to be tried.
_HINTS = ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){15}", r"\+[0-9][\x20().0-9-]")
#: A word, unless it is within an address.
_WORD = rf"(?<!{_LOCAL}){_ADDRESS}|\p{{L}}[\p{{L}}\p{{M}}\p{{N}}]*+"

CONTEXT = 160
SUPPORT = 3
GENERALISE, REMOVE = 0.6, 0.85
BROADCAST = 500_000
_SPANS = "array<struct<rank:int,start:int,end:int,kind:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _is_ip(hit: Column) -> Column:
    significant = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(significant, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


_HOLDS = (
    lambda hit: F.lit(True),
    _is_ip,
    lambda hit: F.char_length(_digits(hit)).between(16, 19) & _luhn(_digits(hit)),
    lambda hit: F.char_length(_digits(hit)).between(8, 15),
)
_NAMED = (F.lower, lambda hit: hit, _digits, _digits)
_PATTERNS = (EMAIL, IP, CARD, PHONE)


def _terms(text: Column) -> Column:
    hits = F.filter(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: ~F.contains(w, F.lit("@")))
    return F.array_distinct(F.transform(hits, F.lower))


def _only_if(hint: str, text: Column, value: Column, shape: str) -> Column:
    there = F.contains(text, F.lit(hint)) if hint == "@" else F.regexp_like(text, F.lit(hint))
    return F.when(there, value).otherwise(F.expr(f"cast(array() as {shape})"))


def _base_of(k: int, text: Column) -> Column:
    hits = F.filter(_matches(text, _PATTERNS[k]), lambda m: _HOLDS[k](m["hit"]))
    return F.transform(hits, lambda m: F.struct(F.lit(k).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS[k]).alias("kind")))


def _base_spans(text: Column) -> Column:
    return F.concat(*[_only_if(hint, text, _base_of(k, text), _SPANS) for k, hint in enumerate(_HINTS)])


def _mentions_of(k: int, text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(_PATTERNS[k]), F.lit(0))

    def near(pieces: Column) -> Column:
        # A word that the edge of the context may cut is left out.
        left = lambda x: F.when(F.char_length(x) > CONTEXT, F.regexp_replace(F.right(x, F.lit(CONTEXT)), r"\A[\p{L}\p{M}\p{N}]++", "")).otherwise(x)
        right = lambda x: F.when(F.char_length(x) > CONTEXT, F.regexp_replace(F.left(x, F.lit(CONTEXT)), r"[\p{L}\p{M}\p{N}]++\z", "")).otherwise(x)
        sides = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: F.concat_ws(" | ", left(a), right(b)))
        return F.zip_with(hits, sides, lambda h, s: F.struct(h.alias("hit"), s.alias("near")))

    mentions = F.filter(bound(F.split(text, _PATTERNS[k], -1), near), lambda m: _HOLDS[k](m["hit"]))
    return F.transform(mentions, lambda m: F.struct(F.md5(F.concat(F.lit(f"{KINDS[k]}:"), _NAMED[k](m["hit"]))).alias("entity"), _terms(m["near"]).alias("terms")))


def _mentions(text: Column) -> Column:
    """Array of (entity, terms): each protected entity of a text with the words near it."""
    return F.concat(*[_only_if(hint, text, _mentions_of(k, text), "array<struct<entity:string,terms:array<string>>>") for k, hint in enumerate(_HINTS)])


def _pairs(mentions: Column) -> Column:
    """The entities of a text, and each with each word near it, as distinct strings: a digest, a space, a word or nothing."""
    spread = F.transform(mentions, lambda m: F.transform(F.array_append(m["terms"], F.lit("")), lambda t: F.concat(m["entity"], F.lit(" "), t)))
    return F.array_distinct(F.flatten(spread))


def disclosures(documents: DataFrame, text: str) -> DataFrame:
    """(digest, terms): for the MD5 of each text with terms to treat, a map from the term to the kind of its spans."""
    texts = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = texts.select(F.md5("text").alias("digest"), F.explode(_pairs(_mentions(F.col("text")))).alias("pair"))
    told = held.groupBy("digest", "pair").agg(F.count("*").alias("n"))
    mentions = stored(told.select("digest", F.left("pair", F.lit(32)).alias("entity"), F.expr("substr(pair, 34)").alias("term"), "n"))
    known = mentions.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    counted = known.where("term <> ''").select("entity", "term", F.col("n").alias("k")).join(known.where("term = ''").select("entity", F.col("n").alias("c")), "entity")
    candidates = stored(counted)
    asked = candidates.select("term").distinct()
    words = texts.select(F.explode(_terms(F.col("text"))).alias("term"))
    # Few terms are sifted before they are counted, many after.
    few = asked.count() <= BROADCAST
    holders = (words.join(F.broadcast(asked), "term", "left_semi") if few else words).groupBy("term").agg(F.count("*").alias("d"))
    n_rows = texts.where("text <> ''").count()
    bits = lambda x: F.log2(x.cast("double"))
    share = bits(F.lit(n_rows) * F.col("k") / (F.col("c") * F.col("d"))) / bits(F.lit(n_rows) / F.col("c"))
    revealing = candidates.where(F.col("c") < n_rows).join(holders, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)
    strongest = mentions.join(revealing, ["entity", "term"]).groupBy("digest", "term").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= REMOVE, KINDS[5]).otherwise(KINDS[4])
    return stored(strongest.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", kind))).alias("terms")))


def find_personal(df: DataFrame, text: str) -> DataFrame:
    """Adds `personal`: array of (rank of the kind, start, end, kind), sorted; kinds as in KINDS."""
    flagged = disclosures(df, text)
    digest, terms, base = unused(df, "_digest", "_terms", "_base")
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumn(base, _base_spans(t))
    told = flagged.select(F.col("digest").alias(digest), F.col("terms").alias(terms))
    n = told.count()
    if n == 0:
        return found.withColumn("personal", F.array_sort(base)).drop(base)
    # Only texts with an entity can have terms to treat.
    held, other = found.where(F.size(base) > 0), found.where(F.size(base) == 0).withColumn(terms, F.lit(None).cast(told.schema[terms].dataType))
    if n <= BROADCAST // 10:
        met = found.withColumn(digest, F.md5(t)).join(F.broadcast(told), digest, "left").drop(digest)
    else:
        met = held.withColumn(digest, F.md5(t)).join(told, digest, "left").drop(digest).unionByName(other)

    def treated(m: Column) -> Column:
        kind = F.element_at(F.col(terms), F.lower(m["hit"]))
        return F.struct(F.when(kind == KINDS[4], 4).otherwise(5).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), kind.alias("kind"))

    more = F.filter(F.transform(_matches(t, _WORD), treated), lambda s: s["kind"].isNotNull())
    spans = F.when(F.col(terms).isNotNull(), F.concat(F.col(base), more)).otherwise(F.col(base))
    return met.withColumn("personal", F.array_sort(spans)).drop(base, terms)


def sanitise(df: DataFrame, text: str) -> DataFrame:
    """Replaces each stretch of overlapping spans in `text` by what its first span asks for; needs `personal`: an entity becomes its
    kind, a generalised term its class (NAME where it begins with a capital, else WORD), a removed one nothing."""
    ordered = F.array_sort(F.transform("personal", lambda s: F.struct(s["start"], s["rank"], s["end"])))
    shape = F.struct(ordered.alias("spans"), F.encode(F.col(text), "UTF-32").alias("code"))

    def cut(held: Column) -> Column:
        spans, code = held["spans"], held["code"]
        piece = lambda a, b: F.decode(F.substring(code, a * 4 + 1, (b - a) * 4), "UTF-32")
        reached = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0), "int")
        heads = F.filter(F.zip_with(spans, reached, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))), lambda x: x["start"] >= x["at"])
        general = lambda x: F.when(F.regexp_like(piece(x["start"], x["end"]), F.lit(r"\A\p{Lu}")), "[NAME]").otherwise("[WORD]")
        instead = lambda x: F.when(x["rank"] == 5, "").when(x["rank"] == 4, general(x)).otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.lit(list(KINDS)), x["rank"] + 1)), F.lit("]")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        rest = F.decode(F.substring(code, last * 4 + 1, F.octet_length(code)), "UTF-32")
        return F.concat(F.array_join(F.transform(heads, lambda x: F.concat(piece(x["at"], x["start"]), instead(x))), ""), rest)

    return df.withColumn(text, F.when(F.size("personal") > 0, bound(shape, cut)).otherwise(F.col(text)))
