r"""Secret scans with built-in functions only: fixed patterns, then sliding-window entropy with an allow list.

Fixed patterns give spans of the kinds assign, access and hex, leftmost and non-overlapping within a kind. Runs of key-like
characters give candidate strings; a candidate's character class (hex, mixed case with digits, or one case with digits and
nothing else) sets the entropy that some window of WINDOW characters must reach. The window slides by one character: the
counts of the one that leaves and the one that enters change, and the sum of c*log2(c) with them. Candidates that an
allow-list pattern matches are dropped; the allow list never touches the fixed patterns. Offsets are code points, the end
exclusive.

Defined results: null text counts as empty and has no spans; an empty table gives an empty table; repeated rows are
judged each for itself; a very long text with very many hits takes time in proportion to its length, its hits and little
more (see arrays.before). Other columns pass through; the operator's own columns replace those of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.llm.arrays import before, bound

# The base patterns and the least lengths of what they must find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

WINDOW = 24
_CANDIDATE_CLASS = "[A-Za-z0-9+/_=-]"
CANDIDATE = f"{_CANDIDATE_CLASS}{{{WINDOW},}}"
#: Bits that a window must reach, by the class of its candidate.
HEX_BITS, MIXED_BITS, ONE_CASE_BITS = 3.0, 3.9, 3.9
#: Whole candidates that are no secrets: UUIDs, alphabets and digits in order, example markers, one repeated character.
ALLOW = (
    r"(?i)\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z",
    r"(?i)abcdefghijkl|0123456789ab|example|placeholder|changeme",
    r"(?s)\A(.)\1*+\z",
    r"\A[a-z]++(?:[-_/][a-z]++)*+\z",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_ANY = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}|(?<!{_CANDIDATE_CLASS}){_CANDIDATE_CLASS}{{{WINDOW}}}"""
_SPANS = "array<struct<start:int,end:int>>"
_KINDS = ("assign", "access", "hex", "entropy")
PLACEHOLDER = "[SECRET]"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of a pattern's leftmost non-overlapping matches: the text between them has their offsets."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.split(text, pattern, -1), lambda h, b: F.struct(h.alias("hit"), F.char_length(b).alias("gap"), F.char_length(h).alias("n")))

    def placed(pairs: Column) -> Column:
        ends = before(F.transform(pairs, lambda p: p["gap"] + p["n"]), lambda a, b: a + b, F.lit(0), "int")
        return F.zip_with(pairs, ends, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("end"), p["hit"].alias("hit")))

    # The text after the last match has no hit.
    return bound(F.filter(pairs, lambda p: p["hit"].isNotNull()), placed)


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, over the token's windows; null if the token is shorter than one."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(_ALPHABET), c))

    def over(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(0), F.lit(len(_ALPHABET))), lambda a: F.size(F.filter(first, lambda x: x == a)))

        def slid(counts: Column) -> Column:
            total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.get(terms, c))
            moves = F.zip_with(F.slice(codes, 1, F.size(codes) - window), F.slice(codes, window + 1, F.size(codes) - window), lambda a, b: F.struct(a.alias("leaves"), b.alias("enters")))
            begin = F.struct(counts.alias("counts"), total.alias("sum"), total.alias("least"))

            def step(acc: Column, m: Column) -> Column:
                out, into = F.get(acc["counts"], m["leaves"]), F.get(acc["counts"], m["enters"])
                moved = acc["sum"] - F.get(terms, out) + F.get(terms, out - 1) - F.get(terms, into) + F.get(terms, into + 1)
                total = F.when(m["leaves"] == m["enters"], acc["sum"]).otherwise(moved)
                counts = F.transform(acc["counts"], lambda c, i: c + (i == m["enters"]).cast("int") - (i == m["leaves"]).cast("int"))
                return F.struct(counts.alias("counts"), total.alias("sum"), F.least(acc["least"], total).alias("least"))

            return F.aggregate(moves, begin, step, lambda acc: math.log2(window) - acc["least"] / window)

        return F.element_at(F.transform(F.array(counts), slid), 1)

    return F.when(F.char_length(token) >= window, F.element_at(F.transform(F.array(codes), over), 1))


def _entropy_spans(text: Column) -> Column:
    def secret(m: Column) -> Column:
        t = m["hit"]
        hexed = F.regexp_like(t, F.lit(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")) & F.regexp_like(t, F.lit("[0-9]")) & F.regexp_like(t, F.lit("[A-Fa-f]"))
        mixed = F.regexp_like(t, F.lit("[0-9]")) & F.regexp_like(t, F.lit("[a-z]")) & F.regexp_like(t, F.lit("[A-Z]"))
        one_case = F.regexp_like(t, F.lit(r"\A(?:[0-9a-z]+|[0-9A-Z]+)\z")) & F.regexp_like(t, F.lit("[0-9].*[0-9].*[0-9].*[0-9]")) & F.regexp_like(t, F.lit("[A-Za-z]"))
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | F.regexp_like(t, F.lit(pattern))
        bits = F.when(hexed, F.lit(HEX_BITS)).when(mixed, F.lit(MIXED_BITS)).when(one_case, F.lit(ONE_CASE_BITS))
        return F.when(bits.isNull() | allowed, F.lit(False)).otherwise(window_entropy(t) >= bits)

    return F.filter(_matches(text, CANDIDATE), secret)


def _as_kind(k: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), F.lit(_KINDS[k]).alias("kind"), m["end"].alias("end"))


def find_secrets(df: DataFrame, text: str) -> DataFrame:
    """Adds `secrets`: array of (start, rank of the kind, kind, end), sorted; its kinds are assign, access, hex, entropy."""
    shape = "array<struct<start:int,rank:int,kind:string,end:int>>"
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = (
        F.filter(_matches(t, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_LEAST),
        # A run that is matched whole, whatever its length, is the same as the runs of the least length or more.
        _matches(t, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"),
        _matches(t, f"[0-9a-f]{{{HEX_LEAST},}}"),
        _entropy_spans(t),
    )
    spans = F.concat(*[F.transform(x, _as_kind(k)) for k, x in enumerate(kinds)])
    return df.withColumn("secrets", F.when(F.regexp_like(t, F.lit(_ANY)), F.array_sort(spans)).otherwise(F.expr(f"cast(array() as {shape})")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str) -> DataFrame:
    """Replaces each stretch of overlapping spans in `text` by PLACEHOLDER; needs `secrets`.

    The text is cut in an encoding of four bytes a code point, in which a piece is found without reading what is before."""
    shape = F.struct(F.col("secrets"), F.encode(F.col(text), "UTF-32").alias("code"))

    def cut(held: Column) -> Column:
        spans, code = held["secrets"], held["code"]
        piece = lambda a, b: F.decode(F.substring(code, a * 4 + 1, (b - a) * 4), "UTF-32")
        reached = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0), "int")
        # A stretch begins where a span starts at or after the end of all before it; the text before it is kept.
        heads = F.filter(F.zip_with(spans, reached, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))), lambda x: x["start"] >= x["at"])
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        rest = F.decode(F.substring(code, last * 4 + 1, F.octet_length(code)), "UTF-32")
        return F.concat(F.array_join(F.transform(heads, lambda x: F.concat(piece(x["at"], x["start"]), F.lit(PLACEHOLDER))), ""), rest)

    return df.withColumn(text, F.when(F.size("secrets") > 0, bound(shape, cut)).otherwise(F.col(text)))
