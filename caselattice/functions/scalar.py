"""Scalar expressions that the operators share; all are built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ["A", "B", "C", "D"]


def rounded(x: Column, places: int = 6) -> Column:
    """A double as the SQL side rounds it: its product with 10**places to a whole number, halves away from zero. `F.round` takes
    the shortest decimal of the double instead, which ends in a half where the product lies just below one."""
    return F.round(x * F.lit(10.0**places), 0) / F.lit(10.0**places)


def ratio(a: Column, b: Column) -> Column:
    """a/b rounded to 6 places; null over zero."""
    return rounded(F.try_divide(a.cast("double"), b.cast("double")))


def rate_or_zero(hit: Column) -> Column:
    """Share of rows where hit is true, nulls in the denominator; 0 without rows."""
    return F.coalesce(F.try_divide(F.count_if(F.coalesce(hit, F.lit(False))).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))


def valid_answer(answer: Column, extractable: Column | None = None) -> Column:
    ok = answer.isin(LABELS) if extractable is None else answer.isin(LABELS) & F.coalesce(extractable, F.lit(False))
    return F.when(ok, answer)


def signature_key(signature: Column) -> Column:
    return F.when(F.size(signature) == 0, F.lit("[]")).otherwise(F.array_join(signature, ","))


def complexity(k: Column) -> Column:
    return F.when(k == 3, "low").when(k == 4, "medium").when(k == 5, "high")


def screening_category(n_correct: Column) -> Column:
    """By the number of right answers among six runs."""
    return F.when(n_correct == 6, "stable_correct").when(n_correct == 5, "mildly_vulnerable").when(n_correct.between(2, 4), "mixed_correctness").otherwise("mostly_wrong")


def empirical_difficulty(n_correct: Column) -> Column:
    return F.when(n_correct == 6, "very_easy").when(n_correct == 5, "easy").when(n_correct.between(2, 4), "medium").when(n_correct == 1, "hard").otherwise("very_hard")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def normalized(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9]++(?:['-][A-Za-z0-9]++)*+"))


_WORD_CHAR = r"[\p{L}\p{N}_]"


def mentioned(text: Column, label: str) -> Column:
    """Whether the label stands in the text as a whole word, by any language's letters."""
    return F.regexp_like(text, F.lit(f"(?<!{_WORD_CHAR}){label}(?!{_WORD_CHAR})"))


def reasoning_diagnostics(text: Column, answer: Column) -> Column:
    """Struct of n_words, mentions_all (of the four labels) and mentions_selected; all null for a null text. A word begins with a
    word character and goes on over these, apostrophes and hyphens."""
    words = F.regexp_count(text, F.lit(f"{_WORD_CHAR}[\\p{{L}}\\p{{N}}_'-]*+")).cast("long")
    every, selected = F.lit(True), F.when(text.isNotNull(), F.lit(False))
    for label in LABELS:
        every = every & mentioned(text, label)
        selected = F.when(answer == label, mentioned(text, label)).otherwise(selected)
    return F.struct(words.alias("n_words"), every.alias("mentions_all"), selected.alias("mentions_selected"))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token sets: the share of the smaller one that is in both; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def shown(text: Column, instead: str) -> Column:
    """The text without white space at its ends, or a fixed word where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), F.lit("")), F.lit(instead))


def content_hash(text: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased text with runs of white space as one space."""
    squeezed = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.sha2(F.lower(squeezed), 256)


def cjk_count(text: Column) -> Column:
    # A text of as many bytes as characters has none: most texts need no search.
    return F.when(F.octet_length(text) == F.char_length(text), 0).otherwise(F.regexp_count(text, F.lit(r"[㐀-䶿一-鿿]")))


def draw(*parts: Column) -> Column:
    """A number below 2**32 that these values fix: the first eight hex digits of their MD5."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(1), F.lit(8)), 16, 10).cast("long")


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once: inside a lambda Spark works out a repeated expression anew at each place. It is the
    start of a fold over no element, as a transformed array would copy the result, with all that lies in it, once more."""
    return F.aggregate(F.array(), value, lambda v, _: v, use)


def lower_rank(sorted_values: Column, p: float) -> Column:
    """The value at index int(p * (n - 1)) of a sorted array; null if it is empty."""
    return F.get(sorted_values, F.floor(F.lit(p) * (F.size(sorted_values) - 1)).cast("int"))
