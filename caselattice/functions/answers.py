"""Answers out of raw responses, as column expressions: three contracts that differ in what they accept.

A response is first read by Spark's own JSON parser, with an end mark behind it so that trailing text is refused. What that
parser refuses and a brace stands in (prose around objects, repeated keys, NaN) goes to one Arrow function, which finds
balanced objects and reads them; all other responses reach it as nulls and are not looked at."""

from __future__ import annotations

import json
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from caselattice.functions.scalar import bound

# Kinds of mention, claims and fields in which an answer may stand, and the names and texts of the outcomes.
_MENTIONS = (r"(?iU)\bANSWER\s*[:：-]\s*([ABCD])\b", r"(?iU)\bSELECTED\s+ANSWER\s*[:：-]\s*([ABCD])\b", r"(?iU)\bOPTION\s+([ABCD])\b", r"(?iU)\bCANDIDATE\s+([ABCD])\b")
_CLAIMS = (
    r"(?imdU)^\s*(?:FINAL\s+ANSWER|ANSWER|SELECTED\s+ANSWER)\s*[:=\-]\s*(?:OPTION\s+|CANDIDATE\s+)?([ABCD])\b",
    r"(?imdU)^\s*THE\s+FINAL\s+ANSWER\s+IS\s+(?:OPTION\s+|CANDIDATE\s+)?([ABCD])\b",
)
_NAME_CLAIM = r"(?imdU)^\s*(?:FINAL\s+ANSWER|ANSWER|SELECTED\s+ANSWER)\s*[:=\-]\s*"
_FIELD = r'(?iU)"answer"\s*:\s*"([ABCD])"'
NO_OBJECT, NO_DECODE, NOT_OBJECT = "No JSON object found", "JSON decode error", "Parsed JSON is not an object"
BAD_ANSWER, NO_CONFIDENCE, OUT_OF_RANGE = "Answer is not one of A/B/C/D", "Confidence is missing or not numeric", "Confidence is outside [0, 1]"
BAD_FIELD, NO_STRICT, CONFLICT = "JSON object is missing or has an invalid required field", "Strict JSON does not contain an unambiguous valid answer", "Conflicting explicit answers were found"
RECOVERED, NOTHING = "Answer recovered from noncompliant output", "No unambiguous final answer found"
NAME_RECOVERED, OTHER_FORM = "Candidate name recovered from noncompliant output", "Answer used a non-protocol representation"

_END = "<end of the response>"
_TEXTS = "cast(array() as array<string>)"


@cache
def _salvager():
    # Made inside a function, it travels to the executors by value.
    token = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S)

    def objects(text: str) -> list[str]:
        """The outermost balanced objects; braces inside strings do not count."""
        found, opened = [], []
        for m in token.finditer(text):
            if m[0] == "{":
                opened.append(m.start())
            elif m[0] == "}" and opened:
                start = opened.pop()
                if not opened:
                    found.append(text[start : m.end()])
        return found

    def first_object(text: str) -> str | None:
        """The object that the first brace opens, whatever quotes stand before it."""
        return next(iter(objects(text[text.index("{") :])), None) if "{" in text else None

    def read(text: str | None) -> str | None:
        """Plain JSON of what Python reads: the last of repeated keys, NaN and infinities as texts."""
        try:
            return None if text is None else json.dumps(json.loads(text, parse_constant=str))
        except ValueError:
            return None

    @F.pandas_udf("struct<whole:string,first:string,found:boolean,objects:array<string>>")
    def salvage(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for text in raw:
            if text is None:
                rows.append((None, None, False, None))
                continue
            first = first_object(text)
            rows.append((read(text.strip()), read(first), first is not None, [x for x in map(read, objects(text)) if x is not None]))
        return pd.DataFrame(rows, columns=["whole", "first", "found", "objects"])

    return salvage


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def whole_json(raw: Column) -> Column:
    """The response as a variant if it is one JSON value and nothing else, else null."""
    one = F.try_parse_json(F.concat(F.lit("["), strip(raw), F.lit(f',"{_END}"]')))
    # A response that holds the mark itself is not read here.
    alone = (F.try_variant_get(one, "$[1]", "string") == _END) & F.try_variant_get(one, "$[2]", "variant").isNull() & ~F.contains(raw, F.lit(_END))
    return F.when(alone, F.try_variant_get(one, "$[0]", "variant"))


def salvage(raw: Column) -> Column:
    """Struct of whole, first, found and objects: JSON texts in what whole_json does not read as an object."""
    return _salvager()(F.when(~_is_object(whole_json(raw)) & F.contains(raw, F.lit("{")), raw))


def strict_json(raw: Column, salvaged: Column) -> Column:
    """The whole response as a variant, read by either parser."""
    return F.coalesce(whole_json(raw), F.try_parse_json(salvaged["whole"]))


def json_objects(raw: Column) -> Column:
    """The outermost balanced objects of a text that is not JSON itself, in order, as far as they can be read."""
    return F.coalesce(salvage(raw)["objects"], F.expr(_TEXTS))


def _or_null(found: Column) -> Column:
    return bound(found, lambda f: F.when(f != "", F.upper(f)))


def loose_label(text: Column) -> Column:
    """A label with an optional prefix, space and dot."""
    return _or_null(F.regexp_extract(F.upper(strip(text)), r"(?U)\A(?:OPTION|CANDIDATE)?\s*([ABCD])\.?\z", 1))


def strict_label(text: Column) -> Column:
    """A bare label, or one after a prefix and white space, then with an optional dot."""
    return bound(F.upper(strip(text)), lambda t: F.coalesce(F.when(t.isin("A", "B", "C", "D"), t), _or_null(F.regexp_extract(t, r"(?U)\A(?:OPTION|CANDIDATE)\s+([ABCD])\.?\z", 1))))


def bare_label(raw: Column) -> Column:
    return bound(F.upper(strip(raw)), lambda bare: F.when(bare.isin("A", "B", "C", "D"), bare))


def mentioned_label(raw: Column) -> Column:
    """The first of four kinds of mention that the text holds."""
    return F.coalesce(bare_label(raw), *[_or_null(F.regexp_extract(raw, p, 1)) for p in _MENTIONS])


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def _text(value: Column, path: str) -> Column:
    """The text at a path, null for values of other types."""
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def parse_screening(raw: Column, salvaged: Column | None = None, strict: Column | None = None) -> Column:
    """Struct of answer, confidence, parse_success, strict_json_success, fallback_parse_success and parse_error: strict or
    embedded JSON; where that gives no answer, a mention, which never counts as success.

    salvaged: salvage(raw), and strict: strict_json(raw, salvaged), where the caller has them as columns."""
    salvaged = salvage(raw) if salvaged is None else salvaged
    strict = strict_json(raw, salvaged) if strict is None else strict
    given = F.struct(raw.alias("raw"), strict.alias("strict"), F.coalesce(strict, F.try_parse_json(salvaged["first"])).alias("value"), salvaged["found"].alias("found"))
    return bound(given, lambda g: _screened(g["raw"], g["strict"], g["value"], g["found"]))


def _screened(raw: Column, strict: Column, value: Column, found: Column) -> Column:
    answer = loose_label(F.try_variant_get(value, "$.answer", "string"))
    sure = F.when(_kind(value, "$.confidence") == "BOOLEAN", F.try_variant_get(value, "$.confidence", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$.confidence", "string").try_cast("double"))
    errors = F.array_compact(F.array(F.when(answer.isNull(), BAD_ANSWER), F.when(sure.isNull(), NO_CONFIDENCE).when(~sure.between(0, 1), OUT_OF_RANGE)))
    parsed = _is_object(value) & (F.size(errors) == 0)
    unread = F.when(F.coalesce(found, F.lit(False)), NO_DECODE).otherwise(NO_OBJECT)
    error = F.when(value.isNull(), unread).when(~_is_object(value), NOT_OBJECT).when(F.size(errors) > 0, F.array_join(errors, "; "))
    return F.struct(
        F.coalesce(F.when(_is_object(value), answer), mentioned_label(raw)).alias("answer"),
        F.when(_is_object(value), sure).alias("confidence"),
        parsed.alias("parse_success"),
        (parsed & strict.isNotNull()).alias("strict_json_success"),
        (parsed & strict.isNull()).alias("fallback_parse_success"),
        error.alias("parse_error"),
    )


def _payload(value: Column) -> Column:
    """Struct of answer, reasoning, confidence and compliant of an object."""
    number = F.when(_kind(value, "$.confidence") != "BOOLEAN", F.try_variant_get(value, "$.confidence", "string").try_cast("double"))
    sure = bound(number, lambda n: F.when(n.between(0, 1), n))
    read = F.struct(strict_label(_text(value, "$.answer")).alias("answer"), _text(value, "$.reasoning").alias("reasoning"), sure.alias("confidence"))
    whole = lambda p: p["answer"].isNotNull() & p["reasoning"].isNotNull() & p["confidence"].isNotNull()
    return bound(read, lambda p: F.struct(p["answer"].alias("answer"), F.coalesce(p["reasoning"], F.lit("")).alias("reasoning"), p["confidence"].alias("confidence"), whole(p).alias("compliant")))


def parse_calibration(raw: Column, salvaged: Column | None = None, strict: Column | None = None) -> Column:
    """Struct of answer, source, candidates, compliant, extractable, fallback_used, ambiguous, strict_syntax, reasoning,
    confidence and parse_error: a strict answer stands; else all claims must agree.

    salvaged: salvage(raw), and strict: strict_json(raw, salvaged), where the caller has them as columns."""
    salvaged = salvage(raw) if salvaged is None else salvaged
    strict = strict_json(raw, salvaged) if strict is None else strict
    given = F.struct(raw.alias("raw"), strict.alias("strict"), salvaged["objects"].alias("objects"))
    # Each step is worked out once a response, however often the next ones ask for it.
    return bound(given, lambda g: bound(_claims_of(g["raw"], g["strict"], g["objects"]), lambda c: _agreed(g["strict"], c)))


def _claims_of(raw: Column, strict: Column, objects: Column) -> Column:
    """Struct of told (of the strict answer), payloads, claims, bare and fields."""
    # An object alone is the response, an array may hold objects, and what is salvaged has them listed.
    listed = F.coalesce(objects, F.expr(_TEXTS))

    def read(o: Column) -> Column:
        return bound(bound(F.try_parse_json(o), _payload), lambda p: F.struct(*[p[x].alias(x) for x in ("answer", "reasoning", "confidence")]))

    payloads = F.filter(F.transform(listed, read), lambda p: p["answer"].isNotNull())
    claims = F.concat(*[F.transform(F.regexp_extract_all(raw, F.lit(p), F.lit(1)), lambda a: F.upper(a)) for p in _CLAIMS])
    bare = bare_label(raw)
    fields = F.transform(F.regexp_extract_all(raw, F.lit(_FIELD), F.lit(1)), lambda a: F.upper(a))
    return F.struct(_payload(strict).alias("told"), payloads.alias("payloads"), claims.alias("claims"), bare.alias("bare"), fields.alias("fields"))


def _agreed(strict: Column, said: Column) -> Column:
    """parse_calibration's struct of what _claims_of found."""
    return bound(_found(said), lambda found: _judged(strict, said["told"], said["payloads"], said["bare"], said["fields"], found))


def _found(said: Column) -> Column:
    in_json = F.transform(said["payloads"], lambda p: p["answer"])
    found = F.array_sort(F.array_distinct(F.concat(in_json, said["claims"], F.when(said["bare"].isNotNull(), F.array(said["bare"])).otherwise(F.expr(_TEXTS)), said["fields"])))
    return F.coalesce(found, F.expr(_TEXTS))


def _judged(strict: Column, told: Column, payloads: Column, bare: Column, fields: Column, found: Column) -> Column:
    in_json = F.transform(payloads, lambda p: p["answer"])
    is_told, one = told["answer"].isNotNull(), F.size(found) == 1
    first = F.when(one & (F.size(in_json) > 0), F.get(payloads, F.lit(0)))
    source = (
        F.when(is_told, "strict_json")
        .when(F.size(found) > 1, "conflicting_answers")
        .when(F.size(found) == 0, "none")
        .when(F.size(in_json) > 0, "embedded_json")
        .when(bare.isNotNull(), "bare_answer")
        .when(F.size(fields) > 0, "malformed_json_answer_field")
        .otherwise("explicit_final_answer")
    )
    error = (
        F.when(is_told, F.when(~told["compliant"], BAD_FIELD))
        .when(F.size(found) > 1, CONFLICT)
        .when(one, RECOVERED)
        .when(strict.isNotNull(), NO_STRICT)
        .otherwise(NOTHING)
    )
    return F.struct(
        F.when(is_told, told["answer"]).when(one, F.get(found, F.lit(0))).alias("answer"),
        source.alias("source"),
        F.when(is_told, F.expr(_TEXTS)).otherwise(found).alias("candidates"),
        (is_told & told["compliant"]).alias("compliant"),
        (is_told | one).alias("extractable"),
        (~is_told & one).alias("fallback_used"),
        (~is_told & (F.size(found) > 1)).alias("ambiguous"),
        strict.isNotNull().alias("strict_syntax"),
        F.when(is_told, told["reasoning"]).otherwise(F.coalesce(first["reasoning"], F.lit(""))).alias("reasoning"),
        F.when(is_told, told["confidence"]).otherwise(first["confidence"]).alias("confidence"),
        error.alias("parse_error"),
    )


def name_map(names: Column) -> Column:
    """Map from lower-cased name to label of an array of four names; null unless they are not empty and unlike."""
    keys = F.transform(names, lambda n: F.lower(strip(n)))
    sound = (F.size(F.array_distinct(F.filter(keys, lambda k: k != ""))) == 4) & (F.size(names) == 4)
    return F.when(sound, F.map_from_arrays(keys, F.array(*[F.lit(x) for x in "ABCD"])))


def parse_followup(raw: Column, names: Column, base: Column, salvaged: Column, strict: Column | None = None) -> Column:
    """Struct of answer, source, candidates, extractable, compliant, strict_format, name_used, fallback_used, ambiguous and
    parse_error: labels as in parse_calibration, and whole names of candidates, which are right but never compliant.

    names: name_map of the item; base: parse_calibration(raw, salvaged), salvaged: salvage(raw), as columns."""
    strict = strict_json(raw, salvaged) if strict is None else strict
    given = F.struct(raw.alias("raw"), names.alias("names"), base.alias("base"), strict.alias("strict"), salvaged["objects"].alias("objects"))
    # As in parse_calibration, each step is worked out once.
    return bound(given, lambda g: bound(_named_in(g["raw"], g["names"], g["strict"], g["objects"]), lambda n: bound(F.array_sort(F.array_union(n["told"], g["base"]["candidates"])), lambda every: _followed(g["base"], n, every))))


def _named_in(raw: Column, names: Column, strict: Column, objects: Column) -> Column:
    """Struct of whole (label, by label or name, and strict_format of the strict answer) and told, the labels of all names that are
    claimed."""
    named = lambda t: F.element_at(names, F.lower(F.regexp_replace(strip(t), r"\.+\z", "")))

    def of(said: Column) -> Column:
        return bound(strict_label(said), lambda label: F.struct(label.alias("label"), F.coalesce(label, named(said)).alias("whole"), (label.isNotNull() & strip(said).isin("A", "B", "C", "D")).alias("strict_format")))

    def from_object(o: Column) -> Column:
        return bound(_text(F.try_parse_json(o), "$.answer"), lambda text: F.when(strict_label(text).isNull(), named(text)))

    listed = F.coalesce(objects, F.when(_is_object(strict), F.array(F.to_json(strict))), F.expr(_TEXTS))
    lower = F.lower(raw)
    # A pattern with a name in it is made anew for each row: only names that the text holds are asked for.
    claimed = F.filter(F.map_entries(names), lambda e: F.contains(lower, e["key"]) & F.regexp_like(lower, F.concat(F.lit(_NAME_CLAIM + r"\Q"), e["key"], F.lit(r"\E[.]?\s*$"))))
    told = F.coalesce(F.array_compact(F.concat(F.transform(listed, from_object), F.transform(claimed, lambda e: e["value"]))), F.expr(_TEXTS))
    whole = bound(F.when(_is_object(strict), _text(strict, "$.answer")), of)
    return F.struct(whole.alias("whole"), told.alias("told"))


def _followed(base: Column, found: Column, every: Column) -> Column:
    told, label, whole, strict_format = found["told"], found["whole"]["label"], found["whole"]["whole"], found["whole"]["strict_format"]
    is_whole, labels_only = whole.isNotNull(), base["extractable"] & (F.size(told) == 0)
    one, several = ~labels_only & (F.size(every) == 1), ~labels_only & (F.size(every) > 1)
    pick = lambda strictly, alone, many, rest: F.when(is_whole, strictly).when(labels_only, rest).when(one, alone).when(several, many).otherwise(rest)
    no, yes = F.lit(False), F.lit(True)
    return F.struct(
        pick(whole, F.get(every, F.lit(0)), F.lit(None).cast("string"), base["answer"]).alias("answer"),
        pick(F.when(label.isNotNull(), "strict_json_label").otherwise("strict_json_candidate_name"), F.lit("fallback_candidate_name"), F.lit("conflicting_answers"), base["source"]).alias("source"),
        pick(F.array(whole), every, every, base["candidates"]).alias("candidates"),
        pick(yes, yes, no, base["extractable"]).alias("extractable"),
        pick(strict_format & base["compliant"], base["compliant"], base["compliant"], base["compliant"]).alias("compliant"),
        F.coalesce(is_whole & strict_format, no).alias("strict_format"),
        pick(label.isNull(), yes, F.size(told) > 0, no).alias("name_used"),
        pick(label.isNull(), yes, F.size(told) > 0, base["fallback_used"]).alias("fallback_used"),
        pick(no, no, yes, base["ambiguous"]).alias("ambiguous"),
        pick(F.when(~strict_format, OTHER_FORM), F.lit(NAME_RECOVERED), F.lit(CONFLICT), base["parse_error"]).alias("parse_error"),
    )
