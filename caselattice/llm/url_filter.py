r"""URL filters by pattern rules indexed by their rarest literal token, with built-in functions only.

A rule is a regular expression over host and path, written together, with the literal tokens that every URL it can fit
must hold as whole tokens (runs of letters and digits). Token counts over all URLs say which of a rule's tokens is
rarest; the rule is filed under that one. A URL's tokens fetch the rules filed under them, and only those run their
regular expressions; the longest fitting rule decides. The index is a bucketed array in the plan, found by hash: its size is
that of the rule list, which the caller passes as a Python list, so no row is shuffled to judge it.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and gets the default verdict;
of equally long fitting rules the first by name decides; an empty rule list gives every URL the default verdict; an
empty table gives an empty table. Other columns pass through; the operator's own columns replace those of the same names.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselattice.llm.names import unused

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """weight: of the rules that fit, the one with the greatest weight decides."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and all its subdomains if the path starts with `path`."""
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", host), re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", path)
    # A path's last token may go on in the URL, so it isn't known to be whole.
    inner = re.sub(r"[A-Za-z0-9]+\Z", "", path)
    return Rule(host + path, verdict, rf"(?s)\A(?:[^/]*\.)?{quoted[0]}{quoted[1]}", tuple(sorted(set(re.findall(TOKEN, host) + re.findall(TOKEN, inner)))), len(host + path))


def pattern_rule(name: str, verdict: str, pattern: str, tokens: tuple[str, ...], weight: int = 0) -> Rule:
    """tokens: whole tokens that every fitting URL holds; none means that the rule runs on every URL."""
    return Rule(name, verdict, pattern, tokens, weight)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without `://`."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, key: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of these tokens: one row a token comes to the driver."""
    held = urls.select(F.explode(F.filter(F.array_distinct(F.regexp_extract_all(key, F.lit(TOKEN), F.lit(0))), lambda t: t.isin(tokens))).alias("t"))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """Buckets of rules by the CRC-32 of the token they are filed under; those without one come last."""
    size = max(16, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(size + 1)]
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        at = size if token is None else zlib.crc32(token.encode()) % size
        buckets[at].append({"token": token, "name": r.name, "verdict": r.verdict, "pattern": r.pattern, "weight": r.weight})
    kind = "array<array<struct<token:string,name:string,verdict:string,pattern:string,weight:int>>>"
    return F.from_json(F.lit(json.dumps(buckets)), kind), size


def judge_urls(df: DataFrame, url: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Adds host, path, n_candidates (rules whose expressions ran), rule and verdict."""
    host, path = split_url(F.col(url))
    key, run, best_of = unused(df, "_key", "_run", "_best")
    keyed = df.withColumns({"host": host, "path": path}).withColumn(key, F.concat("host", "path"))
    wanted = sorted({t for r in rules for t in r.tokens})
    index, size = _index(rules, token_counts(keyed, key, wanted) if wanted else {})
    tokens = F.array_distinct(F.regexp_extract_all(key, F.lit(TOKEN), F.lit(0)))

    def filed(t: Column) -> Column:
        return F.filter(F.get(index, F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(size)).cast("int")), lambda r: r["token"] == t)

    found = keyed.withColumn(run, F.concat(F.flatten(F.transform(tokens, filed)), F.get(index, F.lit(size))))
    fits = F.filter(run, lambda r: F.expr("true") & F.regexp_like(F.col(key), r["pattern"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct((-r["weight"]).alias("w"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    judged = found.withColumn(best_of, F.when(F.size(run) > 0, best))
    return judged.withColumns({"n_candidates": F.size(run), "rule": F.col(best_of)["name"], "verdict": F.coalesce(F.col(best_of)["verdict"], F.lit(default))}).drop(key, run, best_of)


#: Rules of the method's own: expressions for pages that are rarely prose.
PATTERN_RULES = [
    pattern_rule("re:login", "block", r"/login(?:/|\.|\z)", ("login",)),
    pattern_rule("re:signup", "block", r"/signup(?:/|\.|\z)", ("signup",)),
    pattern_rule("re:cart", "block", r"/cart(?:/|\.|\z)", ("cart",)),
    pattern_rule("re:wp-admin", "block", r"/wp-admin(?:/|\z)", ("wp", "admin")),
    pattern_rule("re:tracker", "block", r"\A(?:[^/]*\.)?(?:track|pixel)\.[^/]*/pixel(?:/|\z)", ("pixel",)),
]
