"""License scans: Aho-Corasick finds phrases and identifier tags, a shunting-yard parser evaluates licence expressions.

Phrases are looked for in the stream of a text's words, so that punctuation and line breaks between words do not matter.
An identifier tag's rest of the line is read as an expression of and/or/with; a choice binds as little as its freest part,
a conjunction as much as its strictest, an exception loosens. A document's score is the strictness of the strictest
finding: 0 for none, 1 for all rights reserved.

Defined results: null text counts as empty, with no words, no findings and score 0; an expression that cannot be parsed
adds the label `unparsed`; repeated rows are each judged for themselves; an empty table gives an empty table. Other columns
pass through; the operator's own columns replace those of the same names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caselattice.llm.text_kernel import WORD_BYTES, as_bytes

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache-2.0",
    "mozilla public license": "mpl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons": "cc",
    "public domain": "public-domain",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "proprietary and confidential": "reserved",
}
TAG = "spdx license identifier"
#: Strictness by label or by how an identifier begins.
STRICTNESS = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.05, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.15, "cc-by-nc": 0.8, "cc-by-nd": 0.8,
    "cc-by-sa": 0.4, "cc-by": 0.2, "cc": 0.3, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "agpl": 0.8, "gpl": 0.7, "reserved": 1.0, "licenseref": 0.9,
}
UNKNOWN = 0.5
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
_TAG_LINE = re.compile(rb"(?i)SPDX[^A-Za-z0-9\r\n\x80-\xff]+License[^A-Za-z0-9\r\n\x80-\xff]+Identifier[ \t]*:?([^\r\n]*)")


def strictness(name: str) -> float:
    name = name.lower()
    fits = [k for k in STRICTNESS if name == k or name.startswith(k + "-") or name.startswith(k + "+")]
    return STRICTNESS[max(fits, key=len)] if fits else UNKNOWN


def to_postfix(expression: str) -> list[str] | None:
    """Dijkstra's shunting yard: with before and before or, all to the left; None if it is no expression. What follows a
    whole expression on the line (a comment's end, prose) is left out."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            held.append("(")
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif operand:
            out.append(token)
            operand = False
        else:
            break
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Strictness and the licences named; exceptions are no licences."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((strictness(token), {token.lower()}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((max(0.0, a - 0.2), left))
        else:
            stack.append(((min if token == "or" else max)(a, b), left | right))
    return stack[-1]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **NOTICE_PHRASES, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes, search: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.translate(WORD_BYTES).split()
    stream = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    score, tagged, at, word = 0.0, False, 0, 0
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in search.iter(stream))
    for start, phrase in hits:
        word, at = word + stream.count(" ", at, start), start
        if phrase == TAG:
            tagged = True
            continue
        label = BASE_PHRASES.get(phrase) or NOTICE_PHRASES[phrase]
        if phrase in BASE_PHRASES:
            base.append(word)
            base_labels.add(label)
        labels.add(label)
        score = max(score, strictness(label))
    for line in _TAG_LINE.findall(text) if tagged else ():
        postfix = to_postfix(line.decode("utf-8", "replace"))
        rigour, names = evaluate(postfix) if postfix else (UNKNOWN, {"unparsed"})
        labels |= names
        score = max(score, rigour)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


_FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scan_licenses(df: DataFrame, text: str) -> DataFrame:
    """Appends n_words, n_base, first_word, last_word, base_labels, labels and score; df without the text stays as it is."""
    where = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c not in _FIELDS.names]
    schema = T.StructType([df.schema[i] for i in kept] + _FIELDS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [scan(x, search) for x in as_bytes(part.column(where))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), _ARROW, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)
