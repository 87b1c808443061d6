"""Ranked search against a plain loop over small tables."""

import math
import random
import re

from caselattice.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def by_hand(docs, items, top):
    words = [(d, TERM.findall(lower(t))) for d, t in docs if t]
    words = [(d, w) for d, w in words if w]
    total, length = len(words), sum(len(w) for _, w in words)
    found = set()
    for key, text in set(items):
        scores = []
        for d, w in words:
            score, m = 0, 75 + 25 * len(w) * total // length
            for t in TERM.findall(lower(text or "")):
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in x for _, x in words) + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        found |= {(key, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top], 1)}
    return found


def searched(spark, docs, items, top=5):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    d, q = d.selectExpr("doc_id", "text", "1 AS score", "2 AS `rank`", "3 AS query"), q.selectExpr("item_id", "text", "4 AS block", "5 AS id")
    return [tuple(r) for r in lexical_search.search(d.repartition(3), "doc_id", "text", q, "item_id", "text", top).select("item_id", "rank", "doc_id", "score").collect()]


def given():
    rng = random.Random(5)
    vocabulary = ["a", "Bé", "CÉ", "d9", "日本", "e_f", "g's", "İx", "zz"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", " "]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "a " * 50_000), (None, "zz a"), (None, None)]
    docs += [(100 + i, "qq Zz") for i in range(12)]
    items = [(i, text(rng.randint(0, 6))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, "qq"), (None, "zz"), (0, "a"), (22, "qq")]
    return docs, items


def test_search_equals_a_loop(spark):
    docs, items = given()
    got = searched(spark, docs, items)
    assert set(got) == by_hand(docs, items, 5) and len(got) == len(set(got))
    assert sorted(d for k, _, d, _ in got if k == 22) == [100, 101, 102, 103, 104]


def test_small_windows_and_blocks_change_nothing(spark, monkeypatch):
    docs, items = given()
    want = by_hand(docs, items, 5)
    monkeypatch.setattr(lexical_search, "WINDOW", 8)
    monkeypatch.setattr(lexical_search, "TERMS", 10)
    assert set(searched(spark, docs, items)) == want


def test_search_of_empty_tables(spark):
    docs, items = given()
    assert searched(spark, [], items) == searched(spark, docs, []) == searched(spark, [(1, None)], items) == []
