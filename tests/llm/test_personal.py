"""Personal data against plain scans and counts."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from caselattice.llm import personal_data, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (i % 2 + 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def only_digits(x):
    return re.sub("[^0-9]", "", x)


CHECKS = [
    ("email", EMAIL, lambda x: True, str.lower),
    ("ip", IP, lambda x: all(int(p) <= 255 for p in x.split(".")), str),
    ("card", CARD, lambda x: 16 <= len(only_digits(x)) <= 19 and luhn(only_digits(x)), only_digits),
    ("phone", PHONE, lambda x: 8 <= len(only_digits(x)) <= 15, only_digits),
]


def base_by_hand(text):
    return [(k, m.start(), m.end()) for k, p, holds, _ in CHECKS for m in p.finditer(text) if holds(m.group())]


def words_of(text):
    """(word, start, end), addresses left out."""
    found, at = [], 0
    pattern = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[^\W\d_]\w*")
    for m in pattern.finditer(text):
        if "@" not in m.group():
            found.append((m.group().lower(), m.start(), m.end()))
    return found


def spans_by_hand(texts):
    distinct, near = sorted({t for t in texts if t}), defaultdict(lambda: defaultdict(set))
    for text in distinct:
        for kind, p, holds, named in CHECKS:
            hits, end = list(p.finditer(text)), 0
            for i, m in enumerate(hits):
                following = hits[i + 1].start() if i + 1 < len(hits) else len(text)
                left, right = text[end : m.start()], text[m.end() : following]
                end = m.end()
                if len(left) > personal_data.CONTEXT:
                    left = re.sub(r"\A[^\W_]+", "", left[-personal_data.CONTEXT :])
                if len(right) > personal_data.CONTEXT:
                    right = re.sub(r"[^\W_]+\Z", "", right[: personal_data.CONTEXT])
                if holds(m.group()):
                    near[text][kind + ":" + named(m.group())] |= {w for w, _, _ in words_of(left + " | " + right)}
    c, k, d, support = (defaultdict(int) for _ in range(4))
    for text in distinct:
        copies = texts.count(text)
        for w in {w for w, _, _ in words_of(text)}:
            d[w] += copies
        for e, ws in near[text].items():
            c[e] += copies
            support[e] += 1
            for w in ws:
                k[e, w] += copies
                support[e, w] += 1
    out = []
    for text in texts:
        text, flagged = text or "", {}
        for e, ws in near[text].items():
            for w in ws:
                n = len([t for t in texts if t])
                if support[e] >= personal_data.SUPPORT and support[e, w] >= personal_data.SUPPORT and c[e] < n:
                    share = math.log2(n * k[e, w] / (c[e] * d[w])) / math.log2(n / c[e])
                    flagged[w] = max(share, flagged.get(w, 0))
        treated = [(personal_data.KINDS[4 + (flagged[w] >= personal_data.REMOVE)], s, e) for w, s, e in words_of(text) if flagged.get(w, 0) >= personal_data.GENERALISE]
        out.append(base_by_hand(text) + sorted(treated))
    return out


ODD = [
    "a@b.c_d@e.f x@y z@q.r.s. .@a.b é@a.b éa@b.c a@-.-- a@b..c",
    "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3 9999999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111 1111  1111 1111 0000000000000000 00000000000000000000 79927398713",
    "+1 (017) 555-7713 +12345678 +1234567 ++49 30 1234567) +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +1 ( ) 2",
    "", None, "mail me: Éva.Ñu@x.example.com, 10.0.0.1", "a.b.c.d@e.f" * 3,
]


def given():
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)] + ["Éire", "the", "of"] * 20
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = list(ODD)
    for i in range(40):
        who = rng.choice([("Ann", "ann@x.com"), ("Bob", "+1 (017) 555-7713"), ("Cyd", "10.1.2.3"), ("Dee", "4111 1111 1111 1111")])
        texts.append(f"{prose(rng.randint(0, 60))} {who[0]} Secretname{who[0]} {who[1]} ann's {prose(rng.randint(0, 60))} {'bob@y.org' if i % 7 == 0 else ''} {who[0].upper()}")
    texts += [prose(60) for _ in range(50)] + [f"{prose(9)} SecretnameAnn" for _ in range(10)] + texts[10:14]
    return texts


def test_spans_equal_plain_counts(spark):
    texts = given()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "i int, text string, personal string, _base int").repartition(5)
    rows = sorted(personal_data.find_personal(df, "text").collect(), key=lambda r: r.i)
    want = spans_by_hand(texts)
    assert [[(s.kind, s.start, s.end) for s in r.personal] for r in rows] == [sorted(w, key=lambda s: (personal_data.KINDS.index(s[0]), s[1])) for w in want]
    assert {s.kind for r in rows for s in r.personal} == set(personal_data.KINDS) and rows[0]._base == 1


def test_tables_too_large_to_broadcast_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given())], "i int, text string")
    show = lambda: sorted((r.i, r.s) for r in personal_data.find_personal(df, "text").select("i", personal_data.joined(F.col("personal")).alias("s")).collect())
    want = show()
    monkeypatch.setattr(personal_data, "BROADCAST", 0)
    assert show() == want


def test_sanitised_texts(spark):
    texts = given()
    df = personal_data.find_personal(spark.createDataFrame([(t,) for t in texts], "text string"), "text").withColumn("was", F.col("text"))
    for r in personal_data.sanitise(df, "text").collect():
        want, at = "", 0
        spans = sorted((s.start, s.rank, s.end) for s in r.personal)
        for start, rank, end in spans:
            if start >= at:
                name = "[NAME]" if r.was[start].isupper() else "[WORD]"
                want += r.was[at:start] + ("" if rank == 5 else name if rank == 4 else f"[{personal_data.KINDS[rank].upper()}]")
            at = max(at, end)
        assert r.text == (None if r.was is None else want + r.was[at:])


def test_long_texts_and_no_rows(spark):
    runs = ["a." * 400_000 + "@", "1." * 400_000, "1-" * 400_000, "+1" + "-" * 800_000, "x@y.z " * 5_000 + "a" * 800_000, "a@" * 400_000, "1" * 800_000]
    df = spark.createDataFrame(list(enumerate(runs)), "i int, text string")
    got = {r.i: len(r.personal) for r in personal_data.find_personal(df, "text").collect()}
    assert got == {i: 5_000 if i == 4 else 100_000 if i == 1 else 0 for i in range(7)}
    assert personal_data.find_personal(df.limit(0), "text").count() == 0


def test_op11_over_whole_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    want = dict(zip(ids, spans_by_hand([texts[i] for i in ids])))
    rows = queries.op11_personal_data(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == ids
    for r in rows:
        base = [s for s in want[r.doc_id] if s[0] in personal_data.KINDS[:4]]
        shown = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in personal_data.KINDS[:4]]
        assert r.spans == shown(sorted(want[r.doc_id], key=lambda s: (personal_data.KINDS.index(s[0]), s[1])))
