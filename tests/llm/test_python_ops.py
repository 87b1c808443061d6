import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from caselattice.llm import bpe, langid, license_scan, quality, text_kernel

ODD = ["", "a", " ", "it's we'll 've", "x" * 700 + " " * 90 + "\n\n \t y", "ab" * 300, " 　   \U0001f600\U0001f600 9876543210 ÀÉ", "'" * 50 + "re", "a\n" * 100, "   lead and trail   "]


def test_bpe_chunks_equal_the_whole(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "'", "re", " ", "  ", "\n", "7", "é", "-", "日本", "xyz"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t, "kept") for i, t in enumerate([None, *texts, *texts[:3]])]
    df = spark.createDataFrame(rows, "doc_id int, text string, _row string").repartition(3)
    vocabulary = bpe.Vocabulary(bpe.RANKS, public_tokenizers.PATTERN)
    for size, overlap in ((37, 12), (50, 5), (1 << 16, 1 << 10)):
        got = bpe.decode_bpe(bpe.encode_bpe(df, "text", chunk_chars=size, overlap=overlap), "ids").collect()
        assert len(got) == len(rows)
        for r in got:
            t = rows[r.doc_id][1] or ""
            assert r.ids == vocabulary.encoder().encode_ordinary(t), (size, t)
            assert bytes(r.decoded).decode() == t and r._row == "kept"


def test_stitch_finds_only_true_boundaries():
    compiled, rng = regex.compile(public_tokenizers.PATTERN), random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "'", "'r", " ", "\n", "7", "."]) * rng.randint(1, 9) for _ in range(40))
        true = {0, *bpe.boundaries(t, compiled)}
        chunks = [(s, [s + e for e in bpe.boundaries(c, compiled)]) for s, c in bpe.cut(t, 20, 8)]
        assert set(bpe.stitch(t, chunks, compiled, 8)) <= true


def test_every_text_is_cut_and_stitched(spark, sf, monkeypatch):
    rng, pattern = random.Random(7), regex.compile(public_tokenizers.PATTERN)
    texts = ["".join(rng.choice(["a", "bc", "12", " ", "  ", "\n", "'s", "'re", "é", "日", "!?", "\u0301", "z" * 40]) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    seams = 0
    for text in texts:
        for size, overlap in ((16, 8), (50, 20), (200, 64)):
            assert bpe.pre_tokens(text, pattern, size, overlap) == pattern.findall(text)
            seams += len(text) > size + overlap
    assert seams > 500
    asked = []
    monkeypatch.setattr(bpe, "stitch", lambda *a: asked.append(a))
    whole = next(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and 2000 <= len(r.text) <= 4000)
    chunks = []
    counted = type("P", (), {"findall": lambda self, x: chunks.append(x) or pattern.findall(x)})()
    assert bpe.pre_tokens(whole, counted, bpe.TASK_CHARS, bpe.TASK_OVERLAP) == pattern.findall(whole)
    assert len(chunks) >= 2 and not asked


def test_bpe_of_long_texts_at_the_default_sizes(spark):
    rng = random.Random(8)
    prose = " ".join("".join(rng.choice("abcdefé ") for _ in range(rng.randint(1, 9))) for _ in range(40_000))
    texts = [prose, "a" * 200_000, "x" * 70_000 + " " + prose[:90_000]]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    encoder = bpe.Vocabulary(bpe.RANKS, public_tokenizers.PATTERN).encoder()
    for r in bpe.decode_bpe(bpe.encode_bpe(df, "text"), "ids").collect():
        assert len(texts[r.doc_id]) > bpe.CHUNK_CHARS and bytes(r.decoded).decode() == texts[r.doc_id]
        if r.doc_id != 1:  # one run of 200,000 letters takes the plain encoder minutes
            assert r.ids == encoder.encode_ordinary(texts[r.doc_id])


def test_a_run_without_boundaries_is_walked_once():
    class Counted:
        pattern, steps = regex.compile(public_tokenizers.PATTERN), 0

        def finditer(self, text, start):
            for m in self.pattern.finditer(text, start):
                Counted.steps += 1
                yield m

    text = "a b " + "c" * 4000 + " d e f g h"
    chunks = [(s, [s + e for e in bpe.boundaries(c, Counted.pattern)]) for s, c in bpe.cut(text, 20, 8)]
    cuts = bpe.stitch(text, chunks, Counted(), 8)
    assert set(cuts) <= {0, *bpe.boundaries(text, Counted.pattern)} and Counted.steps < 20


def test_bpe_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.decode_bpe(bpe.encode_bpe(df, "text"), "ids").count() == 0


LICENSES = [
    None,
    "",
    "CC-BY 4.0. GNU General\nPublic, License; all rights, reserved! All Rights Reserved",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */",
    "# SPDX-License-Identifier: MIT OR",
    "cc by cc by cc byé ccby",
    "Ünïcode 日本 words_here 12",
]


def base_by_hand(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hits = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_phrases_against_brute_force(spark):
    rng = random.Random(3)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x"]
    texts = LICENSES + ["".join(rng.choice(words) + rng.choice([" ", "-", "\n", ". "]) for _ in range(80)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id int, text string, score int")
    for r in license_scan.scan_licenses(df, "text").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan_licenses(df.limit(0), "text").count() == 0


@pytest.mark.parametrize(
    "expression,postfix",
    [
        ("MIT", ["MIT"]),
        ("MIT OR GPL-2.0 AND BSD-3-Clause", ["MIT", "GPL-2.0", "BSD-3-Clause", "and", "or"]),
        ("(MIT or X) and Y with E", ["MIT", "X", "or", "Y", "E", "with", "and"]),
        ("MIT */ prose", ["MIT"]),
        ("MIT OR", None),
        ("(MIT", None),
        ("", None),
        ("and MIT", None),
    ],
)
def test_shunting_yard(expression, postfix):
    assert license_scan.to_postfix(expression) == postfix


def test_expressions_are_evaluated():
    score = lambda x: license_scan.evaluate(license_scan.to_postfix(x))
    assert score("MIT OR GPL-2.0") == (0.1, {"mit", "gpl-2.0"}) and score("MIT AND GPL-2.0")[0] == 0.7
    assert score("GPL-2.0 WITH Classpath-exception-2.0")[0] == pytest.approx(0.5)


def test_word_hashes_tell_words_apart():
    text = "The thé, THE-end the " * 9
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.replace("T", "t").replace("H", "h").replace("E", "e"))
    hashes = text_kernel.word_hashes(text.encode()).tolist()
    assert len(hashes) == len(words) and len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
    assert len(text_kernel.word_hashes(b"")) == 0


def test_feature_sums_equal_feature_counts():
    features, rng = text_kernel.Features(text_kernel.PRINT_BYTES), np.random.default_rng(1)
    texts = [b"", b"a", b"ab c", b"the the the cat", ("größe " * 300).encode(), b"x y " * 400000, b"the end"]
    weights = rng.normal(size=(features.size, 2))
    total, count = features.sums(texts, weights)
    for k, t in enumerate(texts):
        ids, n = features.counts(t)
        assert count[k] == n.sum() and np.allclose(total[k], n @ weights[ids])


def test_held_out_accuracy(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(documents, labels)
    scored = quality.score_quality(documents.select("doc_id", "text", F.lit("x").alias("score")), "text", model).join(labels, "doc_id").collect()
    out = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 10 and np.mean([r.predicted == r.quality for r in out]) >= 0.8
    spoken, trusted = langid.fit(documents)
    found = langid.predict_language(documents, "text", spoken, trusted).collect()
    out = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 30 and np.mean([r.lang_pred == r.lang for r in out]) >= 0.95


def by_every_feature(model, text):
    """Embeds each feature, averages, softmax: in plain Python, from the features' own definition."""
    total, n = [0.0] * len(model.classes), 0
    ids, counts = model.features.counts(text.encode())
    for i, c in zip(ids.tolist(), counts.tolist(), strict=True):
        n += c
        total = [t + c * model.scores[i][k] for k, t in enumerate(total)]
    z = [(t / max(n, 1) + b) * model.temperature for t, b in zip(total, model.bias.tolist(), strict=True)]
    e = [2.718281828459045 ** (x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_queries_score_as_by_every_feature(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    model = quality.fit(documents, labels)
    for r in quality.score_quality(documents.select("doc_id", "text"), "text", model).collect():
        assert r.score == pytest.approx(by_every_feature(model, texts[r.doc_id])[1], abs=1e-6) and r.predicted == (r.score >= quality.THRESHOLD)
    spoken, trusted = langid.fit(documents)
    for r in langid.predict_language(documents.select("doc_id", "text"), "text", spoken, trusted).collect():
        if r.lang_pred != "und":
            p = by_every_feature(spoken, texts[r.doc_id])
            assert r.lang_pred == spoken.classes[int(np.argmax(p))] and r.score == pytest.approx(max(p), abs=1e-6)


def test_labels_without_documents_fill_no_sample(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad $$ %% junk ") * 5) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1) for i in range(1000, 4000)] + [(7, 0), (9, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_class=40)
    got = quality.score_quality(docs, "text", model).collect()
    assert model.classes == [0, 1] and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9


def test_every_language_can_be_named(spark):
    names = [f"l{i:03d}" for i in range(230)]
    rows = [(k * 230 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 12, n) for k in range(6) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, _ = langid.fit(df, per_lang=4)
    assert model.classes == names
    clash = df.limit(3).withColumn("score", F.lit("x")).withColumn("rejected", F.lit(1))
    got = langid.predict_language(clash, "text", model)
    assert got.schema["score"].dataType.simpleString() == "double" and got.count() == 3


def test_models_of_odd_tables(spark):
    shape = "doc_id long, text string, lang string"
    odd = spark.createDataFrame([(None, None, "en"), (1, "", None), (1, "123 ...", "en"), (2, "the cat", "en"), (2, "the cat", "en")], shape)
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (9, 0)], "doc_id long, quality int")
    scored = quality.score_quality(odd, "text", quality.fit(odd, labels)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(odd.limit(0), "text", quality.fit(odd.limit(0), labels.limit(0))).count() == 0
    got = langid.predict_language(odd, "text", *langid.fit(odd)).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and len(got) == 5
    assert {r.lang_pred for r in langid.predict_language(odd, "text", *langid.fit(odd.limit(0))).collect()} == {"und"}
