"""The queries opN_<name> over the whole of the smallest tables, against their SQL or brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from caselattice.llm import alignment, bpe, license_scan, queries, secret_scan, text_kernel
from test_embeddings_and_leaks import links_by_hand
from test_native import base_spans
from test_python_ops import base_by_hand


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    order = [[x[0] for x in cur.description].index(c) for c in columns]
    want = [[r[i] for i in order] for r in cur.fetchall()]
    assert sorted(map(repr, map(list, got.select(*columns).collect()))) == sorted(map(repr, want)) and want


def test_op1_against_all_pairs(spark, sf, texts):
    words = {d: text_kernel.word_hashes(t.encode()).astype(np.uint32) for d, t in texts.items()}
    root, ids = {d: d for d in words}, sorted(words)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[:k]:
            most = max(len(words[a]), len(words[b])) // 5
            if abs(len(words[a]) - len(words[b])) <= most and find(a) != find(b) and alignment.distance_within(words[a], words[b], most) is not None:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r.doc_id: (r.group_id, r.kept) for r in queries.op1_near_dedup(spark, sf).collect()}
    assert got == {d: (find(d), find(d) == d) for d in ids}


def test_op3_and_op4_against_plain_scans(spark, sf, texts):
    for r in queries.op3_secret_scan(spark, sf).collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == digest(",".join(f"{k}:{s}:{e}" for s, _, k, e in base))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, _, k, _ in base) for x in secret_scan._KINDS[:3]]
        assert {f"{k}:{s}:{e}" for s, _, k, e in base} <= set(filter(None, r.spans.split(",")))
    for r in queries.op4_license_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        found = {label for phrase, label in {**license_scan.BASE_PHRASES, **license_scan.NOTICE_PHRASES}.items() if re.search(rf"(?<![^ ]){phrase}(?![^ ])", " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))))}
        assert found <= set(filter(None, r.labels.split(",")))


def test_op5_and_op10_answer_every_document(spark, sf, texts):
    for query, folds, fold in ((queries.op5_quality, 5, 0), (queries.op10_langid, 4, 2)):
        rows = query(spark, sf).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in rows)


def test_op7_against_all_pairs(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op7_embedding_dedup(spark, sf).collect()}
    assert got == links_by_hand(rows)


def test_op9_against_the_library(spark, sf, texts):
    encoder = bpe.Vocabulary(bpe.RANKS, public_tokenizers.PATTERN).encoder()
    for r in queries.op9_bpe(spark, sf).collect():
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(texts[r.doc_id]))
