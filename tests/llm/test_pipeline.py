import random

import pytest

import corpus_pipeline
from caselattice.llm import secret_scan
from tests_by_hand import classes_by_hand, leaks_by_hand


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(20)) for i in range(3)]
    good = [make(60) for _ in range(12)]
    good += [good[0] + " more", good[1], good[2] + " token = 0123456789abcdef0123456789abcdef"]
    good += [make(40) + " " + items[1][1] + " " + make(30)]
    bad = [" ".join(w + "$$$ %%%" for w in make(60).split()) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t), i) for i, t in enumerate(good + bad)] + [(None, None, None, None, None, None), (900, "", "en", "s", 0, 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaks long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good) + len(bad))], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items, len(good)


def test_stages_against_brute_force(spark, corpus):
    folder, items, n_good = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = stage(spark, docs, folder)
        if name != "bpe":
            assert at[name].columns == columns
        at[name] = {r.doc_id: r for r in at[name].collect()}
        docs = spark.createDataFrame([tuple(r)[: len(columns)] for r in at[name].values()], docs.schema)
    rejected = set(range(n_good, n_good + 12)) & set(at["quality"])
    assert not rejected and set(range(n_good)) <= set(at["quality"])
    named = [(d, r.text) for d, r in at["quality"].items() if d is not None]
    assert {d for d in at["near_dedup"] if d is not None} >= set(classes_by_hand(named).values()) - {900}
    assert len(at["near_dedup"]) == len(set(classes_by_hand([(d if d is not None else -1, r.text) for d, r in at["quality"].items()]).values()))
    assert set(at["decontaminate"]) == {d for d, r in at["near_dedup"].items() if not leaks_by_hand(r.text, items)}
    assert set(at["secrets"]) == set(at["decontaminate"])
    for d, r in at["secrets"].items():
        was = at["decontaminate"][d].text
        assert r.text == was or (secret_scan.PLACEHOLDER in r.text and r.n_chars == len(r.text))
        assert "0123456789abcdef0123456789abcdef" not in (r.text or "")
        assert at["bpe"][d].text == (r.text or "") and at["bpe"][d].n_tokens == len(at["bpe"][d].token_ids)


def test_run_is_its_stages(spark, corpus):
    folder, _, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 5 and {"doc_id", "token_ids", "n_tokens", "leaks"} <= set(got.columns)


def test_an_empty_corpus(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
