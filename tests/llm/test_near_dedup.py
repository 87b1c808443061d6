import random

import numpy as np
import pytest

from caselattice.llm import alignment, components, near_dedup, text_kernel
from tests_by_hand import classes_by_hand, distance


def test_banded_alignment_against_the_whole_table():
    rng = random.Random(2)
    for _ in range(1500):
        letters = rng.choice([2, 5, 50])
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(letters) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.2:
            b = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        want = distance(a, b)
        for most in (0, 1, 5, 9, 40, 100):
            got = alignment.distance_within(np.array(a, np.uint32), np.array(b, np.uint32), most)
            assert got == (want if want <= most else None), (a, b, most)


def near_copies(rng):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(900)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = make(60), []
    for _ in range(14):
        base = make(rng.randint(30, 90))
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(texts[-1])
            for _ in range(max(1, len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    texts += [make(30) + passage + make(25) for _ in range(10)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("large,block,star,weight", [(256, 2048, 512, 1 << 22), (256, 2048, 4, 300), (3, 3, 2, 1 << 22)])
def test_classes_against_all_pairs(spark, monkeypatch, large, block, star, weight):
    """Whole buckets in a task; buckets in parts and blocks; buckets too large for one, by their rarest words."""
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STAR", star)
    monkeypatch.setattr(near_dedup, "WEIGHT", weight)
    rng = random.Random(11)
    texts = near_copies(rng) + ["", None, "one", "One!", "two words"]
    texts += texts[:6]
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, key int").repartition(5)
    got = near_dedup.classes(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.group_id for r in got} == classes_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes_by_hand(rows).values()))


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(str(x * x) for x in range(60))
    other = " ".join(str(x * x + 5) for x in range(60))
    rows = [(None, text), (None, text), (7, text), (7, text), (8, other), (9, other + " more"), (None, "alone here"), (10, text + " x"), (10, "far away")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classes(df).collect()
    assert len(got) == len(rows)
    ids = {}
    for r in got:
        ids.setdefault(r.doc_id, []).append(r.group_id)
    # Rows that share an id and differ in text are documents of their own; a class is named by its least real id.
    assert ids[8] == [8] and ids[9] == [8] and ids[7] == [7, 7] and sorted(ids[10]) == [7, 10]
    assert sorted(ids[None], key=str) == [7, 7, None]
    kept = near_dedup.keep_one(df)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone here"), (7, text), (8, other), (10, "far away")]
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_rows_of_one_id_unite_nothing(spark):
    words = [" ".join(f"{c}{i * i}" for i in range(50)) for c in "abcd"]
    rows = [(1, words[0]), (1, words[1]), (2, words[0] + " x"), (3, words[1] + " y"), (4, words[2]), (4, words[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.group_id, r.kept) for r in near_dedup.classes(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
    assert sorted(r.text for r in near_dedup.keep_one(df).collect()) == sorted(words)


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    copy = list(words)
    for at in rng.sample(range(len(words)), 3000):
        copy[at] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(words[:60_000]))], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near_dedup.classes(df).collect()} == {1: 1, 2: 1, 3: 3}


def edited(words, share, kind, rng):
    n, m = len(words), round(len(words) * share)
    at = np.arange(m) * n // m if kind == "even" else np.sort(rng.permutation(n)[:m])
    if kind == "deleted":
        return np.delete(words, at)
    out = words.copy()
    out[at] = rng.integers(0, 2**63, m).astype(np.uint64)
    return out


@pytest.mark.parametrize("kind,least", [("random", 0.95), ("even", 0.9), ("deleted", 0.93)])
def test_near_texts_share_a_sketch(kind, least):
    """Recall of candidates for texts that differ in 15 to 20 % of their words."""
    rng, found = np.random.default_rng(3), []
    for share in (0.15, 0.17, 0.19, 0.2):
        for n in (100, 200, 600):
            for _ in range(60):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                b = edited(a, share, kind, rng)
                sketch = lambda x: near_dedup.sketch_of(x, near_dedup.SHINGLE, near_dedup.N_SKETCHES, near_dedup.LENGTH)
                found.append((sketch(a) == sketch(b)).any())
    assert np.mean(found) >= least


def test_order_minhash_keeps_order_and_occurrences():
    w = np.arange(1, 40, dtype=np.uint64)
    sketch = lambda x: near_dedup.order_minhash(text_kernel.mix(x), 5, 64, 2)
    halves = np.concatenate([w[20:], w[:20]])
    assert (sketch(w) == sketch(w)).all() and (sketch(w) == sketch(halves)).mean() < 0.75
    assert len(set(near_dedup.labelled_kmers(np.ones(30, np.uint64), 5).tolist())) == 26
    long = text_kernel.mix(np.arange(40000, dtype=np.uint64))
    one = near_dedup.labelled_kmers(long, 5)
    odd = text_kernel.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    with np.errstate(over="ignore"):
        places = np.sort(np.argsort(one[None] * odd[:, None], axis=1)[:, :2], axis=1)
        value = text_kernel.mix(odd)
        for c in range(2):
            value = text_kernel.mix(value * np.uint64(0x9E3779B97F4A7C15) + one[places[:, c]])
    assert (near_dedup.order_minhash(long, 5, 4, 2) == value.view(np.int64)).all()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(500, 500), (None, 3), (700, 600), (600, 650)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {600: 600, 650: 600, 700: 600}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_allowed_edits_of_long_texts_are_plain_integers():
    got = near_dedup._allowed(np.int32(20000), np.int32(18000), 0.8)
    assert type(got) is int and got == 4000


def partners(a, b, wide):
    """Whether lengths and bags leave two texts' words as a pair."""
    import pyarrow as pa

    a, b = sorted((a, b), key=len)
    bags = pa.table({"bag": [near_dedup._labelled_words(x.astype(np.uint32))[1] if wide else near_dedup._bag(x) for x in (a, b)]})
    held = near_dedup._wide_bags(bags) if wide else near_dedup._bags(bags)
    return len(near_dedup._partners(0, np.array([len(a), len(b)], np.int32), np.ones(2, bool), held, near_dedup.SIMILARITY)[0]) > 0


def test_bags_leave_near_texts_and_fewer_others():
    rng, fresh = random.Random(4), lambda n: text_kernel.mix(np.array([rng.getrandbits(60) for _ in range(n)], np.uint64))
    words = fresh(40)
    for _ in range(300):
        a = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        if near_dedup.near_enough(a.astype(np.uint32), b.astype(np.uint32), near_dedup.SIMILARITY):
            assert partners(a, b, False) and partners(a, b, True)
    a = fresh(100)
    # 29 edits, of which 19 are those of length: with no regard to these, two texts of 20 edits may differ by as many words.
    assert not partners(a, np.concatenate([a[:71], fresh(10)]), False)
    assert not partners(a, np.concatenate([a[:71], fresh(10)]), True)
    # 85 words of 300 replaced, 60 allowed: in few bins many of them meet another's bin.
    long = fresh(300)
    assert not partners(long, np.concatenate([long[:215], fresh(85)]), True)
