import random

import numpy as np
import pandas as pd
import pytest

from caselattice.llm import decontaminate, embedding_dedup, hnsw
from tests_by_hand import leaks_by_hand


def links_by_hand(rows, least=0.93):
    """rows: (id, vector, label); every pair compared."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    links, root = [0] * len(rows), [r[0] for r in rows]
    changed = True
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    while changed:
        changed = False
        for i, j in edges:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return {r[0]: (n, c, r[0] == c) for r, n, c in zip(rows, links, root, strict=True)}


@pytest.mark.parametrize("shard", [8192, 40])
def test_links_against_all_pairs(spark, shard):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                v = centre + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.3])
                for _ in range(rng.choice([1, 1, 1, 3])):
                    rows.append((1000 - k, v.tolist(), label))
                    k += 1
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 16, 1), (5003, [None] + [1.0] * 15, 1), (5004, [float("nan")] * 16, 1), (5005, [float("inf")] * 16, 1), (5006, [1e300] * 16, 1), (5007, [1e-300] * 16, 1), (5008, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_embeddings(df, shard=shard).collect()}
    want = links_by_hand([r for r in rows if r[0] not in (5006, 5007)])
    assert got.pop(5006) == (1, 5006, True) and got.pop(5007) == (1, 5006, False)
    assert got == want


def test_rows_without_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links) for r in embedding_dedup.link_embeddings(df).collect())
    assert got == [(0, 2), (0, 2), (4, 2)]
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_graph_recall_and_round_trip():
    rng = np.random.default_rng(8)
    v = hnsw.unit(np.repeat(rng.normal(size=(60, 24)), 10, 0) + rng.normal(size=(600, 24)) * 0.15)
    graph = hnsw.Graph.load(hnsw.Graph(v).dump())
    hit = embedding_dedup.asked(graph, graph, False, 0.93)
    true = v @ v.T >= 0.93
    assert (hit & true).sum() >= 0.97 * true.sum() and not (hit & ~true).any()


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_leaks_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(broadcast)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 15, 40])))) for i in range(12)] + [(12, None), (13, "!!"), (3, "again the third item is here")]
    texts = [None, "", "only", *(t for _, t in items)]
    for _ in range(40):
        _, t = rng.choice(items)
        w = (t or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = word()
        texts.append(" ".join(word() for _ in range(rng.randint(0, 60))) + "\n" + ", ".join(w).upper() + " " + " ".join(word() for _ in range(rng.randint(0, 30))))
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, _words string")
    got = decontaminate.find_leaks(df, "text", spark.createDataFrame(items, "item_id int, text string"))
    for r in got.collect():
        want = leaks_by_hand(texts[r.doc_id], items)
        assert [x.item_id for x in r.leaks] == [i for i, _ in want] and r._words == "kept", texts[r.doc_id]
        assert np.allclose([x.containment for x in r.leaks], [c for _, c in want])
    assert decontaminate.find_leaks(df, "text", spark.createDataFrame([], "item_id int, text string")).filter("size(leaks) > 0").count() == 0
    assert decontaminate.find_leaks(df.limit(0), "text", spark.createDataFrame(items, "item_id int, text string")).count() == 0


def test_rare_links_are_audited():
    class Narrow:
        """Finds nothing with a beam under 40."""

        vectors = np.eye(500)

        def within(self, query, least, beam, start=None):
            return np.flatnonzero(self.vectors @ query >= least) if beam >= 40 else np.array([], int)

    ours = Narrow()
    ours.vectors = np.zeros((500, 500))
    ours.vectors[3, 7] = 1  # the only link, of a query that 64 evenly spaced ones leave out
    hit = embedding_dedup.asked(ours, Narrow(), False, 0.93)
    assert hit[3, 7] and hit.sum() == 1


def test_the_graph_answers_with_the_recall_that_it_assures(monkeypatch):
    rng = np.random.default_rng(5)
    centres = hnsw.unit(rng.normal(size=(1500, 24)))
    v = hnsw.unit(np.concatenate([centres, centres[:200] + rng.normal(size=(200, 24)) * 0.05]))
    graph, true = hnsw.Graph(v), v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    asked = []
    within = graph.within
    graph.within = lambda query, least, beam, start=None: asked.append(start) or within(query, least, beam, start)
    monkeypatch.setattr(embedding_dedup, "AUDITED", 128)
    hit = embedding_dedup.asked(graph, graph, True, 0.93)
    assert not (hit & ~true).any() and (hit | hit.T)[true].mean() >= 0.97 and true.sum() >= 300
    assert set(range(len(v))) <= set(asked)
    at = embedding_dedup.probes(v, 0.93, 64)
    assert np.allclose((at * at).sum(axis=1), 1) and ((at @ v.T).max(axis=1) >= 0.93 - 1e-12).all()
    assert embedding_dedup.assured(256, 256) > 0.98 > 0.97 > embedding_dedup.assured(240, 256)


@pytest.mark.parametrize("same", [True, False])
def test_a_failed_audit_ends_in_comparing_all(monkeypatch, same):
    class Broken(hnsw.Graph):
        """Its links lead nowhere, so no beam finds anything."""

        def within(self, query, least, beam, start=None):
            return np.zeros(0, np.int64)

    monkeypatch.setattr(embedding_dedup, "AUDITED", 10)
    rng = np.random.default_rng(2)
    v = hnsw.unit(np.repeat(rng.normal(size=(40, 12)), 5, 0) + rng.normal(size=(200, 12)) * 0.1)
    graph = Broken(v)
    true = v @ v.T >= 0.93
    if same:
        np.fill_diagonal(true, False)
    assert (embedding_dedup.asked(graph, graph, same, 0.93) == true).all()


def test_rows_that_share_an_id_are_one_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)]
    got = sorted((r.vec_id, r.component_id) for r in embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_signatures_lose_no_holder(spark):
    """Of any item, with as many shingles missing as may be, a document has as many signature values as are asked for."""
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 14, 20, 21, 37, 120, 400])]
    for r in decontaminate.signatures(spark.createDataFrame(items, "item_id int, text string"), "item_id", "text", 5, 0.8).collect():
        q = len(r.shingles)
        missing = q - -(-8 * q // 10)
        assert 2 ** (r.part - 1) < q <= 2**r.part and r.need >= 1
        assert r.need == len(r.signature) - missing and len(r.signature) <= q


def test_leaks_of_very_long_and_clashing_rows(spark):
    rng = random.Random(3)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(100_000))
    rows = [(1, long + " " + item, 1, "a", "x"), (1, long + " " + item, 1, "a", "x"), (2, long, None, "a", "x"), (3, None, 2, "b", "y")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _t1 int, leaks string, near string")
    got = decontaminate.find_leaks(df, "text", spark.createDataFrame([(7, item)], "item_id int, text string"))
    assert sorted(got.columns) == sorted(df.columns)
    assert sorted((r.doc_id, [tuple(x) for x in r.leaks], r._t1 or 0, r.near) for r in got.collect()) == [(1, [(7, 1.0)], 1, "x"), (1, [(7, 1.0)], 1, "x"), (2, [], 0, "x"), (3, [], 2, "y")]


def test_links_that_the_graph_misses_are_added(monkeypatch):
    """A graph that finds nothing leaves no link out: neither within a shard nor between two."""
    rng = np.random.default_rng(31)
    v = hnsw.unit(np.repeat(rng.normal(size=(40, 24)), 5, 0) + rng.normal(size=(200, 24)) * 0.15)
    monkeypatch.setattr(embedding_dedup, "asked", lambda ours, theirs, same, least: np.zeros((len(ours.vectors), len(theirs.vectors)), bool))
    dumped = lambda rows, at, shard: {"shard": shard, "nodes": np.arange(at, at + len(rows)), "weights": np.ones(len(rows), np.int64), "graph": hnsw.Graph(rows).dump()}
    true = v @ v.T >= 0.93
    np.fill_diagonal(true, False)
    one = embedding_dedup._linker(0.93)(pd.DataFrame([dumped(v, 0, 0)]))
    assert one["links"].tolist() == true.sum(axis=1).tolist() and true.any()
    two = embedding_dedup._linker(0.93)(pd.DataFrame([dumped(v[:92], 0, 0), dumped(v[92:], 92, 1)]))
    across = true.copy()
    across[:92, :92] = across[92:, 92:] = False
    assert two["links"].tolist() == across.sum(axis=1).tolist() and across.any()
