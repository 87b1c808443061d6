"""Queries against brute force over every row of the given tables, not over the rows that a query's SQL keeps."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (it registers the queries)
from caselattice.plans.registry import QUERIES
from caselattice.sources import views as X
from caselattice.sources.views import ITEM_SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "lineitem customer events documents conversations labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(spark, sf, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect())


def test_every_item_has_its_subsets(spark, sf, duck):
    items = duck.execute(f"WITH {ITEM_SQL} SELECT item_id, k FROM items").fetchall()
    want = [(i, mask, mask.bit_count()) for i, k in items for mask in range(1, 2**k) if 2 * mask.bit_count() >= k]
    assert rows(spark, sf, "arr02_constraint_subsets", "item_id", "mask", "size") == sorted(want)


def test_every_item_has_a_label_in_turn(spark, sf, duck):
    seen, want = {}, []
    for i, cl in duck.execute(f"WITH {ITEM_SQL} SELECT item_id, cl FROM items ORDER BY item_id").fetchall():
        want.append((i, cl, "ABCD"[seen.get(cl, 0) % 4]))
        seen[cl] = seen.get(cl, 0) + 1
    assert rows(spark, sf, "win09_round_robin", "item_id", "cl", "label") == want


def brute_controls(spark, sf):
    seen = {}
    for r in X.runs(spark, sf).collect():
        seen.setdefault((r.item_id, r.model_alias, r.cl, r.il), []).append((r.answer, r.correct))
    full = {k: [c for _, c in v] for k, v in seen.items() if len(v) == 3 and all(a is not None for a, _ in v)}
    controls = [k for k, v in full.items() if all(v)]
    want = []
    for i, m, cl, il in (k for k, v in full.items() if not any(v)):
        near = min((((cl != c[2]) + (il != c[3]), c[0]) for c in controls if c[1] == m), default=(None, None))
        want.append((i, m, near[1]))
    return want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_every_stable_wrong_item_meets_all_controls(spark, sf, folder):
    at = sf.replace("sf0.001", folder)
    got = {(r.item_id, r.model_alias): r.control_id for r in QUERIES["jon16_matched_controls"](spark, at).collect()}
    want = {(i, m): c for i, m, c in brute_controls(spark, at)}
    assert got == want and want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_controls_are_used_once(spark, sf, folder):
    at = sf.replace("sf0.001", folder)
    seen = {}
    for r in X.runs(spark, at).collect():
        seen.setdefault((r.model_alias, r.item_id, r.cl, r.il), []).append((r.answer, r.correct))
    full = {k: [c for _, c in v] for k, v in seen.items() if len(v) == 3 and all(a is not None for a, _ in v)}
    free, want = {k for k, v in full.items() if all(v)}, {}
    for m, i, cl, il in sorted(k for k, v in full.items() if not any(v)):
        near = min((((cl != c[2]) + (il != c[3]), c[1], c) for c in free if c[0] == m), default=None)
        want[m, i] = near and near[1]
        if near:
            free.remove(near[2])
    got = {(r.model_alias, r.item_id): r.control_id for r in QUERIES["jon16b_controls_used_once"](spark, at).collect()}
    assert got == want and len(set(want.values())) > 1


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_no_item_is_without_a_row(spark, sf, folder):
    at = sf.replace("sf0.001", folder)
    con = duckdb.connect()
    ids = con.execute(f"SELECT c_custkey FROM '{at}/customer.parquet' UNION SELECT user_id FROM '{at}/events.parquet'").fetchall()
    want = {i: [0, 0] for (i,) in ids}
    for r in X.runs(spark, at).collect():
        want[r.item_id][0] += 1
        want[r.item_id][1] += r.correct
    got = {r.item_id: [r.n_runs, r.n_correct] for r in QUERIES["jon02_items_without_runs"](spark, at).collect()}
    assert got == want and any(n == 0 for n, _ in got.values())


def test_turns_are_rendered_whole(spark, sf, duck):
    said = {}
    for c, turn, role, text in duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        said.setdefault(c, []).append((turn, f"{role}: {text}"))
    want = sorted((c, " | ".join(x for _, x in sorted(turns))) for c, turns in said.items())
    assert rows(spark, sf, "scl12_rendered_turns", "conv_id", "rendered") == want


def test_stable_controls_are_right_throughout(spark, sf, tmp_path):
    answers = {u: [u % 4] * 3 for u in (2, 3, 4, 6, 8, 10, 14, 16)}  # 3 is of the other family, 6 is vulnerable
    answers |= {20: [1, 1, 1], 22: [4, 4, 4], 26: [0, 2, 2]}  # wrong, unparsed, corrected
    rows = [(u, kind, run, 5 * run + a) for u, given in answers.items() for kind in ("click", "purchase", "view") for run, a in enumerate(given)]
    made = spark.createDataFrame(rows, "user_id long, event_type string, run int, k int")
    shaped = made.select((F.col("user_id") * 100 + F.ascii("event_type") * 10000 + F.col("run")).alias("event_id"), F.timestamp_seconds("run").alias("ts"), "user_id", "event_type", F.format_string('{"k": %d}', "k").alias("props"))
    shaped.write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in QUERIES["flt18_stable_controls"](spark, str(tmp_path)).orderBy("item_id").collect()]
    assert got == [(u, "f0") for u in (2, 4, 8, 10, 14)]


def test_high_priority_needs_a_single_violation(spark, sf):
    seen = {}
    for r in X.runs(spark, sf).collect():
        seen.setdefault(r.item_id, []).append(r)
    want = {}
    for i, six in seen.items():
        mixed = 0 < sum(r.correct for r in six) < len(six)
        several = len({r.answer for r in six} - {None}) >= 2
        single = any((ord(r.answer) - ord(r.gold_answer)) % 4 == 1 for r in six if r.answer)
        want[i] = ("high" if several and single else "medium") if mixed else "low"
    assert {r.item_id: r.priority for r in QUERIES["prj06_priority"](spark, sf).collect()} == want


def bounds(key, clusters, resamples):
    rates = []
    for r in range(resamples):
        drawn = [clusters[int(hashlib.md5(f"17|{key}|{r}|{d}".encode()).hexdigest()[:8], 16) % len(clusters)] for d in range(len(clusters))]
        if below := sum(b for _, b in drawn):
            rates.append(sum(t for t, _ in drawn) / below)
    rates.sort()
    return pytest.approx(tuple(rates[int(p * (len(rates) - 1))] for p in (0.025, 0.975)), abs=2e-6)


def test_sources_are_resampled_5000_times(spark, sf, duck):
    clusters = duck.execute("SELECT count(*) FILTER (quality = 1), count(*) FROM labels JOIN documents USING (doc_id) GROUP BY source ORDER BY source").fetchall()
    (got,) = QUERIES["agg37_source_quality_interval"](spark, sf).select("lower", "upper").collect()
    assert tuple(got) == bounds("all", clusters, 5000) and got.lower < got.upper


def test_items_are_resampled_1000_times(spark, sf):
    seen = {}
    for r in X.runs(spark, sf).collect():
        top, bottom = seen.setdefault(r.model_alias, {}).get(r.item_id, (0, 0))
        seen[r.model_alias][r.item_id] = (top + r.correct, bottom + (r.answer is not None))
    got = {r.model_alias: (r.lower, r.upper) for r in QUERIES["agg36_cluster_bootstrap"](spark, sf).collect()}
    assert got == {m: bounds(m, [x for _, x in sorted(items.items())], 1000) for m, items in seen.items()}


def test_tokens_of_texts_are_found_once(spark):
    from caselattice.operators import lexical

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(k, [f"t{k}", "x", "y"]) for k in range(6)], "text_id long, tokens array<string>").mapInArrow(counted, "text_id long, tokens array<string>")
    items = spark.createDataFrame([(0, ["t1", "x"]), (1, ["t2", "x", "y", "z"])], "item_id long, tokens array<string>")
    assert {(r.text_id, r.item_id) for r in lexical.overlapping(texts, items, 0.8).collect()} == {(1, 0), (2, 1)}
    assert seen.value == 6
