"""Conversation repair against every possible audit of small conversations, and against strings for longer ones."""

import hashlib
import itertools
import random
import re

from caselattice.llm import turn_repair

ROLES = {"u": "user", "a": "assistant"}


def faults_of(rows):
    seen, found = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def apply(audit, rows, faults):
    """(cost, repaired) of an audit, or None where it is not allowed; a wanted role is the only one that fits."""
    cost, out, at, initials = 0, [], 0, ""
    for edit in audit:
        wanted = "u" if not initials or initials[-1] in "sa" else "a"
        if edit == "I":
            cost, initials = cost + 2, initials + wanted
            out.append((ROLES[wanted], ""))
            continue
        role, text = rows[at]
        if edit == "D":
            cost += 3
        elif faults[at] in ("blank", "duplicate"):
            return None
        else:
            cost += (edit == "R") * 2 + (faults[at] == "truncated")
            initials += wanted if edit == "R" else role[:1] or "?"
            out.append((ROLES[wanted] if edit == "R" else role, text))
        at += 1
    return (cost, out) if re.fullmatch("(s?(ua)+)?", initials) else None


def every_audit(rows):
    faults, best = faults_of(rows), None
    for parts in itertools.product(["", "I", "II", "III"], *[[n + e for n in ("", "I", "II") for e in "DKR"] for _ in rows]):
        audit = "".join(parts[1:]) + parts[0]
        done = apply(audit, rows, faults)
        if done and (best is None or (done[0], audit) < best[:2]):
            best = (done[0], audit, done[1])
    return best


def by_strings(rows):
    """As every_audit, keeping the least string for each last role."""
    faults, layer = faults_of(rows), {"": (0, "")}
    for (role, _), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit) in layer.items():
            for n in range(3):
                at = state
                for _ in range(n):
                    at = "u" if at in ("", "s", "a") else "a"
                wanted = "u" if at in ("", "s", "a") else "a"
                options = [(3, "D", at)]
                if fault not in ("blank", "duplicate"):
                    options.append((2 + (fault == "truncated"), "R", wanted))
                    if role[:1] == wanted or (role[:1] == "s" and at == ""):
                        options.append((fault == "truncated", "K", role[:1]))
                for more, edit, to in options:
                    entry = (cost + 2 * n + more, audit + "I" * n + edit)
                    after[to] = min(after.get(to, entry), entry)
        layer = after
    cost, audit = min((c + {"": 0, "s": 4, "u": 2, "a": 0}[s], a + {"": "", "s": "II", "u": "I", "a": ""}[s]) for s, (c, a) in layer.items())
    return cost, audit, apply(audit, rows, faults)[1]


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "agent"]
    return [(rng.choice(roles), rng.choice(["a.", "b", " ", "", "c! ", "d?\n", "e\x00"] + [f"t{rng.random()}." for _ in range(6)])) for _ in range(n)]


def test_macros_are_prefix_free_and_in_order():
    assert turn_repair.MACROS == sorted(turn_repair.MACROS) and len(turn_repair.MACROS) == 9
    assert not any(a != b and b.startswith(a) for a in turn_repair.MACROS for b in turn_repair.MACROS)


def test_layers_find_the_cheapest_least_audit():
    rng = random.Random(3)
    search = turn_repair.Layers()
    for k in range(400):
        rows = some_rows(rng, rng.randint(0, 4) if k < 120 else rng.randint(5, 60))
        kinds = [turn_repair._kind(r, {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (r, _), f in zip(rows, faults_of(rows))]
        layer, cost, back = search.run(kinds, turn_repair.NOTHING)
        exit = turn_repair.chosen_end(layer)
        want = every_audit(rows) if k < 120 else by_strings(rows)
        assert (cost + layer[exit][0] + turn_repair._ENDS[exit][0], *turn_repair.edited(back, kinds, rows, exit, True)) == want
    assert len(search.layers) < 400


def hand_row(conv, turns):
    rows = [(r, t) for _, r, t in turns]
    faults = faults_of(rows)
    at = [t for t, _, _ in turns if t is not None]
    cost, audit, repaired = by_strings(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def test_repair_equals_strings_however_it_is_cut(spark, monkeypatch):
    rng = random.Random(9)
    given, want = [], []
    for conv in [None, *range(40)]:
        rows, turn = some_rows(rng, 0 if conv == 39 else rng.choice([1, 3, 9, 40]) if conv else 300), 0
        turns = []
        for role, text in rows:
            turn += rng.choice([1, 1, 1, 4])
            turns.append((turn, role, text))
        given += [(conv, *t, rng.choice([1, 1, 1, 0, 2])) for t in turns] if turns else [(conv, 5, "user", "x", 0)]
        kept = [t for *t, n in [r[1:] for r in given if r[0] == conv] for _ in range(n)]
        want.append(hand_row(conv, kept))
    rng.shuffle(given)
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, copies int").selectExpr("*", "1 AS piece", "2 AS cost").repartition(3)
    for piece in (4096, 3):
        monkeypatch.setattr(turn_repair, "PIECE", piece)
        pieces = turn_repair.repair(df, "conv_id", "turn", "role", "text", "copies")
        assert sorted(map(repr, map(tuple, turn_repair.digests(pieces).collect()))) == sorted(map(repr, want))
    assert pieces.where("NOT whole").count() > 100
    assert turn_repair.digests(turn_repair.repair(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0


def test_repair_of_nulls_ties_and_long_texts(spark):
    long = "x" * 5_000_000 + "."
    given = [(1, None, "user", "b."), (1, None, "user", "a."), (1, 2, None, None), (1, 3, "assistant", long), (2, None, None, None), (None, 1, "user", long), (None, 1, "user", long)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r) for r in turn_repair.digests(turn_repair.repair(df, "conv_id", "turn", "role", "text")).collect()}
    assert got[1] == hand_row(1, [(None, "user", "a."), (None, "user", "b."), (2, " ", " "), (3, "assistant", long)])
    assert got[2] == hand_row(2, [(None, " ", " ")]) and got[None] == hand_row(None, [(1, "user", long)] * 2)
