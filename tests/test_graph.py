"""Ancestry by chains against sets of ancestors."""

import random

import pytest

from weftline.operators import graph

KIND = "commit_id long, place int, parent long"


def history(r, n, merges):
    parents = {0: []}
    for c in range(1, n):
        near = range(max(0, c - 8), c)
        parents[c] = r.sample(near, min(len(near), 2 if r.random() < merges else 1)) if r.random() > 0.01 else []
    return parents


def rows(parents):
    return [(c, i, p) for c, ps in parents.items() for i, p in enumerate(ps or [None])]


def above(parents):
    found = {}
    for c in sorted(parents):
        found[c] = {c}.union(*(found[p] for p in parents[c]))
    return found


@pytest.mark.parametrize("seed,merges", [(1, 0.6)])
def test_random(spark, seed, merges):
    r = random.Random(seed)
    parents = history(r, 150, merges)
    known = above(parents)
    table = spark.createDataFrame(rows(parents), KIND)
    a = graph.Ancestry(table)
    pairs = [(r.randrange(150), r.randrange(150)) for _ in range(400)] + [(5, 5), (999, 3), (3, 999)]
    told = {(r["ancestor"], r["commit_id"]): r["is_ancestor"] for r in a.is_ancestor(spark.createDataFrame(pairs, "ancestor long, commit_id long")).collect()}
    assert told == {(x, y): x in known[y] if x in known and y in known else None for x, y in pairs}

    bases = {tuple(r) for r in a.merge_bases(spark.createDataFrame(sorted(set(pairs)), "a long, b long")).collect()}
    want = set()
    for x, y in pairs:
        common = known.get(x, set()) & known.get(y, set())
        want |= {(x, y, c) for c in common if not any(c in known[d] for d in common - {c})} or {(x, y, None)}
    assert bases == want

    side = {(r["commit_id"], r["side"]) for r in a.side_commits(graph.merges_of(table)).collect()}
    assert side == {(c, s) for c, ps in parents.items() for p in ps[1:] for s in known[p] - known[ps[0]]}
    anchors = spark.createDataFrame([(i, c) for i, c in enumerate([*range(0, 150, 3), 999])], "anchor_id int, commit_id long")
    kept = {r["commit_id"] for r in graph.set_since(anchors, a, 20).collect()}
    assert kept == {c for c in range(0, 150, 3) if 20 in known[c]} | {999}


def test_long_chain(spark):
    """2000 commits on one line, a branch merged back at every tenth: few rounds, the same answers."""
    parents = {c: ([c - 1] if c else []) for c in range(2000)}
    for c in range(10, 2000, 10):
        parents[10_000 + c] = [c - 7]
        parents[c] = [c - 1, 10_000 + c]
    a = graph.Ancestry(spark.createDataFrame(rows(parents), KIND))
    pairs = [(10_500, 1999), (10_500, 499), (3, 10_500), (1500, 1400), (0, 1999)]
    told = {(r["ancestor"], r["commit_id"]): r["is_ancestor"] for r in a.is_ancestor(spark.createDataFrame(pairs, "ancestor long, commit_id long")).collect()}
    assert [told[p] for p in pairs] == [True, False, True, False, True]
    base = a.merge_bases(spark.createDataFrame([(10_500, 10_600), (1999, 10_600)], "a long, b long")).collect()
    assert {(r["a"], r["b"]): r["base"] for r in base} == {(10_500, 10_600): 10_500, (1999, 10_600): 10_600}


def test_side_branches_of_a_main_line(spark):
    """What lies beside the main line is walked to where it left that line; what the line merged before isn't listed again."""
    parents = {c: ([c - 1] if c else []) for c in range(300)}
    for c in range(10, 300, 2):
        parents[1000 + c] = [c - 7]
        parents[c] = [c - 1, 1000 + c]
    a = graph.Ancestry(spark.createDataFrame(rows(parents), KIND))
    assert a.beside.count() == 145  # the old labels had a row for each branch that a commit reaches, over 20 000
    known = {}
    for c in sorted(parents, key=lambda x: x % 1000 - (x >= 1000) / 2):
        known[c] = {c}.union(*(known[p] for p in parents[c]))
    pairs = [(x, y) for x in [*range(3, 300, 29), *range(1010, 1300, 30)] for y in [7, 150, 299, 1150, 1298]]
    told = {(r["ancestor"], r["commit_id"]): r["is_ancestor"] for r in a.is_ancestor(spark.createDataFrame(pairs, "ancestor long, commit_id long")).collect()}
    assert told == {(x, y): x in known[y] for x, y in pairs}
