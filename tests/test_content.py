"""Drift from contents against a plain walk over every commit of a made-up history."""

import random

import pytest

from weftline.operators import content, diff

ANCHORS = "anchor_id int, path string, start long, end long, whole boolean, seq long"
CHANGES = "seq long, op string, from_path string, to_path string"


def fold(hunks, s, e):
    for os, oc, _, nc in hunks:
        d = nc - oc
        if oc == 0:
            s, e = (s + d, e + d) if os < s else (s, e) if os >= e else (s, e + d)
        elif os + oc - 1 < s:
            s, e = s + d, e + d
        elif os <= e:
            s, e = max(min(s, os), 1), max(os if nc == 0 else os + nc - 1, e + d)
    return max(s, 1), max(e, max(s, 1))


def history(r, commits):
    """A repository's commits: versions, changes, and the tree after each."""
    trees, versions, changes, tree = {}, [], [], {}
    for seq in range(1, commits + 1):
        tree = dict(tree)
        path = r.choice(sorted(tree)) if tree else None
        act = r.choice(["add", "edit", "edit", "edit", "edit", "rename", "delete"]) if path else "add"
        edited = [x for x in tree[path] if r.random() < 0.97] if path else []
        for _ in range(r.randrange(2)):
            edited.insert(r.randrange(len(edited) + 1), r.choice("abcdef"))
        if act == "add":
            new = f"f{r.randrange(6)}"
            if new in tree:
                continue
            tree[new] = [r.choice("abcdefgh") for _ in range(r.randrange(2, 12))]
            versions.append((new, seq, tree[new]))
            changes.append((seq, "added", None, new))
        elif act == "edit" and edited != tree[path]:
            tree[path] = edited
            versions.append((path, seq, edited))
            changes.append((seq, "modified", path, path))
        elif act in ("rename", "delete"):
            old = tree.pop(path)
            versions.append((path, seq, None))
            new = f"g{seq}"
            if act == "rename":
                tree[new] = edited if r.random() < 0.5 else old
                versions.append((new, seq, tree[new]))
            changes.append((seq, f"{act}d", path, new if act == "rename" else path))
        trees[seq] = tree
    return trees, versions, changes, tree


def expected(anchor, trees, changes, head, layers):
    _, path, start, end, whole, since = anchor
    at, s, e, kind, locus = path, start, end, None, None
    cut = lambda lines, s, e: lines if whole or lines is None else lines[s - 1 : max(e, 0)]
    then = cut(trees[since][path], start, end)
    before, left = trees[since], False
    for seq, op, a, b in changes:
        if seq <= since:
            continue
        if at is not None and a == at and op != "added":
            if op == "deleted":
                at = None
            else:
                s, e = (s, e) if whole else fold(diff.hunks_of(before[a], trees[seq][b]), s, e)
                at = b
        if not whole and kind is None and not left and a == path and op != "added":
            old, new = before.get(path), trees[seq].get(path)
            if op in ("deleted", "renamed"):
                kind, locus = "orphaned", seq
            elif [old[i - 1 : i] for i in range(start, end + 1)] != [new[i - 1 : i] for i in range(start, end + 1)]:
                kind, locus = "changed", seq
        before = trees[seq]
    slices, below = [cut(head.get(at) if at else None, s, e)], dict(head)
    for layer in ("index", "worktree"):
        over = dict(below)
        for of, p, q, lines in layers:
            if of != layer:
                continue
            over.pop(p, None)
            if q:
                over[q] = lines
            if p == at:
                s, e = (s, e) if whole or q is None else fold(diff.hunks_of(below.get(p) or [], lines), s, e)
                at = q
        below = over
        slices.append(cut(below.get(at) if at else None, s, e))
    in_head, in_index, in_tree = slices
    deep = [("W", in_tree, in_index), ("I", in_index, in_head), ("H", in_head, then)]
    flat = [("I", in_index, then), ("W", in_tree, then), ("H", in_head, then)]
    sources = [n for n, x, y in (flat if whole else deep) if x != y]
    if at is None:
        status = "Changed"
    elif in_tree == then and at != path and path not in below and not whole:
        status = "Orphaned"
    elif in_tree == then:
        status = "Fresh" if at == path and (whole or (s, e) == (start, end)) else "Moved"
    else:
        status = "Changed"
    return (at, None if whole or at is None else s, None if whole or at is None else e, status, sources, kind, locus)


@pytest.mark.parametrize("seed", [1, 2])
def test_walk(spark, seed):
    r = random.Random(seed)
    trees, versions, changes, head = history(r, 40)
    layers, below = [], dict(head)
    for layer in ("index", "worktree"):
        for p in r.sample(sorted(below), min(3, len(below))):
            lines = [x for x in below[p] if r.random() < 0.95] + ["new"]
            q = r.choice([p, p, None, f"{layer}-{p}"])
            layers.append((layer, p, q, lines if q else None))
        for of, p, q, lines in layers:
            if of == layer:
                below.pop(p, None)
                if q:
                    below[q] = lines
    anchors = []
    for i in range(80):
        since = r.choice(sorted(s for s in trees if trees[s]))
        path = r.choice(sorted(trees[since]))
        n = max(1, len(trees[since][path]))
        start = r.randrange(1, n + 1)
        anchors.append((i, path, start, r.randrange(start, n + 1), i % 6 == 0, since))
    text = lambda lines: None if lines is None else "".join(f"{x}\n" for x in lines)
    found = content.resolve(
        spark.createDataFrame(anchors, ANCHORS),
        spark.createDataFrame([(p, s, text(t)) for p, s, t in versions], "path string, seq long, text string"),
        spark.createDataFrame(changes, CHANGES),
        spark.createDataFrame([(of, p, q, text(t)) for of, p, q, t in layers], "layer string, path string, to_path string, text string"),
    ).collect()
    assert len(found) == len(anchors)
    told = {r["anchor_id"]: (r["now_path"], r["now_start"], r["now_end"], r["status"], r["sources"], r["kind"], r["locus_seq"]) for r in found}
    for a in anchors:
        assert told[a[0]] == expected(a, trees, changes, head, layers), a
    assert len({t[3] for t in told.values()}) >= 2


def test_conflicts_and_nothing_else(spark):
    anchors = spark.createDataFrame([(1, "a", 1, 1, False, 1), (2, "b", 1, 1, False, 1)], ANCHORS)
    versions = spark.createDataFrame([("a", 1, "x\n"), ("b", 1, "y\n")], "path string, seq long, text string")
    none = spark.createDataFrame([], "layer string, path string, to_path string, text string")
    torn = spark.createDataFrame([("b",), ("b",)], "path string")
    found = content.resolve(anchors, versions, spark.createDataFrame([], CHANGES), none, conflicted=torn).collect()
    assert {r["anchor_id"]: r["status"] for r in found} == {1: "Fresh", 2: "MergeConflict"}
