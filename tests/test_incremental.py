"""Incremental drift against resolving everything, over random changes of layers, conflicts and anchors."""

import random

from test_content import ANCHORS, CHANGES, history

from weftline.operators import content, incremental

LAYERS = "layer string, path string, to_path string, text string"


def joined(lines):
    return None if lines is None else "".join(f"{x}\n" for x in lines)


def layer_rows(r, head):
    rows, below = [], dict(head)
    for layer in ("index", "worktree"):
        for p in r.sample(sorted(below), min(2, len(below))):
            lines = [x for x in below[p] if r.random() < 0.9] + ["new"]
            q = r.choice([p, p, None, f"{layer}-{p}"])
            rows.append((layer, p, q, joined(lines) if q else None))
            below.pop(p)
            if q:
                below[q] = lines
    return rows


def anchor_rows(r, trees, n, first=0):
    out = []
    for i in range(first, first + n):
        since = r.choice(sorted(s for s in trees if trees[s]))
        path = r.choice(sorted(trees[since]))
        size = max(1, len(trees[since][path]))
        start = r.randrange(1, size + 1)
        out.append((i, path, start, r.randrange(start, size + 1), i % 6 == 0, since))
    return out


def test_update_is_what_resolving_all_gives(spark, monkeypatch):
    r = random.Random(7)
    trees, versions, changes, head = history(r, 30)
    v = spark.createDataFrame([(p, s, joined(t)) for p, s, t in versions], "path string, seq long, text string")
    c = spark.createDataFrame(changes, CHANGES)
    frame = lambda rows: spark.createDataFrame(rows, LAYERS)
    anchors, layers = anchor_rows(r, trees, 50), layer_rows(r, head)
    told = lambda df: sorted(map(str, df.collect()))
    base = incremental.baseline(spark.createDataFrame(anchors, ANCHORS), v, c, frame(layers), "head")
    redone, plain = [], incremental.affected
    monkeypatch.setattr(incremental, "affected", lambda *a: redone.append(plain(*a)) or redone[-1])
    torn = None
    for turn in range(3):
        if turn == 0:  # one entry goes
            layers = layers[1:]
        elif turn == 1:  # other layers, an anchor gone, two new ones, one that differs
            layers = layer_rows(r, head)
            anchors = [*anchors[2:], *anchor_rows(r, trees, 2, 100), *anchor_rows(r, trees, 1, anchors[1][0])]
        else:
            torn = spark.createDataFrame([(anchors[5][1],)], "path string")
        a = spark.createDataFrame(anchors, ANCHORS)
        base = incremental.update(base, a, v, c, frame(layers), "head", conflicted=torn)
        assert told(base.result()) == told(content.resolve(a, v, c, frame(layers), conflicted=torn))
        assert 0 < redone[-1].count() < len(anchors)
    assert any(x.status == "MergeConflict" for x in base.result().collect())


def test_nothing_changed_and_another_head(spark, monkeypatch):
    v = spark.createDataFrame([("a", 1, "x\n"), ("b", 1, "y\n")], "path string, seq long, text string")
    a = spark.createDataFrame([(1, "a", 1, 1, False, 1), (2, "b", 1, 1, False, 1)], ANCHORS)
    none, c = spark.createDataFrame([], LAYERS), spark.createDataFrame([], CHANGES)
    base = incremental.baseline(a, v, c, none, "one")
    marks = []
    monkeypatch.setattr(incremental, "_follow", lambda *x: marks.append(x) or 1 / 0)
    same = incremental.update(base, a, v, c, none, "one")  # the commits aren't read
    assert sorted(same.result().collect()) == sorted(base.result().collect()) and not marks
    monkeypatch.undo()
    later = v.union(spark.createDataFrame([("a", 2, "z\n")], v.schema))
    moved = spark.createDataFrame([(2, "modified", "a", "a")], CHANGES)
    assert {x.anchor_id: x.status for x in incremental.update(base, a, later, moved, none, "two").result().collect()} == {1: "Changed", 2: "Fresh"}


def test_query_is_what_content_drift_gives(spark):
    from weftline.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    told = lambda name: sorted(map(str, QUERIES[name](spark, sf).collect()))
    assert told("incremental_drift") == told("content_drift")
