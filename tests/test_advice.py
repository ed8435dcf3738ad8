"""What sessions are told."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import advice as A


def test_touched_sets(spark):
    anchors = spark.createDataFrame([("s", 0, "a0", "p", 10, 20, False), ("s", 1, "a1", "p", None, None, True), ("t", 0, "b0", "q", 1, 2, False)], "set_name string, anchor_no int, anchor_id string, path string, start long, end long, whole boolean")
    touches = spark.createDataFrame([("x", 0, "q", "added", None, None), ("x", 1, "p", "modified", 15, 16), ("x", 2, "p", "modified", None, None)], "sid string, line_no long, path string, kind string, start long, end long")
    assert [tuple(r) for r in A.touched_sets(touches, anchors).collect()] == [("x", "s", 1, "a0")]


def test_tree_changes(spark):
    before = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1), ("d", "4", 1)], "path string, blob string, mode int")
    after = spark.createDataFrame([("a", "1", 2), ("b", "9", 1), ("e", "3", 1), ("f", "5", 1)], "path string, blob string, mode int")
    assert {tuple(r) for r in A.tree_changes(before, after).collect()} == {("a", "mode", None), ("b", "modified", None), ("d", "deleted", None), ("f", "added", None), ("e", "renamed", "c")}


def test_capped_clusters(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "b", "c"), (4, "d", "e")], "rank int, a string, b string")
    assert {r.node: r.cluster for r in A.capped_clusters(pairs, 3).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def test_structural_and_surfaced(spark):
    files = spark.createDataFrame([("src/parser.py", "x"), ("src/lexer.py", "import parser"), ("z.py", None)], "path string, text string")
    pairs = spark.createDataFrame([("src/parser.py", "src/lexer.py"), ("src/parser.py", "z.py")], "a string, b string")
    assert {r.b: r.structural for r in A.structural_pairs(pairs, files).collect()} == {"src/lexer.py": True, "z.py": False}
    part = "array<struct<path:string>>"
    shown = spark.createDataFrame([("s", "0,1", "high", [("a",), ("b",)]), ("s", "1,2", "low", [("a",)]), ("s", "3,4", "high+", [("gone",)]), ("t", "0,1", "high", [("a",), ("b",)])], f"sid string, key string, band string, participants {part}")
    seen = spark.createDataFrame([("t", "0,1")], "sid string, key string")
    deleted = spark.createDataFrame([("gone",)], "path string")
    assert [(r.sid, r.key) for r in A.surfaced(shown, seen, deleted, files).collect()] == [("s", "0,1")]
    assert spark.range(1).select(A.fingerprint(F.lit(1), F.lit(None)).alias("f")).first().f != spark.range(1).select(A.fingerprint(F.lit(None), F.lit(1)).alias("f")).first().f


@pytest.mark.parametrize("most", [2, 5])
def test_capped_clusters_as_one_pass(spark, most):
    r = random.Random(most)
    rows = [(r.randrange(25), *(f"n{r.randrange(40)}" for _ in "ab")) for _ in range(160)]
    rows += [(50 + i, f"m{i}", f"m{i + 1}") for i in range(12)]
    of = {x: {x} for row in rows for x in row[1:]}
    for _, a, b in sorted(rows):
        if of[a] is not of[b] and len(of[a]) + len(of[b]) <= most:
            both = of[a] | of[b]
            for x in both:
                of[x] = both
    want = {x: min(c) for x, c in of.items() if len(c) > 1}
    assert {x.node: x.cluster for x in A.capped_clusters(spark.createDataFrame(rows, "rank int, a string, b string"), most).collect()} == want


def _one_pass(rows, most):
    of = {x: {x} for row in rows for x in row[1:]}
    for _, a, b in sorted(rows):
        if of[a] is not of[b] and len(of[a]) + len(of[b]) <= most:
            both = of[a] | of[b]
            for x in both:
                of[x] = both
    return {x: min(c) for x, c in of.items() if len(c) > 1}


def test_capped_clusters_by_parts(spark, monkeypatch):
    """Pairs cut into many parts, equal ranks and a hub among them."""
    monkeypatch.setattr(A, "IN_ORDER", 60)
    r = random.Random(4)
    rows = [(r.randrange(3), *(f"n{r.randrange(50)}" for _ in "ab")) for _ in range(260)] + [(1, "hub", f"n{i}") for i in range(50)]
    found = A.capped_clusters(spark.createDataFrame(rows, "rank int, a string, b string"), 6)
    assert {x.node: x.cluster for x in found.collect()} == _one_pass(rows, 6)


def test_capped_clusters_of_a_path(spark):
    """A path of ever later pairs, each waiting for the one before, takes no round of jobs for each."""
    rows = [(i, f"m{i:03}", f"m{i + 1:03}") for i in range(60)]
    pairs = spark.createDataFrame(rows, "rank int, a string, b string")
    spark.sparkContext.setJobGroup("path", "")
    try:
        found = A.capped_clusters(pairs, 7)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("path")) < 40
    assert {x.node: x.cluster for x in found.collect()} == _one_pass(rows, 7)


def test_touched_sets_against_all_pairs(spark):
    """Equal touches of many sessions, whole files and open ranges."""
    import random

    r = random.Random(2)
    span = lambda: (None, None) if r.random() < 0.2 else (s := r.randrange(1, 20), s + r.randrange(5))
    touches = [(r.choice("xyz"), i, r.choice("pq"), r.choice(["modified", "added"]), *span()) for i in range(120)]
    anchors = [(r.choice("stu"), i, f"a{i}", r.choice("pq"), *((None, None, True) if i % 5 == 0 else (*(s := r.randrange(1, 20), s + 2), False))) for i in range(25)]
    want = {}
    for sid, no, path, kind, s, e in touches:
        for name, at, anchor, p, a, b, whole in anchors:
            if kind != "added" and path == p and (s is None or (not whole and a <= e and b >= s)):
                want[sid, name] = min(want.get((sid, name), (no, at, anchor)), (no, at, anchor))
    t = spark.createDataFrame(touches, "sid string, line_no long, path string, kind string, start long, end long")
    a = spark.createDataFrame(anchors, "set_name string, anchor_no long, anchor_id string, path string, start long, end long, whole boolean")
    assert {(x["sid"], x["set_name"]): (x["touch_no"], x["anchor_id"]) for x in A.touched_sets(t, a).collect()} == {k: (v[0], v[2]) for k, v in want.items()}


def test_overlapping_sets_carry_no_lists(spark):
    """Sets are met by a digest of their paths: the join of anchors has no list in its rows."""
    from weftline.operators import catalog

    rows = [("a", "p", 1, 5), ("a", "q", 1, 2), ("b", "q", 2, 3), ("b", "p", 8, 9), ("c", "p", 1, 9), ("d", "q", 5, 6), ("d", "p", 20, 21)]
    anchors = spark.createDataFrame([(*r, False) for r in rows], "set_name string, path string, start long, end long, whole boolean")
    met = catalog.overlapping_sets(anchors)
    assert [tuple(r) for r in met.collect()] == [("a", "b")]
    assert "sha2" in met._jdf.queryExecution().optimizedPlan().toString()
