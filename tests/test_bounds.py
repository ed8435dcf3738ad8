"""Steps whose work must follow the input: what meets in a join, and how many rows a task gets."""

import itertools
import random
from collections import Counter

from weftline.operators import content, drift
from weftline.plans import stages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def walked(anchors, changes):
    """Every change an anchor meets, one after the other."""
    found = []
    for i, path, since in anchors:
        todo = [(path, since)]
        while todo:
            p, s = todo.pop()
            later = [c for c in changes if c[2] == p and c[0] > s]
            end = min((c[0] for c in later if c[1] in ("renamed", "deleted")), default=None)
            met = [c for c in later if end is None or c[0] <= end]
            found += [(i, c[0], p, c[1], c[3]) for c in met if c[1] != "copied"]
            todo += [(c[3], end) for c in met if c[1] == "renamed" and c[0] == end]
    return Counter(found)


def test_trails_meet_changes_by_segment(spark):
    """Equal to a walk, with anchors and changes joined on the segment that a path's next move ends."""
    r = random.Random(3)
    paths = [f"p{k}" for k in range(6)]
    ops = ["modified"] * 4 + ["copied", "deleted", "renamed", "renamed"]
    changes = [(r.randrange(1, 80), r.choice(ops), r.choice(paths), r.choice(paths)) for _ in range(120)]
    anchors = [(i, r.choice(paths), r.randrange(0, 80)) for i in range(60)]
    table = spark.createDataFrame([(*c, None) for c in changes], f"seq long, op string, from_path string, to_path string, hunks {drift.HUNKS}")
    found = drift.trails(spark.createDataFrame(anchors, "anchor_id long, path string, seq long"), table)
    assert Counter((x.anchor_id, x.seq, x.path, x.op, x.to_path) for x in found.collect()) == walked(anchors, changes)
    joins = [line for line in plan(found).splitlines() if "Join Inner" in line]
    assert joins and all("segment" in line for line in joins)


def test_lines_of_a_task_follow_their_number(spark, monkeypatch):
    """Changed places are found by as many tasks as their number asks for, and are the same."""
    rows = [(f"f{k % 3}", s, [r % (s + k + 1) for r in range(5 + s % 4)]) for k, s in itertools.product(range(3), range(20))]
    contents = spark.createDataFrame(rows, f"path string, seq long, lines {content.LINES}").dropDuplicates(["path", "seq"])
    told = lambda: {tuple(x) for x in content.line_changes(contents, 400).collect()}
    one = told()
    monkeypatch.setattr(stages, "ROWS_A_TASK", 20)
    few = content.line_changes(contents, 400)
    assert few.rdd.getNumPartitions() >= 20 and told() == one


def test_anchors_without_a_path_are_apart(spark):
    rows = spark.createDataFrame([(i, None if i < 50 else "a") for i in range(60)], "anchor_id long, path string")
    keys = Counter(x[0] for x in rows.select(content._place("path")).collect())
    assert keys.pop("a") == 10 and set(keys.values()) == {1} and len(keys) == 50


def test_lagged_pairs_send_files_once(spark, monkeypatch):
    """Equal to all pairs of commits over several blocks, and pairs are counted where their arrays are, without a shuffle of pairs."""
    import datetime

    from weftline.operators import mining

    monkeypatch.setattr(mining, "POSITIONS_A_BLOCK", 4, raising=False)
    r = random.Random(5)
    first = datetime.datetime(2020, 1, 1)
    commits = [(c, first + datetime.timedelta(hours=r.randrange(1500))) for c in range(60)]
    files = [(c, f) for c in range(55) for f in r.sample(range(8), r.randrange(1, 4))]
    found = mining.lagged_pairs(spark.createDataFrame(files, "commit_id long, file long"), spark.createDataFrame(commits, "commit_id long, ts timestamp"))
    order = sorted((t, c) for c, t in commits if c < 55)
    of = lambda c: [f for k, f in files if k == c]
    want = Counter((a, b) for i, (t, c) in enumerate(order) for u, d in order[i + 1 : i + 6] if (u - t).total_seconds() <= 7 * 86400 for a in of(c) for b in of(d) if a != b)
    assert {(x.earlier, x.later): x.n for x in found.collect()} == want
    assert "Join" not in plan(found).split("Generate")[0]


def test_reviewers_of_files_go_in_arrays(spark, monkeypatch):
    """Equal to the plain sets with arrays of a few files, and no join makes the pairs that are counted."""
    from weftline.operators import mining

    monkeypatch.setattr(mining, "FILES_AN_ARRAY", 3, raising=False)
    r = random.Random(6)
    rows = [(f, p) for f in range(25) for p in {0, *r.sample(range(12), r.randrange(0, 6))}] + [(3, None), (None, 2)]
    found = mining.reviewer_overlap(spark.createDataFrame(rows, "file long, reviewer long"), jaccard=0.3)
    sets = {f: {p for k, p in rows if k == f} for f in range(25)}
    want = {}
    for a, b in itertools.combinations(range(25), 2):
        both = len((sets[a] & sets[b]) - {None})
        if both >= 2 and both / (len(sets[a]) + len(sets[b]) - both) >= 0.3:
            want[a, b] = (both, round(both / (len(sets[a]) + len(sets[b]) - both), 9))
    assert want and {(x.a, x.b): (x.shared, round(x.jaccard, 9)) for x in found.collect()} == want
    assert "Generate explode" in plan(found)


def asked_of(anchors, targets):
    """Targets' lines one by one: anchors (set, id, path, start, end, whole), targets (id, path, start, end)."""
    meets = lambda a, t: a[0] is not None and a[2] == t[1] and (t[2] is None or a[5] or a[3] <= t[3] and a[4] >= t[2])
    sets = {(t[0], a[0]) for t in targets for a in anchors if meets(a, t)}
    line = lambda a: f"{a[0]}\t{a[2]}\t{'0-0' if a[5] else f'{a[3]}-{a[4]}'}"
    lines = Counter()
    for t in targets:
        lines.update([(t[0], line(a)) for a in anchors if (t[0], a[0]) in sets] or [(t[0], "no sets")])
    return sets, lines


def test_lines_of_a_target_are_made_where_they_stay(spark, monkeypatch):
    """Equal to one target after the other; nothing shuffles the lines, and those of one set are made by many tasks."""
    from weftline.operators import catalog

    monkeypatch.setattr(catalog, "TARGETS_A_PART", 3, raising=False)
    monkeypatch.setattr(catalog, "LINES_A_PART", 4, raising=False)
    r = random.Random(8)
    anchors, targets = [], []
    for i in range(90):
        s, whole = r.randrange(1, 30), i % 7 == 0
        anchors.append((r.choice(["big"] * 6 + ["a", "b", None]), i, r.choice("xyz"), None if whole else s, None if whole else s + r.randrange(4), whole))
    anchors += anchors[:20] + [("alone", 200, "w", None, None, True), (None, 201, "v", 1, 2, False)]
    for i in range(80):
        s = None if i % 5 == 0 else r.randrange(1, 30)
        targets.append((i, r.choice(["x", "y", "z", "u", "v", "w", None]), s, None if s is None else s + 3))
    targets += targets[:10]
    a = spark.createDataFrame(anchors, "set_name string, anchor_id long, path string, start long, end long, whole boolean")
    t = spark.createDataFrame(targets, "query_id long, path string, start long, end long")
    sets, lines = asked_of(anchors, targets)
    assert sets == {tuple(x) for x in catalog.matches(a.where("set_name IS NOT NULL"), t).collect()}
    found = catalog.point_queries(a, t)
    assert Counter(tuple(x) for x in found.collect()) == lines and lines[0, "no sets"] + lines[1, "no sets"] < len(lines)
    assert plan(found).startswith("Generate explode")
    tasks = Counter(x[0] for x in found.where("line LIKE 'big%'").selectExpr("spark_partition_id()").collect())
    assert len(tasks) > 8 and max(tasks.values()) < sum(tasks.values()) / 3


def test_a_range_is_compared_once(spark):
    """Targets that ask for the same and anchors of a set that hold the same meet once."""
    from weftline.operators import catalog

    a = spark.range(300).selectExpr("'s' AS set_name", "id AS anchor_id", "'x' AS path", "1L AS start", "5L AS end", "false AS whole")
    t = spark.range(300).selectExpr("id AS query_id", "'x' AS path", "4L AS start", "9L AS end")
    found = catalog.matches(a, t)
    assert found.count() == 300
    found.collect()
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            todo.append(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
            continue
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert made and sum(made) <= 301
