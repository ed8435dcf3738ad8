"""Line differences against the longest common subsequence by dynamic programming."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import diff


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def put(old, new, hunks):
    out, at = [], 0
    for os, oc, ns, nc in hunks:
        i, j = os - (oc > 0), ns - (nc > 0)
        out += old[at:i] + new[j : j + nc]
        at = i + oc
    return out + old[at:]


@pytest.mark.parametrize("letters", [1, 2, 4, 30])
def test_fewest_edits(letters):
    r = random.Random(letters)
    for _ in range(400):
        old = [r.randrange(letters) for _ in range(r.randrange(25))]
        new = [r.randrange(letters) for _ in range(r.randrange(25))] if r.random() < 0.5 else [x for x in old if r.random() < 0.8]
        hunks = diff.hunks_of(old, new)
        assert put(old, new, hunks) == new
        common = longest(old, new)
        assert (sum(h[1] for h in hunks), sum(h[3] for h in hunks)) == (len(old) - common, len(new) - common)
        assert all(h[0] + h[1] < g[0] + (g[1] == 0) for h, g in zip(hunks, hunks[1:]))


def test_conventions():
    assert diff.hunks_of("abc", "abxc") == [(2, 0, 3, 1)]
    assert diff.hunks_of("abc", "ac") == [(2, 1, 1, 0)]
    assert diff.hunks_of("abc", "xbc") == [(1, 1, 1, 1)]
    assert diff.hunks_of("", "ab") == [(0, 0, 1, 2)]
    assert diff.hunks_of("ab", "") == [(1, 2, 0, 0)]
    assert diff.hunks_of("ab", "ab") == []


def test_long_texts_stay_cheap():
    old = [f"line {i}" for i in range(60_000)]
    assert len(diff.hunks_of(old, [f"other {i}" for i in range(60_000)])) == 1
    new = [x for i, x in enumerate(old) if i % 1000]
    assert sum(h[1] for h in diff.hunks_of(old, new)) == 60


def test_patch():
    old = [str(i) for i in range(1, 21)]
    new = ["0", *old[:9], "x", *old[10:]]
    hunks = diff.hunks_of(old, new)
    assert diff.patch_of(old, new, hunks) == "@@ -1,3 +1,4 @@\n+0\n 1\n 2\n 3\n@@ -7,7 +8,7 @@\n 7\n 8\n 9\n-10\n+x\n 11\n 12\n 13"
    assert diff.patch_of(["a"], [], diff.hunks_of(["a"], [])) == "@@ -1 +0,0 @@\n-a"
    assert diff.patch_of([], [], []) == ""


def test_columns(spark):
    rows = [(1, "a\nb\r\nc\n", "a\nc\nd\n"), (2, None, "x"), (3, "", None), (4, "same\n", "same")]
    pairs = spark.createDataFrame(rows, "id int, old_text string, new_text string").select("id", diff.text_lines("old_text").alias("old"), diff.text_lines("new_text").alias("new"))
    found = diff.with_patch(diff.with_hunks(pairs)).select("id", "new", "patch", diff.stat(F.col("hunks")).alias("s"), diff.applied(F.col("old"), F.col("new"), F.col("hunks")).alias("made")).orderBy("id").collect()
    assert all(r["made"] == r["new"] for r in found)
    assert [tuple(r["s"]) for r in found] == [(1, 1), (1, 0), (0, 0), (0, 0)]
    assert found[0]["patch"] == "@@ -1,3 +1,3 @@\n a\n-b\n c\n+d"


def test_a_batch_is_compared_by_steps():
    """However long a batch is, only some of its rows are Python objects at once."""
    import pyarrow as pa

    from weftline.operators import diff

    steps = list(diff._steps(iter([pa.record_batch({"i": list(range(1000))}), pa.record_batch({"i": pa.array([], pa.int64())})])))
    assert max(s.num_rows for s in steps) <= 64 and [i for s in steps for i in s["i"].to_pylist()] == list(range(1000))
