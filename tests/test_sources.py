"""The history log is read by ranges and parsed in its rows; path indexes read only what can hold a path."""

import duckdb

from weftline.sources import history as H
from weftline.sources import path_index as X

DIFF = """diff --git a/src/a b/x.rs b/src/a b/x.rs
--- a/src/a b/x.rs
+++ b/src/a b/x.rs
@@ -3,2 +3 @@ fn outer()
-let Old_one = 1;
---counted nowhere
+struct Foo_bar { useful_Name, plain, let let fooo }
@@ -9 +8,0 @@
-diffuse
@@ -0,0 +20,3 @@
+const abc = MAX;
+fn main_loop
+  é_ok
diff --git a/node_modules/z.js b/node_modules/z.js
@@ -1 +1 @@
+fn hidden_name
diff --git a/bin b/bin
Binary files differ
"""


def record(commit, diff=DIFF, parents="p1 p2", body="two\nlines"):
    return H.RECORD + H.FIELD.join([commit, parents, "17", "m@x", "subject", body]) + H.HEADER_END + "\n\n" + diff


def put(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes("\n".join(records).encode())


def test_records_are_parsed(spark, tmp_path):
    put(tmp_path / "log", "a.log", record("c1"), record("c2", "", "", ""), H.RECORD + "bare", H.RECORD + "\n")
    commits = H.commits(H.records(spark, str(tmp_path / "log")))
    told = {r.commit_id: r for r in commits.collect()}
    # without a header's end the line feed before the next record stays
    assert set(told) == {"c1", "c2", "bare\n"}
    assert (told["c1"].parents, told["c1"].ts, told["c1"].email, told["c1"].subject, told["c1"].body) == (["p1", "p2"], 17, "m@x", "subject", "two\nlines")
    assert (told["c2"].parents, told["c2"].body, told["bare\n"].subject, told["bare\n"].ts) == ([], "", "", 0)
    files = {r.path: r for r in H.file_changes(commits).collect()}
    assert set(files) == {"x.rs b/src/a b/x.rs", "bin"}  # the first ` b/` of the line counts
    own = files["x.rs b/src/a b/x.rs"]
    assert [tuple(h) for h in own.hunks] == [(3, 3, "fn outer()"), (8, 8, ""), (20, 22, "")]
    assert [tuple(d) for d in own.deleted] == [(3, 4), (9, 9)]
    assert own.churn == 6
    # `let let` is taken as one definition of a common word
    assert own.defined == ["Foo_bar", "Old_one", "main_loop"]
    assert own.referenced == ["Foo_bar", "Old_one", "main_loop", "useful_Name"]
    assert (files["bin"].hunks, files["bin"].deleted, files["bin"].churn) == ([], [], 0)
    changes = H.file_changes(commits)
    assert {tuple(r) for r in H.churn(changes).collect()} == {("c1", own.path, 6), ("c1", "bin", 0)}
    assert H.ranges(changes, "deleted").count() == 2 and H.ranges(changes).count() == 3
    assert {r.symbol for r in H.symbols(changes).collect()} == set(own.defined)


def test_a_path_named_twice_adds_up(spark, tmp_path):
    twice = "diff --git a/f b/f\n@@ -1 +0,0 @@\n-x\ndiff --git a/f b/f\n@@ -0,0 +1 @@\n+y\n"
    put(tmp_path / "log", "a.log", record("c", twice))
    changes = H.file_changes(H.commits(H.records(spark, str(tmp_path / "log"))))
    assert [(r.place, r.path) for r in changes.orderBy("place").collect()] == [(0, "f"), (1, "f")]
    assert [tuple(r) for r in H.churn(changes).collect()] == [("c", "f", 2)]


def test_a_log_is_read_by_ranges_and_as_a_stream(spark, tmp_path):
    src = tmp_path / "log"
    for i in range(3):
        put(src, f"{i}.log", *(record(f"{i}-{k}", DIFF * (1 + k % 3)) for k in range(200)))
    whole = H.file_changes(H.commits(H.records(spark, str(src))))
    rows = sorted(map(str, whole.collect()))
    assert len(rows) == 3 * sum(2 * (1 + k % 3) for k in range(200))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        ranged = H.records(spark, str(src))
        size = sum(f.stat().st_size for f in src.glob("*.log"))
        assert ranged.rdd.getNumPartitions() >= size // 10000
        assert sorted(map(str, H.file_changes(H.commits(ranged)).collect())) == rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    stream = H.file_changes(H.commits(H.record_stream(spark, str(src))))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*whole.columns).collect())) == rows


def test_an_empty_log(spark, tmp_path):
    put(tmp_path / "log", "a.log")
    assert H.file_changes(H.commits(H.records(spark, str(tmp_path / "log")))).count() == 0


def rows_read(df):
    """Rows that a plan's one scan gave to the operators above it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_index_reads_one_folder(spark, tmp_path):
    n = 20_000
    # half of the rows has one path
    rows = spark.range(n).selectExpr("if(id % 2 = 0, 'hot', concat('f', id % 1000)) AS path", "concat('s', id % 7) AS set_name", "id AS start", "id + 3 AS end")
    rows = rows.union(spark.sql("SELECT CAST(NULL AS string), 's', 1L, 2L"))
    table = str(tmp_path / "index")
    X.write_index(rows, table, buckets=16)
    found = X.of_path(spark, table, "f7", buckets=16)
    assert sorted(map(tuple, found.select(*rows.columns).collect())) == sorted(map(tuple, rows.where("path = 'f7'").collect()))
    assert rows_read(found) < n / 10
    asked = spark.createDataFrame([("hot",), ("f9",), ("f9",), ("none",), (None,)], "path string")
    assert X.of_paths(asked, table, buckets=16).count() == n // 2 + 20
    assert X.of_path(spark, table, "none", buckets=16).count() == 0
    assert spark.read.parquet(table).count() == n + 1


def test_changes_skip_row_groups_by_bloom_filter(spark, tmp_path):
    n = 40_000
    # a path lives for a stretch of the history; its name's place in the order of names says nothing of when
    changes = spark.range(n).selectExpr("id AS seq", "concat(md5(string(id div 500)), '/', id % 50) AS path").repartition(4)
    table = str(tmp_path / "changes")
    X.write_changes(changes, table, row_group_bytes=64 << 10, paths_in_group=5000)
    path = changes.where("seq = 12345").first()["path"]
    groups = duckdb.sql(f"SELECT count(*), count(bloom_filter_offset) FROM parquet_metadata('{table}/*.parquet') WHERE path_in_schema = 'path'").fetchall()[0]
    assert groups[0] == groups[1] and groups[0] >= 8
    found = X.changes_of(spark, table, path)
    assert sorted(map(tuple, found.select("seq", "path").collect())) == sorted(map(tuple, changes.where(changes.path == path).collect()))
    assert rows_read(found) < n / 3
    assert X.changes_of(spark, table, path, since=12345).count() == changes.where((changes.path == path) & (changes.seq > 12345)).count()


def test_hunk_marks_are_read_by_one_match(spark):
    """Numbers and headings of odd marks, and no pattern for each number of a mark."""
    marks = ["@@ -1 +2 @@", "@@ -3,0 +4,2 @@ fn a() { $1 }", "@@ x @@ -5,2 +6,0 @@\tend ", "@@ -7 +8,3 @@ tail\r"]
    diff = "diff --git a/x.rs b/x.rs\n" + "\n".join(f"{m}\n+++\n-a\n--- b\n+c" for m in marks)
    rows = spark.createDataFrame([("c", diff)], "commit_id string, diff string")
    found = H.file_changes(rows)
    r = found.first()
    assert [tuple(h) for h in r.hunks] == [(2, 2, ""), (4, 5, "fn a() { $1 }"), (6, 6, "end"), (8, 10, "tail")]
    assert [tuple(h) for h in r.deleted] == [(1, 1), (5, 6), (7, 7)] and r.churn == 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("@@ -(") <= 2
