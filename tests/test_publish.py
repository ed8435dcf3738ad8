"""Two writers at once, and adds that are refused."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from weftline.operators.publish import Catalog, ConflictExhausted, VersionTaken, prepared_adds


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_one_wins_the_other_retries(spark, tmp_path):
    table = Catalog(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read() is None
    assert table.publish(spark.range(2), 0) == 1
    both_read, tries = threading.Barrier(2), []

    def add(n):
        def change(rows):
            tries.append(n)
            if len(tries) <= 2:
                both_read.wait(30)  # neither publishes before both have loaded version 1
            return rows.union(spark.range(n, n + 1))

        Catalog(spark, str(tmp_path / "t")).update(change)

    writers = [threading.Thread(target=add, args=(n,)) for n in (10, 20)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    assert len(tries) == 3
    assert table.version() == 3 and ids(table.read()) == [0, 1, 10, 20]
    assert ids(table.read(1)) == [0, 1] and len(ids(table.read(2))) == 3
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3
    assert sorted(p.name for p in (tmp_path / "t" / "versions").iterdir() if not p.name.startswith(".")) == [f"{v:012d}" for v in (1, 2, 3)]


def test_taken_and_exhausted(spark, tmp_path):
    table = Catalog(spark, str(tmp_path / "t"))
    table.publish(spark.range(1), 0)
    with pytest.raises(VersionTaken):
        table.publish(spark.range(5), 0)
    assert ids(table.read()) == [0]

    def beaten(rows):
        Catalog(spark, str(tmp_path / "t")).publish(rows, table.version())
        return rows

    with pytest.raises(ConflictExhausted):
        table.update(beaten, retries=2)
    assert table.version() == 3


def test_prepared_adds(spark):
    rows = [("s", "a", 1, 2, False), ("s", "a", 3, 4, False), ("s", "a", 2, 1, False), ("s", "a", None, None, True), ("s", "b", 1, 1, False), ("s", "a", 0, 1, False)]
    targets = spark.createDataFrame(rows, "set_name string, path string, start long, end long, whole boolean")
    contents = spark.createDataFrame([("a", "x\r\ny\nz\n"), ("c", None)], "path string, text string")
    found = {(r["start"], r["end"], r["path"]): (r["content_sha"], r["refused"]) for r in prepared_adds(targets, contents).withColumn("refused", F.col("refused")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {
        (1, 2, "a"): (sha("x\ny"), None), (3, 4, "a"): (None, "beyond the end"), (2, 1, "a"): (None, "not a range"),
        (None, None, "a"): (sha("x\r\ny\nz\n"), None), (1, 1, "b"): (None, "no such file"), (0, 1, "a"): (None, "not a range"),
    }
