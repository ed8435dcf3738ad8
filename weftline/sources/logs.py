"""Sources: session logs as JSON lines, staging logs, anchor records, and unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READS = "sid string, line_no bigint, path string, start_line bigint, end_line bigint, ts string, id string"
TOUCHES = "sid string, line_no bigint, path string, kind string, id string, ts string, start bigint, end bigint"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that isn't a record of the schema is an error when read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def staging(lines: DataFrame) -> DataFrame:
    """set_name, line_no, op, path, start, end, whole, key, value, n: the grammar of a staging log's lines (set_name, line_no, line).

    `add <path>[#L<s>-L<e>]`, `remove <...>`, `config <key> <value>`, `why <text>`; adds are numbered from 1 within their
    set. Lines of no known form have a null op.
    """
    shape = r"^(add|remove) (.+?)(?:#L([0-9]+)-L([0-9]+))?(?:\t([0-9a-f]+))?$"
    op = F.when(F.col("line").rlike(shape), F.regexp_extract("line", shape, 1)).when(F.col("line").rlike(r"^config \S+ .*$"), "config").when(F.col("line").rlike("^why .*$"), "why")
    rows = lines.withColumn("op", op)
    ranged = F.col("op").isin("add", "remove")
    part = lambda k: F.when(ranged, F.nullif(F.regexp_extract("line", shape, k), F.lit("")))
    n = F.when(F.col("op") == "add", F.sum((F.col("op") == "add").cast("int")).over(Window.partitionBy("set_name").orderBy("line_no")))
    return rows.select(
        "set_name",
        "line_no",
        "op",
        part(2).alias("path"),
        part(3).cast("bigint").alias("start"),
        part(4).cast("bigint").alias("end"),
        F.when(ranged, part(3).isNull()).alias("whole"),
        F.when(F.col("op") == "config", F.regexp_extract("line", r"^config (\S+) ", 1)).alias("key"),
        F.when(F.col("op") == "config", F.regexp_extract("line", r"^config \S+ (.*)$", 1)).when(F.col("op") == "why", F.regexp_extract("line", "^why (.*)$", 1)).alias("value"),
        n.alias("n"),
    )


def anchor_records(files: DataFrame) -> DataFrame:
    """id, commit, created, start, end, path, blob of records (id, text); a record of another form is an error when read."""
    shape = r"^commit ([0-9a-f]{40})\ncreated ([^\n]+)\nextent (?:whole|([0-9]+) ([0-9]+)) ([0-9a-f]{40})\t([^\n]+)\n$"
    bad = F.raise_error(F.concat(F.lit("not an anchor record: "), F.col("id").cast("string"))).cast("string")
    t = F.when(F.col("text").rlike(shape), F.col("text")).otherwise(bad)
    rows = files.select("id", t.alias("t"))
    part = lambda k: F.regexp_extract("t", shape, k)
    return rows.select("id", part(1).alias("commit"), part(2).alias("created"), part(3).try_cast("bigint").alias("start"), part(4).try_cast("bigint").alias("end"), part(5).alias("blob"), part(6).alias("path"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """commit_id, path, os, oc, ns, nc, heading of a unified diff's lines (commit_id, line_no, line).

    The file named by the last +++ line before a hunk is carried forward within a commit.
    """
    w = Window.partitionBy("commit_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    rows = lines.withColumn("path", F.last(named, True).over(w))
    shape = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@ ?(.*)$"
    number = lambda k: F.coalesce(F.regexp_extract("line", shape, k).try_cast("bigint"), F.lit(1))
    return rows.where(F.col("line").rlike(shape)).select("commit_id", "line_no", "path", number(1).alias("os"), number(2).alias("oc"), number(3).alias("ns"), number(4).alias("nc"), F.regexp_extract("line", shape, 5).alias("heading"))


def diff_churn(lines: DataFrame) -> DataFrame:
    """commit_id, path, churn: lines added and deleted in each file of a unified diff."""
    w = Window.partitionBy("commit_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    rows = lines.withColumn("path", F.last(named, True).over(w)).where(F.col("line").rlike(r"^[+-](?![+-]{2} )"))
    return rows.groupBy("commit_id", "path").agg(F.count("*").alias("churn"))


def rename_records(lines: DataFrame) -> DataFrame:
    """commit_id, op, score, from_path, to_path of `R<score>` and `C<score>` rows by tabs."""
    shape = r"^([RC])([0-9]{1,3})\t([^\t]+)\t([^\t]+)$"
    return lines.where(F.col("line").rlike(shape)).select("commit_id", F.regexp_extract("line", shape, 1).alias("op"), F.regexp_extract("line", shape, 2).cast("int").alias("score"), F.regexp_extract("line", shape, 3).alias("from_path"), F.regexp_extract("line", shape, 4).alias("to_path"))
