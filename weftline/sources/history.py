"""Histories written as one log of commits with their unified differences, read by byte ranges at record starts.

A record is RECORD, then id, parents, seconds, mail address, subject and body divided by FIELD, then HEADER_END and the
difference without context lines. Spark's text source deals a file to tasks at RECORD, so a long log is many tasks, as a
table or as a stream of files, from any store that Spark reads. A commit is one row; its files are cut apart in that row, so
nothing is shuffled to know which file a hunk belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

RECORD, FIELD, HEADER_END = "\x03", "\x1f", "\x02"

#: Words before a name that is defined, and words that are no symbols. Fixed values.
DEFINING = ("class", "interface", "struct", "enum", "trait", "type", "fn", "func", "def", "function", "const", "let", "var", "impl")
COMMON = (
    "the", "and", "for", "with", "from", "this", "that", "let", "var", "const", "function", "return", "import", "export", "use", "fn", "pub", "mut",
    "impl", "self", "Self", "None", "Some", "Ok", "Err", "true", "false", "null", "undefined", "string", "number", "boolean", "void", "async",
    "await", "type", "interface", "class", "struct", "enum", "trait", "mod", "match", "where", "default", "test", "tests", "fixture", "describe",
    "expect", "assert", "When", "This", "That", "These", "Those", "Read", "Write", "Note",
)

_HUNK = r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@\s?(.*)$"
_MARK = rf"^[\s\S]*?{_HUNK}[\s\S]*$"
_DEFINED = rf"(?<![A-Za-z0-9_])(?:{'|'.join(DEFINING)})\s+([A-Za-z_][A-Za-z0-9_]{{2,}})"
_NAMED = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{3,}"


def records(spark: SparkSession, path: str) -> DataFrame:
    """value: the log's records; spark.sql.files.maxPartitionBytes says how long a range is."""
    return spark.read.option("lineSep", RECORD).text(path)


def record_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder to which files of whole records are added."""
    return spark.readStream.option("lineSep", RECORD).text(path)


def commits(records: DataFrame) -> DataFrame:
    """commit_id, parents, ts, email, subject, body, diff of records (value); what has no id is left out, a missing field is empty."""
    text = F.regexp_replace("value", "^\n+", "")
    cut = F.instr("text", HEADER_END)
    fields = F.split(F.substring_index("text", HEADER_END, 1), FIELD)
    diff = F.when(cut > 0, F.regexp_replace(F.substr("text", cut + 1), "^\n+", "")).otherwise("")
    field = lambda i: F.coalesce(F.get("fields", F.lit(i)), F.lit(""))
    rows = records.select(text.alias("text")).select(fields.alias("fields"), diff.alias("diff"))
    return rows.where(field(0) != "").select(
        field(0).alias("commit_id"),
        F.filter(F.split(field(1), r"\s+"), lambda p: p != "").alias("parents"),
        F.coalesce(F.trim(field(2)).try_cast("bigint"), F.lit(0)).alias("ts"),
        field(3).alias("email"),
        field(4).alias("subject"),
        field(5).alias("body"),
        "diff",
    )


def _symbols(lines: Column, pattern: str, group: int) -> Column:
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))))
    return F.array_sort(F.array_except(F.filter(found, lambda x: F.length(x) >= 4), F.array(*map(F.lit, COMMON))))


def file_changes(commits: DataFrame) -> DataFrame:
    """commit_id, place, path, hunks, deleted, churn, defined, referenced: one row for each file of a commit's difference.

    hunks: start, end, heading of the lines a hunk puts (one line where it only deletes); deleted: start, end of old lines;
    churn: lines added and deleted; defined and referenced: names of four characters or more in them, referenced ones only
    with an underscore or a capital. Excluded files are left out. A path that a commit names twice has two rows.
    """
    own = F.filter(F.split("diff", "\n(?=diff --git )"), lambda x: F.startswith(x, F.lit("diff --git ")))
    parts = commits.select("commit_id", F.posexplode(own).alias("place", "part"))
    named = parts.withColumn("path", F.regexp_extract("part", "^[^\n]*? b/([^\n]+)", 1)).where((F.col("path") != "") & ~paths.is_excluded(F.col("path")))
    lines = named.withColumn("lines", F.split("part", "\n", -1)).select(
        "commit_id",
        "place",
        "path",
        # a mark's numbers and heading are read by one match
        F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit("@@")) & x.rlike(_HUNK)), lambda x: F.split(F.regexp_replace(x, _MARK, f"$1{FIELD}$2{FIELD}$3{FIELD}$4{FIELD}$5"), FIELD, 5)).alias("marks"),
        F.transform(F.filter("lines", lambda x: (F.startswith(x, F.lit("+")) | F.startswith(x, F.lit("-"))) & ~F.startswith(x, F.lit("+++")) & ~F.startswith(x, F.lit("---"))), lambda x: F.substr(x, F.lit(2))).alias("changed"),
    )
    part = lambda x, k: F.get(x, F.lit(k - 1)).try_cast("bigint")
    count = lambda x, k: F.coalesce(part(x, k), F.lit(1))
    put = lambda x: F.struct(part(x, 3).alias("start"), (part(x, 3) + F.greatest(count(x, 4), F.lit(1)) - 1).alias("end"), F.trim(F.get(x, F.lit(4))).alias("heading"))
    gone = lambda x: F.struct(part(x, 1).alias("start"), (part(x, 1) + count(x, 2) - 1).alias("end"))
    return lines.select(
        "commit_id",
        "place",
        "path",
        F.transform("marks", put).alias("hunks"),
        F.transform(F.filter("marks", lambda x: count(x, 2) > 0), gone).alias("deleted"),
        F.size("changed").cast("bigint").alias("churn"),
        _symbols(F.col("changed"), _DEFINED, 1).alias("defined"),
        F.filter(_symbols(F.col("changed"), _NAMED, 0), lambda x: x.rlike("[_A-Z]")).alias("referenced"),
    )


def churn(changes: DataFrame) -> DataFrame:
    """commit_id, path, churn."""
    return changes.groupBy("commit_id", "path").agg(F.sum("churn").alias("churn"))


def ranges(changes: DataFrame, of: str = "hunks") -> DataFrame:
    """commit_id, place, path, start, end (and heading) of hunks or of deleted ranges."""
    return changes.select("commit_id", "place", "path", F.inline(of))


def symbols(changes: DataFrame, kind: str = "defined") -> DataFrame:
    """commit_id, symbol: distinct names that a commit's lines define or refer to."""
    return changes.select("commit_id", F.explode(kind).alias("symbol")).distinct()
