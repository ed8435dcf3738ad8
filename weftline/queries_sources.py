"""Queries of the history log and of the path indexes, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog
from .plans.stages import folder
from .queries import query
from .sources import history, path_index
from .standins import ctes, views


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of commits: a line is a file with one hunk, every fourth only deletes; written, and read again as records."""
    orders, lines = views(spark, sf_dir, "orders", "lineitem")
    path = F.expr("concat('src/f', l_suppkey, '.rs')")
    puts = F.expr("if(l_partkey % 4 = 0, 0, 1 + l_partkey % 3)")
    mark = F.concat(F.lit("@@ -"), (F.col("l_linenumber") + 4).cast("string"), F.lit(",2 +"), (F.col("l_linenumber") + 9).cast("string"), F.lit(","), puts.cast("string"), F.expr("concat(' @@ fn part_', l_partkey % 10)"))
    body = F.concat(F.lit("\n-let gone = old_"), F.expr("l_partkey % 9"), F.lit(";\n-}"), F.expr("repeat(concat('\n+fn Made_', l_suppkey % 20, '() { usedHere }'), if(l_partkey % 4 = 0, 0, 1 + l_partkey % 3))"))
    part = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), mark, body)
    own = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", part.alias("part")))), lambda x: x["part"]), "\n").alias("diff"))
    head = F.concat_ws(history.FIELD, F.col("o_orderkey").cast("string"), F.lit(""), F.expr("CAST(unix_date(CAST(o_orderdate AS date)) AS string)"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.lit(""))
    log = orders.join(own, orders.o_orderkey == own.l_orderkey).select(F.concat(F.lit(history.RECORD), head, F.lit(history.HEADER_END), F.lit("\n"), "diff"))
    path = folder(log, "history")
    log.write.text(path)
    return history.records(spark, path)


_LINES = "l AS (SELECT l_orderkey AS k, concat('src/f', l_suppkey, '.rs') AS path, l_linenumber AS n, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE 1 + l_partkey % 3 END AS puts, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(
    f"WITH {_LINES} SELECT CAST(k AS varchar) AS commit_id, path, CAST(count(*) AS bigint) AS n_hunks, CAST(min(n + 9) AS bigint) AS first_line, CAST(max(n + 9 + greatest(puts, 1) - 1) AS bigint) AS last_line, CAST(min(n + 4) AS bigint) AS gone_from, max(concat('fn part_', p % 10)) AS heading, CAST(sum(2 + puts) AS bigint) AS churn FROM l GROUP BY 1, 2"
)
def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks, deleted lines and churn of each file of each commit, from a log that is read by ranges."""
    changes = history.file_changes(history.commits(_log(spark, sf_dir)))
    told = changes.select("commit_id", "path", "churn", F.size("hunks").alias("n"), F.array_min("hunks.start").alias("a"), F.array_max("hunks.end").alias("b"), F.array_min("deleted.start").alias("g"), F.array_max("hunks.heading").alias("h"))
    return told.groupBy("commit_id", "path").agg(
        F.sum("n").alias("n_hunks"), F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.min("g").alias("gone_from"), F.max("h").alias("heading"), F.sum("churn").alias("churn")
    )


@query(
    f"""WITH {_LINES}, f AS (SELECT k, 'defined' AS kind, concat('Made_', s % 20) AS symbol FROM l WHERE puts > 0 UNION SELECT k, 'defined', 'gone' FROM l
    UNION SELECT k, 'referenced', concat('Made_', s % 20) FROM l WHERE puts > 0 UNION SELECT k, 'referenced', 'usedHere' FROM l WHERE puts > 0 UNION SELECT k, 'referenced', concat('old_', p % 9) FROM l)
    SELECT kind, symbol, count(*) AS n_commits FROM f GROUP BY 1, 2"""
)
def history_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many commits of the log each symbol is defined and referred to."""
    changes = history.file_changes(history.commits(_log(spark, sf_dir)))
    both = changes.select("commit_id", F.explode(F.create_map(F.lit("defined"), "defined", F.lit("referenced"), "referenced")).alias("kind", "names"))
    return both.select("commit_id", "kind", F.explode("names").alias("symbol")).distinct().groupBy("kind", "symbol").agg(F.count("*").alias("n_commits"))


@query(
    ctes("anchors")
    + """SELECT path, set_name, CASE WHEN whole THEN 0 ELSE start_line END AS start_line, CASE WHEN whole THEN 0 ELSE end_line END AS end_line FROM anchors WHERE path IN (SELECT arg_max(path, anchor_id) FROM anchors GROUP BY set_name)"""
)
def path_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the paths that each set's newest anchor has, from a written index."""
    anchors = views(spark, sf_dir, "anchors")[0]
    rows = catalog.listed(anchors.withColumnsRenamed({"start_line": "start", "end_line": "end"}))
    table = folder(rows, "index")
    path_index.write_index(rows, table)
    asked = anchors.groupBy("set_name").agg(F.max_by("path", "anchor_id").alias("path"))
    return path_index.of_paths(asked, table).withColumnsRenamed({"start": "start_line", "end": "end_line"})


@query("WITH b AS (SELECT l_suppkey AS s FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT l_orderkey AS seq, concat('src/f', l_suppkey, '.rs') AS path, CAST(l_linenumber AS bigint) AS place FROM lineitem, b WHERE l_suppkey = s")
def changes_of_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of the file with the most, from changes in order of the history with Bloom filters of paths."""
    lines = views(spark, sf_dir, "lineitem")[0]
    busiest = lines.groupBy("l_suppkey").count().orderBy(F.desc("count"), "l_suppkey").first()
    changes = lines.select(F.col("l_orderkey").alias("seq"), F.expr("concat('src/f', l_suppkey, '.rs')").alias("path"), F.col("l_linenumber").cast("bigint").alias("place"))
    table = folder(changes, "changes")
    path_index.write_changes(changes, table)
    return path_index.changes_of(spark, table, f"src/f{busiest['l_suppkey']}.rs" if busiest else "")
