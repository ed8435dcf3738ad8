"""Stand-ins: the engine's inputs as fixed views over the driver's tables, in Spark and, for the oracles, in SQL.

Each view has one SELECT that Spark and DuckDB both run; names of the views are what the operators call their inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Views that read the same in both dialects. {name} stands for a table or an earlier view.
VIEWS = {
    # orders are commits, suppliers files, a line's quantity its churn
    "commits": "SELECT o_orderkey AS commit_id, o_orderdate AS ts, o_custkey AS author, o_orderpriority = '1-URGENT' AS is_fix, o_orderpriority AS subject FROM {orders}",
    "commit_files": "SELECT l_orderkey AS commit_id, l_suppkey AS file, sum(l_quantity) AS churn FROM {lineitem} GROUP BY l_orderkey, l_suppkey",
    "files": "SELECT s_suppkey AS file, s_nationkey AS dir, s_nationkey % 4 AS lang, s_name AS name FROM {supplier}",
    # events are a session log; values fall into 12 files and ranges of 10 to 29 lines
    "session_events": "SELECT user_id AS sid, event_id AS line_no, ts, event_type, CAST(floor(value) AS bigint) AS v FROM {events}",
    # anchor sets: four windows of lines a document, named by language and source
    "anchors": "SELECT concat(lang, '/', source) AS set_name, 1 + doc_id % 3 AS version, doc_id AS anchor_id, concat('docs/', lang, '/', CAST(doc_id % 50 AS varchar(10)), '.txt') AS path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1 + doc_id % 40 END AS start_line, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1 + doc_id % 40 + n_chars % 25 END AS end_line, doc_id % 7 = 0 AS whole FROM {documents}",
}


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables or views as DataFrames; only those are read."""
    return [_view(spark, sf_dir, n) for n in names]


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = [t for t in (*TABLES, *VIEWS) if "{" + t + "}" in text]
    return spark.sql(text, **{t: _view(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """WITH clause that defines the views for an oracle."""
    shown = {t: t for t in (*TABLES, *VIEWS)}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**shown)})" for n in names) + " "
