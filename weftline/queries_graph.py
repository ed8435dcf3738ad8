"""Queries of ancestry, with their oracles: parts are commits, most with one parent a few numbers below, a third with two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph as G
from .queries import query
from .standins import views

_PARENTS = """par AS (SELECT p_partkey AS commit_id, 0 AS place, CASE WHEN p_partkey > 0 THEN greatest(p_partkey - 1 - p_partkey % 4, 0) END AS parent FROM part
    UNION ALL SELECT p_partkey, 1, p_partkey - 2 - p_partkey % 5 FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 6 AND p_partkey % 4 - p_partkey % 5 <> 1)"""
_UP = "WITH RECURSIVE " + _PARENTS + ", n AS (SELECT count(*) AS n FROM part), up AS (SELECT p_partkey AS d, p_partkey AS c FROM part UNION SELECT d, parent FROM up JOIN par ON c = commit_id WHERE parent IS NOT NULL)"


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH " + _PARENTS.replace("FROM part", "FROM {part}") + " SELECT * FROM par", part=views(spark, sf_dir, "part")[0])


def _pairs(spark: SparkSession, sf_dir: str, factor: int, a: str, b: str) -> DataFrame:
    part = views(spark, sf_dir, "part")[0].select(F.col("p_partkey").alias(b))
    return part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n")))).select(((F.col(b) * factor + 3) % F.col("n")).alias(a), b)


@query(_UP + " SELECT (p_partkey * 5 + 3) % n AS ancestor, p_partkey AS commit_id, ((p_partkey * 5 + 3) % n, p_partkey) IN (SELECT (c, d) FROM up) AS is_ancestor FROM part, n")
def is_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.Ancestry(_parents(spark, sf_dir)).is_ancestor(_pairs(spark, sf_dir, 5, "ancestor", "commit_id"))


@query(
    _UP
    + """, pairs AS (SELECT (p_partkey * 7 + 3) % n AS a, p_partkey AS b FROM part, n), common AS (SELECT a, b, x.c FROM pairs JOIN up x ON x.d = a JOIN up y ON y.d = b AND y.c = x.c)
    SELECT a, b, c AS base FROM common ANTI JOIN (SELECT a, b, parent AS c FROM common JOIN par ON c = commit_id) above USING (a, b, c)"""
)
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All best common ancestors; every two commits have commit 0 in common."""
    return G.Ancestry(_parents(spark, sf_dir)).merge_bases(_pairs(spark, sf_dir, 7, "a", "b"))


@query(_UP + " SELECT p_partkey AS anchor_id, p_partkey AS commit_id FROM part WHERE (p_partkey, 51) IN (SELECT (d, c) FROM up)")
def set_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, one a commit, set at commit 51 or one that descends from it."""
    anchors = views(spark, sf_dir, "part")[0].select(F.col("p_partkey").alias("anchor_id"), F.col("p_partkey").alias("commit_id"))
    return G.set_since(anchors, G.Ancestry(_parents(spark, sf_dir)), 51).select("anchor_id", "commit_id")


@query(_UP + ", m AS (SELECT x.commit_id, x.parent AS first, y.parent AS second FROM par x JOIN par y ON x.commit_id = y.commit_id AND x.place = 0 AND y.place = 1), s AS (SELECT m.commit_id, u.c AS side FROM m JOIN up u ON u.d = second ANTI JOIN up v ON v.d = first AND v.c = u.c) SELECT DISTINCT s.commit_id, ps_suppkey AS file FROM s JOIN (SELECT l_partkey, l_suppkey AS ps_suppkey FROM lineitem) ON l_partkey = side")
def branch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (suppliers of a part's lines) that a merge's second parent alone has changed."""
    parents = _parents(spark, sf_dir)
    files = views(spark, sf_dir, "lineitem")[0].select(F.col("l_partkey").alias("commit_id"), F.col("l_suppkey").alias("file"))
    return G.branch_files(parents, files, G.Ancestry(parents))
