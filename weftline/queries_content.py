"""Queries of differences of texts and of drift read from contents, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import content as C
from .operators import diff, incremental
from .operators.publish import prepared_adds as prepared
from .queries import query
from .standins import views

#: Lines of a text without carriage returns and without an empty last one, as DuckDB SQL.
_LINES = r"list_transform(CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END, lambda x: regexp_replace(x, '\r$', ''))"


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and an edited copy: the lines of every seventh place go, every eleventh becomes a line of its own."""
    d = views(spark, sf_dir, "documents")[0].select("doc_id", diff.text_lines("text").alias("old"))
    places = F.filter(F.transform("old", lambda x, i: F.when(i % 11 == 5, F.concat(F.lit("edited here: "), i.cast("string"))).when(i % 7 != 3, x)), lambda x: x.isNotNull())
    return d.withColumn("new", places)


@query(f"WITH l AS (SELECT doc_id, unnest(range(len({_LINES}))) AS i FROM documents), n AS (SELECT doc_id, count(*) FILTER (i % 11 = 5) AS put, count(*) FILTER (i % 7 = 3 AND i % 11 <> 5) AS gone FROM l GROUP BY 1) SELECT doc_id, coalesce(put, 0) AS inserted, coalesce(put + gone, 0) AS deleted, true AS makes_new FROM documents LEFT JOIN n USING (doc_id)")
def diff_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inserted and deleted between each document and its edited copy, and whether the hunks make one of the other."""
    found = diff.with_hunks(_edited(spark, sf_dir))
    return found.select("doc_id", diff.stat(F.col("hunks")).alias("s"), (diff.applied(F.col("old"), F.col("new"), F.col("hunks")) == F.col("new")).alias("makes_new")).select("doc_id", "s.inserted", "s.deleted", "makes_new")


@query()
def text_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks and patch between each document and the one of the next id; tested against a least common subsequence."""
    d = views(spark, sf_dir, "documents")[0].select("doc_id", diff.text_lines("text").alias("old"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("old").alias("new")), "doc_id")
    return diff.with_patch(diff.with_hunks(pairs)).select("doc_id", F.size("hunks").alias("n_hunks"), "patch")


#: A document is a version of its language and source's file; every 13th deletes the file, the one after renames it away.
_FILE = "concat(lang, '/', source)"
_OP = "CASE doc_id % 13 WHEN 0 THEN 'deleted' WHEN 1 THEN 'renamed' ELSE 'modified' END"


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """anchors (one set at each version), versions and changes."""
    d = views(spark, sf_dir, "documents")[0].selectExpr("doc_id AS seq", f"{_FILE} AS path", f"{_OP} AS op", "doc_id", "coalesce(text, '') AS text")
    versions = d.select("path", "seq", F.when(F.col("op") == "modified", F.col("text")).alias("text"))
    moved = d.where("op = 'renamed'").select(F.concat(F.lit("old/"), F.col("seq")).alias("path"), "seq", "text")
    changes = d.select("seq", "op", F.col("path").alias("from_path"), F.when(F.col("op") == "renamed", F.concat(F.lit("old/"), F.col("seq"))).otherwise(F.col("path")).alias("to_path"))
    anchors = d.where("op = 'modified'").select(F.col("doc_id").alias("anchor_id"), "path", (1 + F.col("doc_id") % 5).alias("start"), (1 + F.col("doc_id") % 5 + F.col("doc_id") % 3).alias("end"), (F.col("doc_id") % 7 == 0).alias("whole"), "seq")
    return anchors, versions.union(moved), changes


@query(
    f"""WITH d AS (SELECT doc_id AS seq, {_FILE} AS path, {_OP} AS op, CASE WHEN {_OP} = 'modified' THEN {_LINES} ELSE [] END AS lines FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
    a AS (SELECT seq AS anchor_id, path, seq, 1 + seq % 5 AS s, 1 + seq % 5 + seq % 3 AS e, seq % 7 = 0 AS whole, lines FROM d WHERE op = 'modified'),
    m AS (SELECT anchor_id, min(d.seq) FILTER (d.op <> 'modified') AS moved, min(d.seq) FILTER (list_slice(d.lines, s, e) <> list_slice(a.lines, s, e)) AS changed FROM a JOIN d ON d.path = a.path AND d.seq > a.seq WHERE NOT whole GROUP BY 1)
    SELECT anchor_id, CASE WHEN moved <= coalesce(changed, moved) THEN 'orphaned' WHEN changed IS NOT NULL THEN 'changed' END AS kind, least(moved, changed) AS seq FROM a LEFT JOIN m USING (anchor_id)"""
)
def content_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first change that made each anchor drift, read from all versions of all files."""
    anchors, versions, changes = _history(spark, sf_dir)
    return C.locus(anchors, C.digests(versions), changes)


def _layers(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (edited copies of English files) and the working tree (German files gone)."""
    newest = versions.where("path LIKE 'en/%' OR path LIKE 'de/%'").groupBy("path").agg(F.max("seq").alias("seq"))
    last = versions.join(F.broadcast(newest), ["path", "seq"])  # a row for each language and source
    index = last.where("path LIKE 'en/%'").select(F.lit("index").alias("layer"), "path", F.col("path").alias("to_path"), F.concat(F.lit("a new first line\n"), F.col("text")).alias("text"))
    tree = last.where("path LIKE 'de/%'").select(F.lit("worktree").alias("layer"), "path", F.lit(None).cast("string").alias("to_path"), F.lit(None).cast("string").alias("text"))
    there = "text IS NOT NULL OR to_path IS NULL"
    return index.where(there), tree.where(there)


def _told(found: DataFrame) -> DataFrame:
    return found.select("anchor_id", "now_path", "now_start", "now_end", "status", F.concat_ws("", "sources").alias("sources"), "kind", "locus_seq")


@query()
def content_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, drifting layers and locus of every anchor, from versions, the index and the working tree; tested against a walk
    over every commit of made-up histories."""
    anchors, versions, changes = _history(spark, sf_dir)
    index, tree = _layers(versions)
    return _told(C.resolve(anchors, versions, changes, index.union(tree)))


@query()
def incremental_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of content_drift, made from a baseline without the working tree; tested against those of content_drift."""
    anchors, versions, changes = _history(spark, sf_dir)
    index, tree = _layers(versions)
    base = incremental.baseline(anchors, versions, changes, index, "last")
    return _told(incremental.update(base, anchors, versions, changes, index.union(tree), "last").result())


@query(
    f"""WITH t AS (SELECT doc_id, {_FILE} || '/' || doc_id AS path, 1 + doc_id % 6 AS s, 1 + doc_id % 6 + doc_id % 4 - (doc_id % 11 = 0)::int * 5 AS e, doc_id % 7 = 0 AS whole, text, {_LINES} AS lines FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
    r AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'no such file' WHEN whole THEN NULL WHEN NOT (s >= 1 AND s <= e) THEN 'not a range' WHEN e > len(lines) THEN 'beyond the end' END AS refused FROM t)
    SELECT doc_id, CASE WHEN refused IS NULL THEN sha256(CASE WHEN whole THEN text ELSE array_to_string(list_slice(lines, s, e), chr(10)) END) END AS content_sha, refused FROM r"""
)
def prepared_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An add for each document, of a file that every ninth lacks."""
    d = views(spark, sf_dir, "documents")[0].selectExpr("doc_id", f"concat({_FILE}, '/', doc_id) AS path", "1 + doc_id % 6 AS start", "1 + doc_id % 6 + doc_id % 4 - CASE WHEN doc_id % 11 = 0 THEN 5 ELSE 0 END AS end", "doc_id % 7 = 0 AS whole", "coalesce(text, '') AS text")
    found = prepared(d.select(F.col("doc_id").alias("set_name"), "path", "start", "end", "whole"), d.where("doc_id % 9 <> 0").select("path", "text"))
    return found.select(F.col("set_name").alias("doc_id"), "content_sha", "refused")
