"""Queries of the catalog, of drift, mutation and rendering over stand-in anchors and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import ranges as R
from .functions import text as T
from .operators import catalog as C
from .operators import drift as D
from .operators import mutations as M
from .operators import sinks as K
from .queries import query
from .sources import logs as L
from .standins import ctes, views

A = ctes("anchors")
#: The same view names in both engines: start and end are words of SQL, so the views call them start_line and end_line.
NOW = A[:-1] + ", newest AS (SELECT set_name, max(version) AS version FROM anchors GROUP BY 1), now AS (SELECT a.* FROM anchors a JOIN newest USING (set_name, version)) "


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views(spark, sf_dir, "anchors")[0]
    return a.select("set_name", F.col("version").cast("long").alias("version"), "anchor_id", "path", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), "whole")


def _sets(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy(F.col("set_name").alias("name"), "version").agg(F.concat(F.lit("why "), F.max("path")).alias("message"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("start", "start_line").withColumnRenamed("end", "end_line")


@query(NOW + "SELECT set_name, version::bigint AS version, anchor_id, path, start_line, end_line, whole FROM now")
def catalog_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.at_version(_anchors(spark, sf_dir)))


@query(A + ", n AS (SELECT set_name, max(version) AS version FROM anchors WHERE version <= 2 GROUP BY 1) SELECT set_name, version::bigint AS version, anchor_id FROM anchors JOIN n USING (set_name, version)")
def catalog_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.at_version(_anchors(spark, sf_dir), 2).select("set_name", "version", "anchor_id")


@query(A + "SELECT DISTINCT set_name FROM anchors")
def set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.names(_anchors(spark, sf_dir))


@query(A + "SELECT set_name AS name, version::bigint AS version, concat('why ', max(path)) AS message FROM anchors WHERE set_name = 'en/src1' GROUP BY 1, 2 ORDER BY 2 DESC LIMIT 2")
def set_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(_sets(_anchors(spark, sf_dir)), "en/src1", 2).select("name", "version", "message")


@query(A + "SELECT path, set_name, CASE WHEN whole THEN 0 ELSE start_line END AS start_line, CASE WHEN whole THEN 0 ELSE end_line END AS end_line FROM anchors")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(C.listed(_anchors(spark, sf_dir)))


_TARGETS = """, targets AS (SELECT doc_id AS query_id, concat('docs/', lang, '/', CAST(doc_id % 60 AS varchar), '.txt') AS path, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 50 END AS s, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 4 + doc_id % 50 END AS e FROM documents WHERE doc_id % 4 = 0)"""
_MET = _TARGETS + ", met AS (SELECT DISTINCT query_id, set_name FROM now n JOIN targets t ON n.path = t.path AND (t.s IS NULL OR n.whole OR (n.start_line <= t.e AND n.end_line >= t.s)))"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir, "documents")[0].where("doc_id % 4 = 0")
    ranged = F.col("doc_id") % 5 != 0
    return d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("docs/"), "lang", F.lit("/"), (F.col("doc_id") % 60).cast("string"), F.lit(".txt")).alias("path"), F.when(ranged, 1 + F.col("doc_id") % 50).alias("start"), F.when(ranged, 4 + F.col("doc_id") % 50).alias("end"))


@query(NOW[:-1] + _MET + " SELECT query_id, set_name FROM met")
def range_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.matches(C.at_version(_anchors(spark, sf_dir)), _targets(spark, sf_dir))


@query(
    NOW[:-1]
    + _MET
    + """ SELECT t.query_id, CASE WHEN set_name IS NULL THEN 'no sets' ELSE concat(set_name, chr(9), n.path, chr(9), CASE WHEN whole THEN '0-0' ELSE concat(start_line, '-', end_line) END) END AS line FROM targets t LEFT JOIN (met JOIN now n USING (set_name)) ON t.query_id = met.query_id"""
)
def batch_point_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.point_queries(C.at_version(_anchors(spark, sf_dir)), _targets(spark, sf_dir))


@query(
    NOW
    + """SELECT DISTINCT set_name FROM now WHERE regexp_matches(set_name, '(?i)SRC1[0-9]') OR regexp_matches(path, '(?i)SRC1[0-9]')"""
)
def set_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = C.at_version(_anchors(spark, sf_dir))
    return C.search(_sets(now), now, "SRC1[0-9]").withColumnRenamed("name", "set_name")


@query(NOW + "SELECT set_name, anchor_id, path FROM now WHERE regexp_matches(path, '^docs/(?:en|fr)/[^/]*1\\.txt$')")
def glob_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_glob(C.at_version(_anchors(spark, sf_dir)), "docs/{en,fr}/*1.txt").select("set_name", "anchor_id", "path")


@query(NOW + "SELECT DISTINCT set_name FROM now ORDER BY 1 LIMIT 10 OFFSET 5")
def set_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(C.names(C.at_version(_anchors(spark, sf_dir))), 5, 10)


@query(
    NOW[:-1]
    + """, shape AS (SELECT set_name, list_sort(list(path)) AS paths FROM now GROUP BY 1),
    met AS (SELECT DISTINCT a.set_name AS a, b.set_name AS b FROM now a JOIN shape x ON x.set_name = a.set_name JOIN shape y ON y.paths = x.paths JOIN now b ON b.set_name = y.set_name AND b.path = a.path AND a.set_name < b.set_name
      WHERE a.whole OR b.whole OR (a.start_line <= b.end_line AND a.end_line >= b.start_line)),
    m AS (SELECT a AS set_name FROM met UNION SELECT b FROM met)
    SELECT s.set_name, CAST(row_number() OVER (ORDER BY paths, CASE WHEN m.set_name IS NULL THEN 1 ELSE 0 END, s.set_name) AS int) AS place FROM shape s LEFT JOIN m USING (set_name)"""
)
def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.result_order(C.at_version(_anchors(spark, sf_dir)))


@query("WITH s AS (SELECT DISTINCT lang AS name FROM documents UNION SELECT DISTINCT concat(lang, '/', source) FROM documents) SELECT a.name AS \"outer\", b.name AS \"inner\" FROM s a JOIN s b ON starts_with(b.name, concat(a.name, '/'))")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir, "documents")[0]
    return C.name_collisions(d.select(F.col("lang").alias("name")).union(d.select(F.concat_ws("/", "lang", "source"))).distinct())


@query(NOW + ", d AS (SELECT DISTINCT set_name FROM now WHERE path LIKE '%/1.txt') SELECT set_name, anchor_id FROM now WHERE set_name NOT IN (SELECT set_name FROM d) UNION ALL SELECT set_name, anchor_id + 1000000 FROM now JOIN d USING (set_name) WHERE anchor_id % 2 = 0")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = C.at_version(_anchors(spark, sf_dir))
    hit = C.affected_sets(now, now.where(F.col("path").endswith("/1.txt")).select("path"))
    new = now.join(hit, "set_name", "left_semi").where("anchor_id % 2 = 0").select("set_name", (F.col("anchor_id") + 1000000).alias("anchor_id"))
    return C.with_overlay(now.select("set_name", "anchor_id"), hit, new)


@query("WITH RECURSIVE p AS (SELECT o_orderkey AS commit_id, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0), up AS (SELECT max(o_orderkey) AS commit_id FROM orders UNION SELECT parent FROM up JOIN p USING (commit_id) WHERE parent > 0) SELECT commit_id FROM up")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit's parent is half its number, rounded down."""
    orders = views(spark, sf_dir, "orders")[0].where("o_orderkey > 0")
    parents = orders.select(F.col("o_orderkey").alias("commit_id"), F.expr("nullif(o_orderkey div 2, 0)").alias("parent"))
    return C.ancestors(parents, orders.agg(F.max("o_orderkey")).first()[0])


# ranges and texts

_PAIR = "WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, 1 + l_partkey % 50 AS s, 1 + l_partkey % 50 + CAST(l_quantity AS bigint) AS e, 1 + l_suppkey % 60 AS qs, 4 + l_suppkey % 60 AS qe FROM lineitem)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "lineitem")[0].selectExpr("l_orderkey AS k", "l_linenumber AS n", "1 + l_partkey % 50 AS s", "1 + l_partkey % 50 + CAST(l_quantity AS bigint) AS e", "1 + l_suppkey % 60 AS qs", "4 + l_suppkey % 60 AS qe")


@query(_PAIR + " SELECT k, n, s <= qe AND e >= qs AS met, round(greatest(0, least(e, qe) - greatest(s, qs) + 1) / ((e - s + 1) + (qe - qs + 1) - greatest(0, least(e, qe) - greatest(s, qs) + 1)), 6) AS iou FROM r")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e, qs, qe = map(F.col, ("s", "e", "qs", "qe"))
    return _ranges(spark, sf_dir).select("k", "n", R.overlaps(s, e, F.lit(False), qs, qe).alias("met"), F.round(R.iou(s, e, qs, qe), 6).alias("iou"))


@query(
    _PAIR
    + """, p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    q AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, n) AS run FROM p)
    SELECT k, n, min(s) OVER (PARTITION BY k, run) AS m_start, max(e) OVER (PARTITION BY k, run) AS m_end FROM q"""
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_near(_ranges(spark, sf_dir), ["k"], start="s", end="e", order=["n"]).select("k", "n", "m_start", "m_end")


#: An order's lines are hunks in order of their number; the range is 20 to 40.
_FOLD = """WITH RECURSIVE h AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS bigint), l_partkey % 4, l_suppkey % 5) AS bigint) AS i, CAST(l_quantity AS bigint) AS os, l_partkey % 4 AS oc, l_suppkey % 5 AS nc FROM lineitem),
    f AS (SELECT DISTINCT k, 0::bigint AS i, 20::bigint AS s, 40::bigint AS e FROM h
      UNION ALL SELECT f.k, h.i,
        CASE WHEN oc = 0 AND os < s THEN s + nc WHEN oc = 0 THEN s WHEN os + oc - 1 < s THEN s + nc - oc WHEN os > e THEN s ELSE greatest(least(s, os), 1) END,
        CASE WHEN oc = 0 AND os < s THEN e + nc WHEN oc = 0 AND os >= e THEN e WHEN oc = 0 THEN e + nc WHEN os + oc - 1 < s THEN e + nc - oc WHEN os > e THEN e ELSE greatest(CASE WHEN nc = 0 THEN os ELSE os + nc - 1 END, e + nc - oc) END
      FROM f JOIN h ON h.k = f.k AND h.i = f.i + 1)
    SELECT k, greatest(arg_max(s, i), 1) AS s, greatest(arg_max(e, i), greatest(arg_max(s, i), 1)) AS e FROM f GROUP BY k"""


@query(_FOLD)
def hunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir, "lineitem")[0].selectExpr("l_orderkey AS k", "l_linenumber AS n", "CAST(l_quantity AS bigint) AS os", "CAST(l_partkey % 4 AS bigint) AS oc", "CAST(l_suppkey % 5 AS bigint) AS nc")
    h = F.transform(F.sort_array(F.collect_list(F.struct("n", "os", "oc", "nc"))), lambda x: F.struct(x["os"].alias("os"), x["oc"].alias("oc"), x["os"].alias("ns"), x["nc"].alias("nc")))
    by = rows.groupBy("k").agg(h.alias("hunks"))
    return by.select("k", F.expr(R.moved_by("20", "40", "hunks")).alias("r")).select("k", "r.s", "r.e")


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY 1)"


@query(
    _LINES
    + """, m AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS s FROM c x JOIN c y ON x.line = y.line AND x.doc_id < y.doc_id GROUP BY 1, 2)
    SELECT a, b, CAST(round(s / (p.t + q.t - s), 6) AS double) AS similarity FROM m JOIN t p ON p.doc_id = a JOIN t q ON q.doc_id = b WHERE s / (p.t + q.t - s) >= 0.5"""
)
def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a line, with a line-multiset Jaccard of one half or more."""
    d = views(spark, sf_dir, "documents")[0]
    return D.similar_documents(d.select(F.col("doc_id").alias("doc"), T.lines_raw(F.col("text")).alias("lines"))).withColumn("similarity", F.round("similarity", 6))


@query(
    _LINES
    + """, p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS s FROM c x JOIN c y ON x.line = y.line WHERE x.doc_id % 10 = 3 AND y.doc_id % 10 <> 3 GROUP BY 1, 2),
    j AS (SELECT a, b, s / (p.t + q.t - s) AS similarity FROM p AS m JOIN t p ON p.doc_id = a JOIN t q ON q.doc_id = b)
    SELECT a AS path, arg_max(b, (similarity, -b)) AS source, round(max(similarity), 6) AS similarity FROM j WHERE similarity >= 0.5 GROUP BY 1"""
)
def copy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id ends in 3 are added files, the others the pool in order of id."""
    d = views(spark, sf_dir, "documents")[0]
    lines = d.select("doc_id", F.explode(T.lines_raw(F.col("text"))).alias("line"))
    added = lines.where("doc_id % 10 = 3").select(F.col("doc_id").alias("path"), "line")
    pool = lines.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("source"), F.col("doc_id").alias("place"), "line")
    return D.copy_sources(added, pool).withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id, count(*) FILTER (WHERE TRUE) AS n, sum(CASE WHEN k BETWEEN 2 AND 4 THEN length(line) ELSE 0 END)::bigint AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) GROUP BY 1")
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of lines of each text and the characters of lines 2 to 4."""
    d = views(spark, sf_dir, "documents")[0].withColumn("lines", T.lines_raw(F.col("text")))
    part = T.line_slice(F.col("lines"), F.lit(2), F.lit(4))
    return d.select("doc_id", F.size("lines").cast("long").alias("n"), F.coalesce(F.length(F.array_join(part, "")), F.lit(0)).cast("long").alias("chars"))


# drift

_CHANGES = """changes AS (SELECT l_orderkey AS seq, CASE l_partkey % 9 WHEN 0 THEN 'deleted' WHEN 1 THEN 'copied' WHEN 2 THEN 'renamed' ELSE 'modified' END AS op, concat('f', l_suppkey % 400) AS from_path, CASE WHEN l_partkey % 9 IN (1, 2) THEN concat('f', (l_suppkey + 7) % 400) ELSE concat('f', l_suppkey % 400) END AS to_path, CAST(l_quantity AS bigint) AS os, l_linenumber AS n FROM lineitem WHERE l_linenumber = 1)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("WITH " + _CHANGES.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM changes", lineitem=views(spark, sf_dir, "lineitem")[0])
    hunk = F.array(F.struct(F.col("os").alias("os"), F.lit(1).cast("long").alias("oc"), F.col("os").alias("ns"), F.lit(2).cast("long").alias("nc")))
    return rows.select("seq", "op", "from_path", "to_path", F.when(F.col("op") != "deleted", hunk).alias("hunks"))


_TRAIL = (
    "WITH RECURSIVE "
    + _CHANGES
    + """, a AS (SELECT s_suppkey AS anchor_id, concat('f', s_suppkey % 400) AS path, CAST(s_suppkey * 50 AS bigint) AS seq FROM supplier),
    mv AS (SELECT * FROM changes WHERE op IN ('renamed', 'deleted')),
    leg AS (SELECT anchor_id, path, seq AS since, (SELECT min(m.seq) FROM mv m WHERE m.from_path = path AND m.seq > a.seq) AS until FROM a
      UNION ALL SELECT leg.anchor_id, m.to_path, leg.until, (SELECT min(k.seq) FROM mv k WHERE k.from_path = m.to_path AND k.seq > leg.until) FROM leg JOIN mv m ON m.from_path = leg.path AND m.seq = leg.until AND m.op = 'renamed'),
    met AS (SELECT leg.anchor_id, c.seq, c.from_path, c.op, c.to_path, c.os FROM leg JOIN changes c ON c.from_path = leg.path AND c.seq > leg.since AND (leg.until IS NULL OR c.seq <= leg.until) AND c.op <> 'copied')"""
)


def _file_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views(spark, sf_dir, "supplier")[0]
    return s.selectExpr("s_suppkey AS anchor_id", "concat('f', s_suppkey % 400) AS path", "s_suppkey * 50 AS seq", "10L AS start", "30L AS end", "s_suppkey % 7 = 0 AS whole")


@query(_TRAIL + " SELECT anchor_id, seq, from_path AS path, op FROM met")
def change_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trails(_file_anchors(spark, sf_dir), _changes(spark, sf_dir)).select("anchor_id", "seq", "path", "op")


@query(
    _TRAIL
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY seq) AS i FROM met),
    gone AS (SELECT DISTINCT anchor_id FROM met WHERE op = 'deleted'),
    f AS (SELECT a.anchor_id, 0::bigint AS i, 10::bigint AS s, 30::bigint AS e, a.path FROM a
      UNION ALL SELECT f.anchor_id, o.i,
        CASE WHEN o.op = 'deleted' THEN s WHEN os < s THEN s + 1 WHEN os > e THEN s ELSE greatest(least(s, os), 1) END,
        CASE WHEN o.op = 'deleted' THEN e WHEN os < s THEN e + 1 WHEN os > e THEN e ELSE greatest(os + 1, e + 1) END, o.to_path FROM f JOIN o ON o.anchor_id = f.anchor_id AND o.i = f.i + 1),
    l AS (SELECT anchor_id, arg_max(s, i) AS s, arg_max(e, i) AS e, arg_max(path, i) AS path FROM f GROUP BY 1)
    SELECT l.anchor_id, CASE WHEN g.anchor_id IS NULL THEN path END AS now_path, CASE WHEN g.anchor_id IS NULL AND l.anchor_id % 7 <> 0 THEN s END AS now_start, CASE WHEN g.anchor_id IS NULL AND l.anchor_id % 7 <> 0 THEN e END AS now_end FROM l LEFT JOIN gone g ON g.anchor_id = l.anchor_id"""
)
def carried_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, changes = _file_anchors(spark, sf_dir), _changes(spark, sf_dir)
    return D.carried(anchors, D.trails(anchors, changes)).select("anchor_id", "now_path", "now_start", "now_end")


_RESOLVED = """WITH r AS (SELECT doc_id AS anchor_id, concat(lang, '/', source) AS set_name, doc_id % 31 <> 0 AS reachable, doc_id % 37 = 0 AS conflicted, CASE WHEN doc_id % 41 = 0 THEN 'lfs' END AS unavailable, doc_id % 7 = 0 AS whole, doc_id % 5 = 0 AS renamed, doc_id % 11 = 0 AS gone, doc_id % 3 = 0 AS shifted, doc_id % 4 = 0 AS edited, doc_id % 2 = 0 AS path_there FROM documents),
    c AS (SELECT *, CASE WHEN NOT reachable THEN 'Orphaned' WHEN conflicted THEN 'MergeConflict' WHEN unavailable IS NOT NULL THEN 'ContentUnavailable' WHEN gone THEN 'Changed'
      WHEN NOT edited AND renamed AND NOT path_there AND NOT whole THEN 'Orphaned' WHEN NOT edited AND NOT renamed AND (whole OR NOT shifted) THEN 'Fresh' WHEN NOT edited THEN 'Moved' ELSE 'Changed' END AS status FROM r)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir, "documents")[0]
    rows = d.selectExpr("doc_id AS anchor_id", "concat(lang, '/', source) AS set_name", "doc_id % 31 <> 0 AS reachable", "doc_id % 37 = 0 AS conflicted", "CASE WHEN doc_id % 41 = 0 THEN 'lfs' END AS unavailable", "doc_id % 7 = 0 AS whole", "'a' AS path", "10L AS start", "12L AS end", "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'b' ELSE 'a' END AS now_path", "10L + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS now_start", "12L + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS now_end", "array('x', 'y') AS then_lines", "CASE WHEN doc_id % 4 = 0 THEN array('x', 'z') ELSE array('x ', 'y') END AS now_lines", "doc_id % 2 = 0 AS path_there")
    return D.classified(rows, ignore_space=True)


@query(_RESOLVED + " SELECT anchor_id, status FROM c")
def anchor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("anchor_id", "status")


@query(_RESOLVED + " SELECT set_name, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in D.STATUSES) + " FROM c GROUP BY 1")
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tally(_resolved(spark, sf_dir))


@query(
    _RESOLVED
    + """, l AS (SELECT anchor_id, set_name, status, whole, anchor_id % 2 AS w, anchor_id % 3 AS i, anchor_id % 2 AS h FROM c),
    s AS (SELECT anchor_id, set_name, status, list_filter(CASE WHEN whole THEN [CASE WHEN i <> 0 THEN 'I' END, CASE WHEN w <> 0 THEN 'W' END, CASE WHEN h <> 0 THEN 'H' END] ELSE [CASE WHEN w <> i THEN 'W' END, CASE WHEN i <> h THEN 'I' END, CASE WHEN h <> 0 THEN 'H' END] END, lambda x: x IS NOT NULL) AS z FROM l)
    SELECT anchor_id, status, unnest(CASE WHEN len(z) = 0 THEN [NULL] ELSE z END) AS source FROM s WHERE status <> 'Fresh'"""
)
def drift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainders of the id stand for the contents of the layers, 0 for the anchored one."""
    rows = _resolved(spark, sf_dir)
    i = F.col("anchor_id")
    rows = rows.withColumn("sources", D.layer_sources(i % 2, i % 3, i % 2, F.lit(0), F.col("whole")))
    return D.findings(rows).select("anchor_id", "status", "source")


@query("WITH e AS (SELECT l_orderkey AS anchor_id, l_linenumber * 100000000 + l_partkey AS seq, l_partkey AS commit_id, l_partkey % 5 AS k, l_suppkey % 2 = 0 AS c FROM lineitem), h AS (SELECT * FROM e WHERE k IN (0, 1) OR (k = 2 AND c)) SELECT o.anchor_id, arg_min(CASE WHEN k = 2 THEN 'changed' ELSE 'orphaned' END, seq) AS kind, arg_min(commit_id, seq) AS commit_id FROM (SELECT DISTINCT anchor_id FROM e) o LEFT JOIN h USING (anchor_id) GROUP BY 1")
def drift_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views(spark, sf_dir, "lineitem")[0].selectExpr("l_orderkey AS anchor_id", "l_linenumber * 100000000 + l_partkey AS seq", "l_partkey AS commit_id", "CASE l_partkey % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'renamed' WHEN 2 THEN 'modified' ELSE 'added' END AS op", "l_suppkey % 2 = 0 AS slice_changed")
    return D.locus(e.select("anchor_id").distinct(), e)


@query("WITH a AS (SELECT o_orderkey AS k, o_custkey AS size FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(a.k, b.k)::varchar AS path, CASE WHEN a.k IS NULL THEN 'Added' WHEN b.k IS NULL THEN 'Deleted' ELSE 'Modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.size <> b.size")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders")[0].select(F.col("o_orderkey").alias("k"), "o_custkey")
    snap = lambda rows, size: rows.select(F.col("k").cast("string").alias("path"), size.alias("size"), F.lit(0).alias("mtime_ns"), F.lit(0).alias("ctime_ns"), F.lit(0).alias("ino"))
    return D.snapshot_diff(snap(o.where("k % 3 <> 0"), F.col("o_custkey")), snap(o.where("k % 4 <> 0"), F.when(F.col("k") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))))


@query("SELECT list_sort(list(o_custkey))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS bigint) + 1] AS value FROM orders")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nearest_rank(views(spark, sf_dir, "orders")[0], "o_custkey", 0.95)


@query("SELECT l_suppkey::varchar AS to_path, arg_max(l_partkey, (l_orderkey, l_linenumber)) AS blob FROM lineitem WHERE l_orderkey <= 5000 GROUP BY 1")
def path_at_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views(spark, sf_dir, "lineitem")[0].select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("entry_no"), F.col("l_suppkey").cast("string").alias("to_path"), F.col("l_partkey").alias("new_blob"))
    return D.path_at(c, 5000)


@query("SELECT l_orderkey AS commit_id, l_suppkey AS path FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (3, 5)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) GROUP BY 1, 2")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 commits that touch file 3 or 5, with all their files."""
    orders, lines = views(spark, sf_dir, "orders", "lineitem")
    commits = orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.array(F.lit(0)).alias("parents"))
    changes = lines.select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("path"))
    return D.recent_changes(commits, changes, 200, changes.where("path IN (3, 5)").select("path"))


@query(
    "WITH c AS (SELECT l_orderkey AS seq, l_linenumber AS n, l_partkey % 3 AS k, l_suppkey::varchar AS f, l_partkey::varchar AS t FROM lineitem), z AS (SELECT seq, sum(CASE WHEN k = 0 THEN 2 ELSE 1 END) AS n FROM c GROUP BY 1), j AS (SELECT c.*, z.n > 5 AS o FROM c JOIN z USING (seq)) "
    "SELECT seq, 'deleted' AS op, f AS from_path, f AS to_path FROM j WHERE o AND k = 0 UNION ALL SELECT seq, 'added', NULL, t FROM j WHERE o AND k IN (0, 1) UNION ALL SELECT seq, CASE k WHEN 0 THEN 'renamed' WHEN 1 THEN 'copied' ELSE 'modified' END, f, t FROM j WHERE NOT o OR k = 2"
)
def rename_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of five entries a commit."""
    c = views(spark, sf_dir, "lineitem")[0].selectExpr("l_orderkey AS seq", "CASE l_partkey % 3 WHEN 0 THEN 'renamed' WHEN 1 THEN 'copied' ELSE 'modified' END AS op", "CAST(l_suppkey AS string) AS from_path", "CAST(l_partkey AS string) AS to_path")
    return D.within_budget(c, 5)


# mutation and rendering

_STAGED = ", st AS (SELECT set_name, anchor_id AS line_no, CASE WHEN anchor_id % 6 = 0 THEN 'remove' ELSE 'add' END AS op, path, start_line, end_line, whole, anchor_id + 5000000 AS anchor_id FROM now WHERE anchor_id % 2 = 0)"


@query(
    NOW[:-1]
    + _STAGED
    + """, ad AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_name, path, start_line, end_line, whole ORDER BY line_no DESC) AS p FROM st WHERE op = 'add') WHERE p = 1),
    g AS (SELECT set_name, path, start_line, end_line, whole FROM st WHERE op = 'remove' UNION SELECT set_name, path, start_line, end_line, whole FROM ad),
    k AS (SELECT * FROM now n WHERE set_name IN (SELECT set_name FROM st) AND NOT EXISTS (SELECT 1 FROM g WHERE g.set_name = n.set_name AND g.path = n.path AND g.start_line IS NOT DISTINCT FROM n.start_line AND g.end_line IS NOT DISTINCT FROM n.end_line AND g.whole = n.whole))
    SELECT set_name, version::bigint AS version, anchor_id, path FROM now WHERE set_name NOT IN (SELECT set_name FROM st)
    UNION ALL SELECT k.set_name, n.version + 1, anchor_id, path FROM k JOIN newest n USING (set_name) UNION ALL SELECT ad.set_name, n.version + 1, anchor_id, path FROM ad JOIN newest n USING (set_name)"""
)
def commit_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second anchor is staged again, a third of those as removes."""
    now = C.at_version(_anchors(spark, sf_dir))
    staged = now.where("anchor_id % 2 = 0").select("set_name", F.col("anchor_id").alias("line_no"), F.when(F.col("anchor_id") % 6 == 0, "remove").otherwise("add").alias("op"), "path", "start", "end", "whole", (F.col("anchor_id") + 5000000).alias("anchor_id"))
    return M.committed(now, staged).select("set_name", "version", "anchor_id", "path")


@query(
    _RESOLVED
    + """ SELECT set_name, anchor_id, CASE WHEN anchor_id % 13 = 0 THEN 'skipped: staged' WHEN status = 'Fresh' AND anchor_id % 2 = 0 THEN 'unchanged' WHEN status = 'Fresh' THEN 'advanced' WHEN status = 'Orphaned' AND whole AND anchor_id % 3 = 0 THEN 'advanced' ELSE concat('skipped: ', lower(status)) END AS outcome FROM c"""
)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("anchor_id")
    rows = _resolved(spark, sf_dir).withColumns({"at_head": i % 2 == 0, "has_staged": i % 13 == 0, "head_blob": i % 3, "blob": F.lit(0)})
    return M.compacted(rows)


@query(
    _RESOLVED
    + """, s AS (SELECT set_name FROM c GROUP BY 1 HAVING NOT bool_or(status = 'Changed' AND anchor_id % 100 = 0)), d AS (SELECT * FROM c WHERE NOT (status = 'Changed' AND anchor_id % 100 <> 0))
    SELECT anchor_id, set_name FROM d JOIN s USING (set_name) WHERE status = 'Moved' AND NOT whole AND NOT renamed AND anchor_id % 3 <> 1"""
)
def auto_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only changed anchors whose id ends in 00 are kept, so that some sets have none."""
    rows = _resolved(spark, sf_dir).where("NOT (status = 'Changed' AND anchor_id % 100 <> 0)")
    return M.followed(rows.withColumns({"head_blob": F.col("anchor_id") % 3, "blob": F.lit(1)})).select("anchor_id", "set_name")


@query(A + "SELECT concat(set_name, ' ', CASE WHEN whole THEN path ELSE concat(path, '#L', start_line, '-L', end_line) END, ' 100%') AS line FROM anchors")
def format_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anchors(spark, sf_dir)
    rows = a.withColumn("address", P.address(F.col("path"), F.col("start"), F.col("end"), F.col("whole"))).withColumn("subject", F.col("set_name"))
    return K.formatted(rows, "%s %P 100%%")


@query(
    _RESOLVED
    + """ SELECT concat('::', CASE WHEN status = 'Moved' THEN 'warning' ELSE 'error' END, ' file=a', CASE WHEN whole THEN '' ELSE ',line=10,endLine=12' END, '::', set_name, ': ', lower(status)) AS line FROM c WHERE status <> 'Fresh'"""
)
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.annotation(_resolved(spark, sf_dir).where("status <> 'Fresh'"))


@query("SELECT doc_id, CASE WHEN regexp_matches(p, '(^|/)(dist|build|generated|node_modules|\\.next)/') OR regexp_extract(p, '[^/]*$') IN ('Cargo.lock', 'go.sum', '.gitignore') THEN true ELSE false END AS cross_cutting, CASE regexp_extract(p, '\\.([a-z0-9]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'md' THEN 'prose' WHEN 'lock' THEN 'lock' WHEN 'sum' THEN 'sum' WHEN 'gitignore' THEN 'gitignore' ELSE '?' END AS family, concat_ws('/', list_extract(string_split(p, '/'), 1), list_extract(string_split(p, '/'), 2), list_extract(string_split(p, '/'), 3)) AS folders FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'a/build/x/' ELSE 'redist/' END, CASE doc_id % 6 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'cargo.lock' WHEN 2 THEN 'm.rs' WHEN 3 THEN 'go.sum' WHEN 4 THEN '.gitignore' ELSE 'x.PY' END) AS q, replace(q, 'x.PY', 'x.py') AS p FROM documents)")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir, "documents")[0]
    q = d.selectExpr("doc_id", "concat(CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'a/build/x/' ELSE 'redist/' END, CASE doc_id % 6 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'cargo.lock' WHEN 2 THEN 'm.rs' WHEN 3 THEN 'go.sum' WHEN 4 THEN '.gitignore' ELSE 'x.py' END) AS p")
    return q.select("doc_id", P.is_cross_cutting(F.col("p")).alias("cross_cutting"), P.family(F.col("p")).alias("family"), P.top_folders(F.col("p")).alias("folders"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS ranged, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 + doc_id % 9 END::bigint AS start_line, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 5 + doc_id % 9 END::bigint AS end_line, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents")
def staging_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each document, its source being the set."""
    d = views(spark, sf_dir, "documents")[0]
    lines = d.selectExpr("source AS set_name", "doc_id AS line_no", "concat('add docs/', doc_id, '.txt', CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('#L', 1 + doc_id % 9, '-L', 5 + doc_id % 9) END) AS line")
    return L.staging(lines).select(F.col("line_no").alias("doc_id"), (~F.col("whole")).alias("ranged"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), "n")
