"""Queries of the layers over the catalog, of what a session is told, of checks and of outputs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import ranges as R
from .operators import advice as A
from .operators import layers as L
from .operators import mining as M
from .queries import query
from .standins import ctes, views

#: Changes of layers: orders' priorities and numbers stand for what happened to which path.
_CHANGES = "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'index' ELSE 'worktree' END AS layer, CASE o_custkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'mode' END AS op, concat('docs/', CAST(o_custkey % 90 AS varchar(10)), '.txt') AS from_path, concat('docs/', CAST(CASE WHEN o_custkey % 5 = 3 THEN o_custkey % 70 ELSE o_custkey % 90 END AS varchar(10)), '.txt') AS to_path, o_orderkey % 11 = 0 AS unmerged FROM {orders}"
#: Staged operations: customers stand for them.
_STAGED = "SELECT concat('set/', CAST(c_custkey % 40 AS varchar(10))) AS set_name, CASE c_custkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'why' ELSE 'note' END AS op, concat('docs/', CAST(c_nationkey AS varchar(10)), '.txt') AS path, CAST(c_custkey % 30 AS bigint) AS start, CAST(c_custkey % 30 + 5 AS bigint) AS end_, c_custkey % 7 = 0 AS whole FROM {customer}"
#: Committed anchors of sets: suppliers stand for them.
_HELD = "SELECT concat('set/', CAST(s_suppkey % 50 AS varchar(10))) AS set_name, s_suppkey AS anchor_id, concat('docs/', CAST(s_nationkey AS varchar(10)), '.txt') AS path, CAST(s_suppkey % 30 AS bigint) AS start, CAST(s_suppkey % 30 + 5 AS bigint) AS end_, s_suppkey % 7 = 0 AS whole FROM {supplier}"

_ALL = {"changes": (_CHANGES, "orders"), "staged": (_STAGED, "customer"), "held": (_HELD, "supplier")}


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_ALL[n][0].format(**{_ALL[n][1]: _ALL[n][1]})})" for n in names) + " "


def _get(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, table = _ALL[name]
    out = spark.sql(text, **{table: views(spark, sf_dir, table)[0]})
    return out.withColumnRenamed("end_", "end")


@query(_with("changes") + "SELECT coalesce(bool_or(layer = 'index'), false) AS index_dirty, coalesce(bool_or(layer = 'worktree'), false) AS worktree_dirty, coalesce(bool_or(unmerged), false) AS conflicted, count(DISTINCT CASE WHEN layer = 'index' THEN to_path END) AS index_paths, count(DISTINCT CASE WHEN layer = 'worktree' THEN to_path END) AS worktree_paths FROM changes")
def layer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.layer_probe(_get(spark, sf_dir, "changes"))


@query(_with("changes") + "SELECT DISTINCT op, from_path, to_path FROM changes WHERE layer = 'index'")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.layer_diff(_get(spark, sf_dir, "changes"), "index")


@query(_with("changes", "held") + "SELECT DISTINCT op, from_path, to_path FROM changes WHERE layer = 'worktree' AND (to_path IN (SELECT path FROM held) OR from_path IN (SELECT path FROM held))")
def worktree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the paths that anchors are on."""
    return L.layer_diff(_get(spark, sf_dir, "changes"), "worktree", _get(spark, sf_dir, "held"))


@query(_with("changes") + "SELECT DISTINCT to_path AS path FROM changes WHERE unmerged")
def conflicted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.conflicted(_get(spark, sf_dir, "changes"))


@query(_with("changes", "staged") + "SELECT from_path AS path FROM changes UNION SELECT to_path FROM changes UNION SELECT path FROM staged")
def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dirty_paths(_get(spark, sf_dir, "changes"), _get(spark, sf_dir, "staged"))


@query(_with("held") + "SELECT path, sha256(CASE WHEN n_nationkey IS NULL THEN 'missing' || chr(0) ELSE 'file' || chr(0) || n_name END) AS print FROM (SELECT DISTINCT path FROM held) h LEFT JOIN nation ON path = concat('docs/', CAST(n_nationkey * 2 AS varchar), '.txt')")
def path_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for the contents of every second path."""
    nation = views(spark, sf_dir, "nation")[0]
    contents = nation.select(F.concat(F.lit("docs/"), (F.col("n_nationkey") * 2).cast("string"), F.lit(".txt")).alias("path"), F.lit("file").alias("kind"), F.col("n_name").alias("body"))
    return L.path_fingerprints(_get(spark, sf_dir, "held"), contents)


@query("WITH s AS (SELECT concat('set/', CAST(s_suppkey % 50 AS varchar)) AS set_name, s_nationkey % 3 = 0 OR s_suppkey % 9 = 1 OR s_suppkey % 50 % 2 = 1 AND s_suppkey % 50 < 20 AS bad FROM supplier) SELECT set_name FROM s GROUP BY 1 HAVING NOT bool_or(bad)")
def clean_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of every third nation are dirty; remainders of the key stand for blobs and commits."""
    rows = views(spark, sf_dir, "supplier")[0].select(
        F.concat(F.lit("set/"), (F.col("s_suppkey") % 50).cast("string")).alias("set_name"),
        F.col("s_nationkey").alias("path"),
        F.when((F.col("s_suppkey") % 50 % 2 == 1) & (F.col("s_suppkey") % 50 < 20), 6).otherwise(7).alias("commit_id"),
        F.lit(0).alias("blob"),
        (F.col("s_suppkey") % 9 == 1).cast("int").alias("head_blob"),
    )
    return L.clean_sets(rows, rows.where("path % 3 = 0").select("path"), 7)


@query(_with("held") + "SELECT set_name, anchor_id, path FROM held WHERE anchor_id IN (3, 4)")
def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor 3 has a reference; anchor 4 is found by a look at all sets."""
    held = _get(spark, sf_dir, "held")
    refs = held.where("anchor_id = 3").select("anchor_id", "set_name")
    return L.anchor_by_id(held, refs, 3).union(L.anchor_by_id(held, refs, 4)).select("set_name", "anchor_id", "path")


@query(_with("held") + ", w AS (SELECT r_regionkey AS ord, concat('set/', CAST(60 - r_regionkey * 8 AS varchar)) AS set_name FROM region) SELECT ord, set_name, anchor_id, CASE WHEN anchor_id % 13 <> 0 THEN path END AS path, CASE WHEN anchor_id IS NULL THEN 'unknown set' WHEN anchor_id % 13 = 0 THEN 'orphaned' ELSE 'resolved' END AS status FROM w LEFT JOIN held USING (set_name)")
def named_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets are asked for by regions; anchors of every thirteenth supplier have no record."""
    held = _get(spark, sf_dir, "held").withColumn("path", F.when(F.col("anchor_id") % 13 != 0, F.col("path")))
    region = views(spark, sf_dir, "region")[0]
    return L.resolve_named(held, region.select(F.col("r_regionkey").alias("ord"), F.concat(F.lit("set/"), (60 - F.col("r_regionkey") * 8).cast("string")).alias("set_name")))


@query(_with("staged") + "SELECT DISTINCT set_name FROM staged WHERE op IN ('add', 'remove', 'config', 'why')")
def staged_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.staged_only(_get(spark, sf_dir, "staged"))


@query(
    _with("held", "staged")
    + """, h AS (SELECT set_name, path, start, end_, whole FROM held), r AS (SELECT DISTINCT set_name, path, start, end_, whole FROM staged WHERE op = 'remove'), a AS (SELECT DISTINCT set_name, path, start, end_, whole FROM staged WHERE op = 'add')
    SELECT set_name, path, start, end_ AS "end", whole, 'committed' AS state FROM h WHERE (set_name, path, start, end_, whole) NOT IN (SELECT * FROM r)
    UNION ALL SELECT *, 'staged' FROM (SELECT set_name, path, start, end_ AS "end", whole FROM a WHERE (set_name, path, start, end_, whole) NOT IN (SELECT * FROM h))"""
)
def shown_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shown_anchors(_get(spark, sf_dir, "held"), _get(spark, sf_dir, "staged"))


_TARGETS = ("docs/3.txt#L4-L9", "set/5", "set/39", "docs/1?.txt", "docs/7.txt", "docs/none.txt", "docs/99.txt")


@query(
    _with("held", "staged")
    + """, a AS (SELECT set_name, path, start, end_, whole FROM held UNION ALL SELECT set_name, path, start, end_, whole FROM staged WHERE op = 'add'),
    f AS (SELECT 'docs/3.txt#L4-L9' AS target, set_name, 0 AS rule FROM a WHERE path = 'docs/3.txt' AND (whole OR start <= 9 AND end_ >= 4)
      UNION SELECT set_name, set_name, 1 FROM held WHERE set_name IN ('set/5', 'set/39') UNION SELECT set_name, set_name, 2 FROM staged WHERE set_name IN ('set/5', 'set/39')
      UNION SELECT 'docs/1?.txt', set_name, 3 FROM a WHERE regexp_full_match(path, 'docs/1[^/]\\.txt')
      UNION SELECT path, set_name, 4 FROM a WHERE path IN ('docs/7.txt', 'docs/none.txt', 'docs/99.txt')),
    b AS (SELECT target, set_name, CAST(rule AS varchar) AS rule FROM f QUALIFY rule = min(rule) OVER (PARTITION BY target))
    SELECT * FROM b UNION ALL SELECT t, NULL, CASE t WHEN 'docs/99.txt' THEN 'no sets' ELSE 'missing' END FROM (SELECT unnest(['docs/3.txt#L4-L9', 'set/5', 'set/39', 'docs/1?.txt', 'docs/7.txt', 'docs/none.txt', 'docs/99.txt']) AS t) WHERE t NOT IN (SELECT target FROM b)"""
)
def target_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target for each rule, a file without sets, and one that is nowhere."""
    files = spark.createDataFrame([("docs/99.txt",)], "path string")
    return L.target_cascade(_get(spark, sf_dir, "held"), _get(spark, sf_dir, "staged"), files, list(_TARGETS))


@query(_with("held", "staged") + "SELECT DISTINCT path FROM staged WHERE (SELECT count(DISTINCT path) FROM staged) <= 100 AND path NOT IN (SELECT path FROM held WHERE whole)")
def copy_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged paths stand for those of all references, within the budget; whole anchors for added files."""
    held, staged = _get(spark, sf_dir, "held"), _get(spark, sf_dir, "staged")
    return L.copy_pool(held, held.where("whole").select("path"), "any-file-in-repo", all_refs=staged, budget=100)


@query("SELECT o_clerk AS value, min(o_orderkey) AS place FROM (SELECT concat('refs/', CAST(o_custkey % 37 AS varchar)) AS o_clerk, o_orderkey FROM orders) GROUP BY 1")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders")[0]
    return L.first_of_each(o.select(F.concat(F.lit("refs/"), (F.col("o_custkey") % 37).cast("string")).alias("value"), F.col("o_orderkey").alias("place")), "value", "place")


@query(_with("held") + "SELECT anchor_id, '`' || set_name || '` `' || CASE WHEN whole THEN path ELSE path || '#L' || start || '-L' || end_ END || '`' AS line FROM held")
def one_line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _get(spark, sf_dir, "held").select("anchor_id", L.one_line(*map(F.col, ("set_name", "path", "start", "end", "whole"))).alias("line"))


# what a session is told

_TOUCHES = "SELECT user_id AS sid, event_id AS line_no, concat('docs/', CAST(CAST(floor(value) AS bigint) % 25 AS varchar(10)), '.txt') AS path, CASE event_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'mode' ELSE 'modified' END AS kind, CAST(event_id % 40 AS bigint) AS start, CAST(event_id % 40 + 3 AS bigint) AS end_ FROM {events}"
_ALL["touches"] = (_TOUCHES, "events")


@query(_with("touches") + "SELECT sid, path, min(line_no) AS first FROM touches WHERE kind <> 'mode' GROUP BY 1, 2")
def touched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.touched_paths(_get(spark, sf_dir, "touches"))


@query(_with("touches", "held") + ", m AS (SELECT sid, set_name, line_no, anchor_id FROM touches t JOIN held h ON t.path = h.path WHERE kind NOT IN ('added', 'deleted') AND NOT h.whole AND t.start <= h.end_ AND t.end_ >= h.start) SELECT sid, set_name, min(line_no) AS touch_no, min(struct_pack(a := line_no, b := anchor_id)).b AS anchor_id FROM m GROUP BY 1, 2")
def touched_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.touched_sets(_get(spark, sf_dir, "touches"), _get(spark, sf_dir, "held").withColumn("anchor_no", F.col("anchor_id")))


@query("WITH b AS (SELECT s_suppkey AS name, s_nationkey AS oid FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_nationkey END AS oid FROM supplier) SELECT n.name FROM n LEFT JOIN b USING (name) WHERE b.oid IS NULL OR b.oid <> n.oid")
def sets_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views(spark, sf_dir, "supplier")[0].select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("oid"))
    return A.changed_since(s.where("name % 3 <> 0"), s.withColumn("oid", F.when(F.col("name") % 5 == 0, -1).otherwise(F.col("oid"))))


@query(_with("touches") + ", p AS (SELECT DISTINCT path, kind, start, end_ FROM touches WHERE line_no % 2 = 0), k AS (SELECT DISTINCT path, kind, start, end_ FROM touches WHERE line_no % 3 = 0) SELECT path, kind, start, end_ AS \"end\" FROM p WHERE (path, kind, start, end_) NOT IN (SELECT * FROM k)")
def new_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second touch is pending, every third one known."""
    t = _get(spark, sf_dir, "touches")
    return A.new_touches(t.where("line_no % 2 = 0"), t.where("line_no % 3 = 0")).select("path", "kind", "start", "end")


@query("WITH b AS (SELECT s_suppkey AS path, s_suppkey // 2 AS blob FROM supplier WHERE s_suppkey % 3 <> 0), a AS (SELECT s_suppkey AS path, CASE WHEN s_suppkey % 10 = 4 THEN -s_suppkey ELSE s_suppkey // 2 END AS blob FROM supplier WHERE s_suppkey % 4 <> 0), f AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, coalesce(b.blob, a.blob) AS blob FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.blob <> b.blob), r AS (SELECT *, row_number() OVER (PARTITION BY change, blob ORDER BY path) AS i FROM f), m AS (SELECT x.path, y.path AS from_path FROM r x JOIN r y ON x.blob = y.blob AND x.i = y.i AND x.change = 'added' AND y.change = 'deleted') SELECT path, 'renamed' AS change, from_path FROM m UNION ALL SELECT path, change, NULL FROM f WHERE path NOT IN (SELECT path FROM m) AND path NOT IN (SELECT from_path FROM m)")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views(spark, sf_dir, "supplier")[0].select(F.col("s_suppkey").alias("path"), F.expr("s_suppkey div 2").alias("blob"), F.lit(0).alias("mode"))
    after = s.where("path % 4 <> 0").withColumn("blob", F.when(F.col("path") % 10 == 4, -F.col("path")).otherwise(F.col("blob")))
    return A.tree_changes(s.where("path % 3 <> 0"), after).select("path", "change", F.col("from_path").cast("bigint").alias("from_path"))


#: Paths that a suggestion may name (the first three) and that each break one rule, by a part's number.
_NAMES = ("src/a.rs", "a/b/c", "notes.txt", "/abs/a.rs", "dir/sub/", "plain", "a/b", "logs/yarn-validate-output.log", "x/.last-flush/a.rs", "x/analyze-v12.mjs", "x/suggestions-v3.md", "")


@query("SELECT p_partkey, p_partkey % 12 < 3 AS ok FROM part")
def acceptable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views(spark, sf_dir, "part")[0]
    path = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return part.select("p_partkey", P.is_acceptable(path).alias("ok"))


#: Messages of commits: fixes, updates of dependencies, both, and neither (a fix is a word of its own).
_MESSAGES = ("fix: broken range", "Hotfix for the parser", "closes #41", "closes the escape loophole", "bump serde version", "Upgrade all deps", "chore(deps): lock", "renovate run", "revert: bump packages", "prefix of names", "add a page", "update the text")


@query("SELECT o_orderkey AS commit_id, o_orderkey % 12 IN (0, 1, 2, 3, 8) AS fix, o_orderkey % 12 IN (4, 5, 6, 7, 8) AS dependencies FROM orders")
def commit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which commits mend faults and which only update dependencies, by their messages."""
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("o_orderkey") % len(_MESSAGES) + 1).cast("int"))
    return views(spark, sf_dir, "orders")[0].select(F.col("o_orderkey").alias("commit_id"), P.is_fix(message).alias("fix"), P.is_dependency_update(message).alias("dependencies"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN l_orderkey % 5 = 0 ELSE l_orderkey % 5 <> 0 AND l_partkey % 50 <= l_suppkey % 60 + 2 AND l_partkey % 50 + l_linenumber >= l_suppkey % 60 END AS met FROM lineitem")
def range_read_meets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of three lines, whole files in second lines, against anchors, whole files in every fifth order."""
    li = views(spark, sf_dir, "lineitem")[0]
    s, q = F.col("l_partkey") % 50, F.when(F.col("l_linenumber") != 2, F.col("l_suppkey") % 60)
    return li.select("l_orderkey", "l_linenumber", R.read_meets(s, s + F.col("l_linenumber"), F.col("l_orderkey") % 5 == 0, q, q + 2).alias("met"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'src/a.rs#' || trim(p_name[:60]) ELSE 'src/a.rs#L' || (p_partkey // 100 * 100 + 1) || '-L' || (p_partkey // 100 * 100 + 100) END AS key FROM part")
def hunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names stand for headings of every third size, keys from 0 for lines from 1."""
    part = views(spark, sf_dir, "part")[0]
    heading = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("## * "), F.col("p_name")))
    return part.select("p_partkey", P.hunk_key(F.lit("src/a.rs"), heading, F.col("p_partkey") + 1).alias("key"))


@query("SELECT o_orderkey AS commit_id, CASE WHEN o_custkey % 3 = 0 THEN 'ticket:AB-' || o_custkey WHEN o_custkey % 3 = 1 THEN 'ticket:XY-' || o_orderkey % 10 ELSE 'scope:core' || o_orderkey % 5 END AS key FROM orders")
def message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders")[0]
    subject = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("work on AB-"), F.col("o_custkey"))).otherwise(F.concat(F.lit("fix(Core"), F.col("o_orderkey") % 5, F.lit("): it")))
    body = F.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("see XY-"), F.col("o_orderkey") % 10)).otherwise(F.lit(""))
    return M.message_keys(o.select(F.col("o_orderkey").alias("commit_id"), subject.alias("subject"), body.alias("body")))


@query(ctes("commits") + ", p AS (SELECT author AS a, author + 1 AS b, count(*) AS n FROM commits GROUP BY 1) SELECT a, b FROM p ORDER BY n DESC, a LIMIT 10")
def top_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views(spark, sf_dir, "commits")[0].groupBy(F.col("author").alias("a")).agg(F.count("*").alias("n"))
    return M.top_slice(rows, [F.desc("n"), F.asc("a")], n=10).select("a", (F.col("a") + 1).alias("b"))
