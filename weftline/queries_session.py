"""Queries of session suggestions over the stand-in event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import session as S
from .plans.stages import held
from .queries import query
from .standins import ctes, views

#: The log: views, errors and sign-ups are reads of ranges, clicks reads of whole files, purchases edits of whole files.
LOG = """log AS (SELECT sid, line_no, concat('src/m', CAST(v % 3 AS varchar(9)), '/f', CAST(v % 7 AS varchar(9)), '.rs') AS path, event_type,
    CASE WHEN event_type IN ('click', 'purchase') THEN NULL ELSE 1 + v % 60 END AS start_line, CASE WHEN event_type IN ('click', 'purchase') THEN NULL ELSE 10 + v % 60 + v % 13 END AS end_line,
    {ms} AS ts_ms, {hour} AS ts, event_type = 'purchase' AS is_edit FROM session_events)"""
SPARK_LOG = LOG.format(ms="unix_millis(CAST(ts AS timestamp))", hour="CAST(unix_millis(CAST(ts AS timestamp)) div 3600000 AS string)").replace("FROM session_events", "FROM {session_events}").replace("varchar(9)", "string")
#: The oracle's steps, each a CTE over the one before.
STEPS = (
    LOG.format(ms="epoch_ms(ts)", hour="CAST(epoch_ms(ts) // 3600000 AS varchar)")
    + """, kept AS (SELECT * FROM (SELECT *, count(*) OVER w AS crowd, bool_and(start_line IS NULL) OVER w AS bare FROM log WINDOW w AS (PARTITION BY sid, ts, is_edit)) WHERE NOT (crowd >= 3 AND (is_edit OR bare))),
    seq AS (SELECT *, row_number() OVER w AS o, is_edit AND start_line IS NULL AND coalesce(lag(is_edit AND start_line IS NULL) OVER w, false) AND coalesce(lag(path) OVER w = path, false) AS again FROM kept WINDOW w AS (PARTITION BY sid ORDER BY ts_ms, is_edit, line_no, path, start_line)),
    num AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY o) - 1 AS op FROM seq),
    ops AS (SELECT sid, CAST(op AS bigint) AS op_index, arg_min(path, o) AS path, min(CASE WHEN NOT again THEN start_line END) AS s, min(CASE WHEN NOT again THEN end_line END) AS e, bool_or(is_edit) AS is_edit, count(*) AS n FROM num GROUP BY 1, 2),
    loc AS (SELECT e.sid, e.op_index, arg_min(r.s, abs(r.op_index - e.op_index) + CASE WHEN r.op_index > e.op_index THEN 0.4 ELSE 0 END) AS inf_s, arg_min(r.e, abs(r.op_index - e.op_index) + CASE WHEN r.op_index > e.op_index THEN 0.4 ELSE 0 END) AS inf_e
      FROM ops e JOIN ops r ON r.sid = e.sid AND r.path = e.path AND NOT r.is_edit AND r.s IS NOT NULL AND abs(r.op_index - e.op_index) <= 6 WHERE e.is_edit GROUP BY 1, 2),
    o2 AS (SELECT o.*, inf_s, inf_e FROM ops o LEFT JOIN loc USING (sid, op_index)),
    p0 AS (SELECT *, coalesce(s, inf_s, 1) AS ps, coalesce(e, inf_e, 4294967295) AS pe, CASE WHEN coalesce(s, inf_s) IS NULL THEN 0 WHEN is_edit THEN 2 ELSE 1 END AS k FROM o2),
    p1 AS (SELECT * FROM (SELECT *, max(k) OVER (PARTITION BY sid, path) AS best FROM p0) WHERE k = best),
    p2 AS (SELECT *, max(pe) OVER (PARTITION BY sid, path ORDER BY ps, pe, op_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p1),
    p3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR ps > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY sid, path ORDER BY ps, pe, op_index) AS run FROM p2),
    parts AS (SELECT *, min(ps) OVER (PARTITION BY sid, path, run) AS ms, max(pe) OVER (PARTITION BY sid, path, run) AS me FROM p3),
    canon AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY path, ms, me) - 1 AS id FROM (SELECT DISTINCT sid, path, ms, me FROM parts)),
    known AS (SELECT p.*, c.id FROM parts p JOIN canon c USING (sid, path, ms, me)),
    win AS (SELECT a.sid, least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, 'operation-window' AS technique, b.op_index - a.op_index AS d, CASE WHEN a.is_edit OR b.is_edit THEN 1.25 ELSE 1.0 END AS w FROM known a JOIN known b ON a.sid = b.sid AND b.op_index > a.op_index AND b.op_index <= a.op_index + 5 AND a.id <> b.id),
    atom AS (SELECT sid, op_index, path, CASE WHEN is_edit THEN inf_s ELSE s END AS cs, CASE WHEN is_edit THEN inf_e ELSE e END AS ce FROM o2 WHERE CASE WHEN is_edit THEN inf_s ELSE s END IS NOT NULL),
    hit AS (SELECT k.sid, k.id AS edit_id, k.op_index, a.op_index AS at_op, arg_min(q.id, q.op_index) AS id FROM known k JOIN atom a ON a.sid = k.sid AND a.op_index BETWEEN k.op_index - 4 AND k.op_index - 1
      JOIN known q ON q.sid = k.sid AND q.path = a.path AND greatest(0, least(q.me, a.ce) - greatest(q.ms, a.cs) + 1) >= 0.3 * ((q.me - q.ms + 1) + (a.ce - a.cs + 1) - greatest(0, least(q.me, a.ce) - greatest(q.ms, a.cs) + 1))
      WHERE k.is_edit AND k.inf_s IS NOT NULL GROUP BY 1, 2, 3, 4),
    ev AS (SELECT * FROM win UNION ALL SELECT sid, least(id, edit_id), greatest(id, edit_id), 'locator-edit-context', op_index - at_op, 1.25 FROM hit WHERE id <> edit_id),
    pair AS (SELECT sid, lo, hi, avg(d) AS dist, count(*) FILTER (WHERE technique = 'locator-edit-context') AS edit_hits, sum(w) AS weighted_hits, count(DISTINCT technique) AS kinds FROM ev GROUP BY 1, 2, 3),
    edge AS (SELECT p.*, 0.16 * (1 - least(dist, 5) / 6) + 0.14 * least(edit_hits / 3, 1) + 0.12 * least(kinds / 4, 1) + 0.28 * 0.5 AS score FROM pair p JOIN canon a ON a.sid = p.sid AND a.id = lo JOIN canon b ON b.sid = p.sid AND b.id = hi WHERE a.path <> b.path),
    kept_edge AS (SELECT * FROM edge WHERE score >= 0.4 - 1e-12) """
)


def _oracle(select: str) -> str:
    return ctes("session_events")[:-1] + ", " + STEPS + select


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = spark.sql("WITH " + SPARK_LOG + " SELECT sid, line_no, path, start_line AS start, end_line AS end, ts, ts_ms, is_edit FROM log", session_events=views(spark, sf_dir, "session_events")[0])
    return log.where("NOT is_edit").drop("is_edit"), log.where("is_edit").drop("is_edit")


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ops = S.located(S.operations(*_log(spark, sf_dir)))
    parts = S.participants(ops)
    canon = S.canonical_ranges(parts)
    return ops, parts, canon, S.evidence(ops, parts, canon)


@query(_oracle("SELECT sid, op_index, CASE WHEN is_edit THEN 'edit' ELSE 'read' END AS kind, path, s AS start_line, e AS end_line, n AS count, inf_s AS inferred_start, inf_e AS inferred_end FROM o2"))
def session_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = S.located(S.operations(*_log(spark, sf_dir)))
    return ops.select("sid", "op_index", "kind", "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "count", "inferred_start", "inferred_end")


@query(_oracle("SELECT sid, op_index, path, ms AS m_start, me AS m_end, CASE k WHEN 0 THEN 'whole' WHEN 1 THEN 'read' ELSE 'edit' END AS source FROM parts"))
def session_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)[1].select("sid", "op_index", "path", "m_start", "m_end", "source")


@query(_oracle("SELECT sid, id, path, ms AS range_start, me AS range_end FROM canon"))
def session_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir)[2].select("sid", "id", "path", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


@query(_oracle("SELECT sid, lo, hi, technique, count(*) AS n, CAST(sum(d) AS bigint) AS distance, CAST(sum(w) AS double) AS weight FROM ev GROUP BY 1, 2, 3, 4"))
def session_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _steps(spark, sf_dir)[3]
    return found.groupBy("sid", "lo", "hi", "technique").agg(F.count("*").alias("n"), F.sum("op_distance").alias("distance"), F.sum("weight").alias("weight"))


@query(_oracle("SELECT sid, lo, hi, CAST(round(score, 6) AS double) AS score, round(dist, 6) AS mean_distance, edit_hits, CAST(weighted_hits AS double) AS weighted_hits FROM kept_edge"))
def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, canon, found = _steps(spark, sf_dir)
    kept = S.edges(found, canon)
    return kept.select("sid", "lo", "hi", F.round("score", 6).alias("score"), F.round("mean_distance", 6).alias("mean_distance"), "edit_hits", "weighted_hits")


@query(
    _oracle(
        """, adj AS (SELECT sid, lo AS x, hi AS y FROM kept_edge UNION ALL SELECT sid, hi, lo FROM kept_edge),
    tri AS (SELECT a.sid, a.lo AS x, a.hi AS y, b.hi AS z FROM kept_edge a JOIN kept_edge b ON a.sid = b.sid AND a.hi = b.lo JOIN kept_edge c ON c.sid = a.sid AND c.lo = a.lo AND c.hi = b.hi)
    SELECT t.sid, concat(x, ',', y, ',', z) AS ids FROM tri t WHERE NOT EXISTS (SELECT 1 FROM adj p JOIN adj q ON p.sid = q.sid AND p.y = q.y JOIN adj r ON r.sid = p.sid AND r.y = p.y WHERE p.sid = t.sid AND p.x = t.x AND q.x = t.y AND r.x = t.z)"""
    ).replace("score >= 0.4 - 1e-12", "score >= 0.32")
)
def session_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal cliques of three ranges, with a floor of 0.32 for the edges, as the stand-in log has few strong ones."""
    _, _, canon, found = _steps(spark, sf_dir)
    groups = S.cliques(S.edges(found, canon, s=S.Settings(edge_floor=0.32))).where("size(ids) = 3")
    return groups.select("sid", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query()
def session_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline; cliques of any size aren't SQL, so tests compare it with a plain walk."""
    shown = S.suggest(*_log(spark, sf_dir))
    return shown.select("sid", "place", F.to_json("participants").alias("participants"), "size", "composite", "band", "viability", "density", "edit_hits")


_TOK = """, tok AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda t: NOT list_contains(""" + str(list(T.KEYWORDS)).replace('"', "'") + """, t)))) AS ids FROM documents)"""


@query("WITH z AS (SELECT 1)" + _TOK + " SELECT doc_id, array_to_string(ids, ' ') AS identifiers FROM tok")
def range_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of each whole document."""
    docs = views(spark, sf_dir, "documents")[0]
    return docs.select("doc_id", F.array_join(T.identifiers(F.col("text")), " ").alias("identifiers"))


def _documents_as_ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = views(spark, sf_dir, "documents")[0]
    canon = docs.select(F.col("source").alias("sid"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.lit(1).cast("bigint").alias("start"), F.lit(2**31 - 1).cast("bigint").alias("end")).hint("shuffle_hash")  # without texts
    joined = held(S.joined_identifiers(canon, docs.select(F.col("doc_id").cast("string").alias("path"), "text")))  # read several times, and slow to make
    tokens = S.split_identifiers(joined)
    return tokens, S.inverse_frequency(tokens)


@query(
    "WITH z AS (SELECT 1)"
    + _TOK
    + """, n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, unnest(ids) AS token FROM tok JOIN documents USING (doc_id))
    SELECT source AS sid, token, round(ln((any_value(n.n) + 1) / (1 + count(*))), 6) AS idf FROM e JOIN n USING (source) GROUP BY 1, 2"""
)
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source stand for the ranges of a session."""
    _, idf = _documents_as_ranges(spark, sf_dir)
    return idf.select("sid", "token", F.round("idf", 6).alias("idf"))


@query(
    "WITH z AS (SELECT 1)"
    + _TOK
    + """, d AS (SELECT source, doc_id, ids, array_to_string(ids, ' ') AS s FROM tok JOIN documents USING (doc_id)),
    g AS (SELECT *, CASE WHEN length(s) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, CAST(i AS int), 3))) END AS tri FROM d),
    n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, unnest(ids) AS token FROM d),
    f AS (SELECT source, token, ln((any_value(n.n) + 1) / (1 + count(*))) AS idf FROM e JOIN n USING (source) GROUP BY 1, 2),
    r AS (SELECT source, token FROM e GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 3), o AS (SELECT source, doc_id, unnest(ids) AS token FROM d), h AS (SELECT * FROM o JOIN r USING (source, token)),
    q AS (SELECT DISTINCT a.source, a.doc_id AS lo, b.doc_id AS hi FROM h a JOIN h b ON a.source = b.source AND a.token = b.token AND a.doc_id < b.doc_id),
    p AS (SELECT q.source, lo, hi, a.ids AS x, b.ids AS y, a.tri AS t, b.tri AS u FROM q JOIN g a ON a.doc_id = lo JOIN g b ON b.doc_id = hi),
    w AS (SELECT source, lo, hi, least(sum(idf) / 6, 1) AS s FROM (SELECT source, lo, hi, unnest(list_filter(list_intersect(x, y), lambda k: length(k) >= 4)) AS token FROM p) JOIN f USING (source, token) GROUP BY 1, 2, 3),
    j AS (SELECT source, lo, hi, CASE WHEN len(t) = 0 OR len(u) = 0 THEN 0 ELSE len(list_intersect(t, u)) / (len(t) + len(u) - len(list_intersect(t, u))) END AS tri FROM p)
    SELECT source AS sid, lo, hi, round(greatest(coalesce(s, 0), tri), 6) AS cohesion, CAST(round(tri, 6) AS double) AS trigram FROM j LEFT JOIN w USING (source, lo, hi)"""
)
def pair_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source with an identifier that two or three of its documents hold stand for pairs of ranges."""
    tokens, _ = _documents_as_ranges(spark, sf_dir)
    holders = held(S.token_holders(tokens))
    found = S.pair_cohesion(S.sharing(holders.where("n <= 3")), tokens, None, holders=holders)
    return found.select("sid", "lo", "hi", F.round("cohesion", 6).alias("cohesion"), F.round("trigram", 6).alias("trigram"))
