"""Queries of history mining over the stand-in commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mining as M
from .operators.advice import capped_clusters as clusters
from .plans.stages import held
from .queries import query
from .standins import ctes, views

#: Files of usable commits. Stand-in commits have at most seven files, so a sweep here takes four values.
USABLE = """usable AS (SELECT f.* FROM commit_files f JOIN (SELECT commit_id FROM commit_files GROUP BY commit_id
  HAVING count(*) BETWEEN 2 AND 40 AND NOT (count(*) >= 4 AND stddev_pop(churn) < 0.2 * avg(churn))) k USING (commit_id))"""
HEAVY = USABLE + """, heavy AS (SELECT u.*, 1 / log2(n + 1) AS w FROM usable u JOIN (SELECT commit_id, count(*) AS n FROM usable GROUP BY 1) c USING (commit_id))"""


def _with(*names: str, more: str = USABLE) -> str:
    return ctes(*names)[:-1] + ", " + more + " "


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.usable_files(views(spark, sf_dir, "commit_files")[0], sweep_values=4)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(_with("commit_files") + "SELECT commit_id, CAST(count(*) AS bigint) AS n, sum(churn) AS churn FROM usable GROUP BY commit_id")
def usable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable(spark, sf_dir).groupBy("commit_id").agg(F.count("*").alias("n"), F.sum("churn").alias("churn"))


@query(_with("commit_files", more=HEAVY) + "SELECT file, round(sum(w), 6) AS support, count(*) AS commits FROM heavy GROUP BY file")
def item_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.item_support(_usable(spark, sf_dir)), "support")


@query(
    _with("commits", "commit_files", more=HEAVY)
    + """, s AS (SELECT file, sum(w) AS s FROM heavy GROUP BY file),
    p AS (SELECT x.file AS a, y.file AS b, sum(x.w) AS support FROM heavy x JOIN heavy y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2 HAVING sum(x.w) >= 4),
    c AS (SELECT p.*, support / sa.s AS conf_ab, support / sb.s AS conf_ba, greatest(support / sa.s, support / sb.s) AS conf FROM p JOIN s sa ON sa.file = a JOIN s sb ON sb.file = b),
    who AS (SELECT DISTINCT file, author FROM usable JOIN commits USING (commit_id)),
    n AS (SELECT file, count(*) AS n FROM who GROUP BY file),
    j AS (SELECT c.*, (SELECT count(*) FROM who v JOIN who w ON v.author = w.author WHERE v.file = a AND w.file = b) AS both_n FROM c WHERE conf >= 0.02)
    SELECT a, b, round(support, 6) AS support, round(conf_ab, 6) AS conf_ab, round(conf_ba, 6) AS conf_ba, round(conf, 6) AS conf,
      round(both_n / (na.n + nb.n - both_n), 6) AS jaccard, round(support * conf * (1 - both_n / (na.n + nb.n - both_n)), 6) AS hidden
    FROM j JOIN n na ON na.file = a JOIN n nb ON nb.file = b"""
)
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of 0.02, as the stand-in files are changed nearly independently."""
    found = M.file_pairs(_usable(spark, sf_dir), views(spark, sf_dir, "commits")[0], confidence=0.02)
    return _rounded(found, "support", "conf_ab", "conf_ba", "conf", "jaccard", "hidden")


_SETS = """, one AS (SELECT file, count(*) AS n FROM usable GROUP BY file HAVING count(*) >= 3),
    u AS (SELECT commit_id, file FROM usable JOIN one USING (file)),
    two AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM u x JOIN u y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 3),
    three AS (SELECT x.file AS a, y.file AS b, z.file AS c, count(*) AS n FROM u x JOIN u y ON x.commit_id = y.commit_id AND x.file < y.file JOIN u z ON z.commit_id = y.commit_id AND y.file < z.file GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    sets AS (SELECT CAST(file AS varchar) AS items, 1 AS size, n FROM one UNION ALL SELECT concat(a, ',', b), 2, n FROM two UNION ALL SELECT concat(a, ',', b, ',', c), 3, n FROM three) """


@query(_with("commit_files") + _SETS + "SELECT items, size, n FROM sets")
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.itemsets(_usable(spark, sf_dir))
    named = F.when(F.element_at("items", 1).isNotNull(), F.array_join(F.col("items").cast("array<string>"), ","))  # a file without a key is a set of its own
    return found.select(named.alias("items"), F.size("items").alias("size"), "n")


@query(
    _with("commit_files")
    + _SETS
    + """, t AS (SELECT count(DISTINCT commit_id) AS t FROM usable),
    split AS (SELECT CAST(a AS varchar) AS lhs, CAST(b AS varchar) AS rhs, n FROM two UNION ALL SELECT CAST(b AS varchar), CAST(a AS varchar), n FROM two
      UNION ALL SELECT CAST(a AS varchar), concat(b, ',', c), n FROM three UNION ALL SELECT CAST(b AS varchar), concat(a, ',', c), n FROM three
      UNION ALL SELECT CAST(c AS varchar), concat(a, ',', b), n FROM three UNION ALL SELECT concat(b, ',', c), CAST(a AS varchar), n FROM three
      UNION ALL SELECT concat(a, ',', c), CAST(b AS varchar), n FROM three UNION ALL SELECT concat(a, ',', b), CAST(c AS varchar), n FROM three)
    SELECT lhs, rhs, s.n, round(s.n / l.n, 6) AS confidence, round(s.n * t / (CAST(l.n AS double) * r.n), 6) AS lift, round(s.n / t - (l.n / t) * (r.n / t), 6) AS leverage
    FROM split s JOIN sets l ON l.items = lhs JOIN sets r ON r.items = rhs, t WHERE s.n * t / (CAST(l.n AS double) * r.n) >= 1.5"""
)
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _usable(spark, sf_dir)
    total = files.select("commit_id").distinct().count()
    found = M.rules(held(M.itemsets(files)), total)  # the rules read the sets three times
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _rounded(found.select(flat("lhs"), flat("rhs"), "n", "confidence", "lift", "leverage"), "confidence", "lift", "leverage")


@query(
    _with("commits", "commit_files")
    + """, c AS (SELECT commit_id, ts, row_number() OVER (ORDER BY ts, commit_id) AS p FROM commits WHERE commit_id IN (SELECT commit_id FROM usable))
    SELECT f.file AS earlier, g.file AS later, count(*) AS n FROM c x JOIN c y ON y.p > x.p AND y.p <= x.p + 5 AND epoch(y.ts) - epoch(x.ts) <= 7 * 86400
    JOIN usable f ON f.commit_id = x.commit_id JOIN usable g ON g.commit_id = y.commit_id WHERE f.file <> g.file GROUP BY 1, 2"""
)
def lagged_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.lagged_pairs(_usable(spark, sf_dir), views(spark, sf_dir, "commits")[0])


_AGED = """, c AS (SELECT commit_id, row_number() OVER (ORDER BY ts DESC, commit_id DESC) - 1 AS recency FROM commits WHERE commit_id IN (SELECT commit_id FROM commit_files)),
    z AS (SELECT commit_id, count(*) AS size FROM commit_files GROUP BY 1),
    cap AS (SELECT greatest(12, least(list_sort(list(size))[CAST(floor(0.9 * count(*)) AS bigint) + 1], 20)) AS cap FROM z)"""


@query(ctes("commit_files")[:-1] + ", z AS (SELECT commit_id, count(*) AS size FROM commit_files GROUP BY 1) SELECT CAST(greatest(12, least(list_sort(list(size))[CAST(floor(0.9 * count(*)) AS bigint) + 1], 20)) AS bigint) AS cap FROM z")
def mass_change_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.size_cap(views(spark, sf_dir, "commit_files")[0])


@query(
    ctes("commits", "commit_files")[:-1]
    + _AGED
    + """ SELECT x.file AS a, y.file AS b, count(*) AS shared, round(sum(exp(-recency / 200.0)), 6) AS weight FROM commit_files x JOIN commit_files y ON x.commit_id = y.commit_id AND x.file < y.file
    JOIN c ON c.commit_id = x.commit_id JOIN z ON z.commit_id = x.commit_id, cap WHERE size <= cap GROUP BY 1, 2"""
)
def pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, files = views(spark, sf_dir, "commits", "commit_files")
    return _rounded(M.pair_history(files, commits), "weight")


@query(ctes("commits", "commit_files") + "SELECT file, CAST(floor(epoch(ts) / 604800) AS bigint) AS week, sum(churn) AS churn FROM commit_files JOIN commits USING (commit_id) GROUP BY 1, 2")
def weekly_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, files = views(spark, sf_dir, "commits", "commit_files")
    return M.weekly_churn(files, commits)


#: Pairs whose churn is compared: those that changed together six times or more.
_CORR = """, k AS (SELECT file, floor(epoch(ts) / 604800) AS week, sum(churn) AS churn FROM commit_files JOIN commits USING (commit_id) GROUP BY 1, 2),
    cand AS (SELECT x.file AS a, y.file AS b FROM commit_files x JOIN commit_files y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 6),
    sides AS (SELECT a, b, week, churn AS x, 0 AS y FROM cand JOIN k ON k.file = a UNION ALL SELECT a, b, week, 0, churn FROM cand JOIN k ON k.file = b),
    al AS (SELECT a, b, week, sum(x) AS x, sum(y) AS y FROM sides GROUP BY 1, 2, 3),
    pl AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY week) AS place, count(*) OVER (PARTITION BY a, b) AS weeks FROM al)"""


@query(
    ctes("commits", "commit_files")[:-1]
    + _CORR
    + """, rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM pl WHERE weeks >= 6),
    ls AS (SELECT p.a, p.b, l, p.x, q.y FROM pl p, (SELECT unnest([-4, -3, -2, -1, 1, 2, 3, 4]) AS l) s, pl q WHERE p.weeks >= 6 AND q.a = p.a AND q.b = p.b AND q.place = p.place + l),
    lr AS (SELECT *, rank() OVER (PARTITION BY a, b, l ORDER BY x) + (count(*) OVER (PARTITION BY a, b, l, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b, l ORDER BY y) + (count(*) OVER (PARTITION BY a, b, l, y) - 1) / 2 AS ry FROM ls),
    views AS (SELECT a, b, 0 AS lag, corr(x, y) AS rp FROM pl WHERE weeks >= 6 GROUP BY 1, 2 UNION ALL SELECT a, b, l, corr(x, y) FROM lr GROUP BY 1, 2, 3 HAVING count(*) >= 4),
    ranked AS (SELECT a, b, 0 AS lag, corr(rx, ry) AS rs FROM rk GROUP BY 1, 2 UNION ALL SELECT a, b, l, corr(rx, ry) FROM lr GROUP BY 1, 2, 3 HAVING count(*) >= 4),
    every AS (SELECT a, b, lag, 'pearson' AS method, rp AS r, lag * 2 + 20 * (lag <> 0)::int AS o FROM views UNION ALL SELECT a, b, lag, 'spearman', rs, lag * 2 + 1 + 20 * (lag <> 0)::int FROM ranked),
    best AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(coalesce(r, 0)), 9) DESC, o) AS i FROM every WHERE NOT isnan(coalesce(r, 0)))
    SELECT a, b, CAST(lag AS int) AS lag, method, round(r, 6) AS r FROM best WHERE i = 1 AND abs(r) >= 0.05"""
)
def churn_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|r| of 0.05, as the stand-in files change independently; candidates are pairs that changed together six times."""
    commits, files = views(spark, sf_dir, "commits", "commit_files")
    churn = M.weekly_churn(files, commits)
    other = files.select("commit_id", F.col("file").alias("b"))
    found = files.select("commit_id", F.col("file").alias("a")).join(other, "commit_id").where("a < b").groupBy("a", "b").count().where("count >= 6").select("a", "b")
    return _rounded(M.churn_correlation(churn, found, least=0.05), "r")


@query(
    _with("commits", "commit_files")
    + """, n AS (SELECT subject AS key, file, count(*) AS n FROM usable JOIN commits USING (commit_id) GROUP BY 1, 2 HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, file) AS p FROM n)
    SELECT key, string_agg(CAST(file AS varchar), ',' ORDER BY p) AS files, CAST(sum(n) AS bigint) AS total FROM r WHERE p <= 8 GROUP BY key HAVING count(*) >= 2"""
)
def subject_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, _ = views(spark, sf_dir, "commits", "commit_files")
    found = M.subject_clusters(_usable(spark, sf_dir), commits.select("commit_id", F.col("subject").alias("key")))
    return found.select("key", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"), "total")


@query(
    """WITH w0 AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9_]{4,}'), 1) AS i FROM documents),
    w AS (SELECT * FROM w0 WHERE token NOT IN ('this','that','with','from','into','when','then','also','just','some','more','less','been','have','will','make','made')),
    d AS (SELECT token, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) * 4 <= (SELECT count(*) FROM documents)),
    b AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, i) AS p FROM w JOIN d USING (token))
    SELECT token, count(*) AS commits FROM b WHERE p = 1 GROUP BY 1 HAVING count(*) >= 3"""
)
def token_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views(spark, sf_dir, "documents")[0]
    return M.token_clusters(docs.select(F.col("doc_id").alias("commit_id"), "text"))


@query(
    ctes("commits", "commit_files")
    + """, d AS (SELECT commit_id, commit_id // 2 AS parent, file AS path FROM commit_files JOIN commits USING (commit_id) WHERE is_fix)
    SELECT x.path AS introducer, y.path AS other, count(*) AS n FROM d x JOIN d y ON x.commit_id = y.commit_id AND x.path <> y.path GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def defect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, files = views(spark, sf_dir, "commits", "commit_files")
    fixes = files.join(commits.where("is_fix").select("commit_id"), "commit_id", "left_semi")
    return M.defect_edges(fixes.select("commit_id", F.expr("commit_id div 2").alias("parent"), F.col("file").alias("path")))


@query(
    ctes("commits", "commit_files", "files")
    + """, l AS (SELECT DISTINCT commit_id, lang FROM commit_files JOIN files USING (file)),
    s AS (SELECT x.lang AS lang_a, y.lang AS lang_b, subject AS symbol, count(*) AS n FROM l x JOIN l y ON x.commit_id = y.commit_id AND x.lang < y.lang JOIN commits c ON c.commit_id = x.commit_id GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang_a, lang_b ORDER BY n DESC, symbol) AS p FROM s)
    SELECT lang_a, lang_b, CAST(sum(n) AS bigint) AS n, string_agg(symbol, ',' ORDER BY p) FILTER (WHERE p <= 3) AS examples FROM r GROUP BY 1, 2"""
)
def cross_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, changed, files = views(spark, sf_dir, "commits", "commit_files", "files")
    langs = changed.join(files.select("file", "lang"), "file").select("commit_id", "lang")
    return M.cross_language(langs, commits.select("commit_id", F.col("subject").alias("symbol")))


@query(
    _with("commits", "commit_files", "files", more=HEAVY)
    + """, t1 AS (SELECT x.file AS a, y.file AS b, sum(x.w) AS s FROM heavy x JOIN heavy y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2 HAVING sum(x.w) >= 8),
    t2 AS (SELECT x.file AS a, y.file AS b, count(*) AS s FROM usable x JOIN usable y ON x.commit_id = y.commit_id AND x.file < y.file JOIN commits c ON c.commit_id = x.commit_id WHERE is_fix GROUP BY 1, 2 HAVING count(*) >= 5),
    v AS (SELECT 1 AS t, a, b FROM t1 UNION SELECT 12, a, b FROM t2),
    g AS (SELECT a, b, string_agg(CAST(t AS varchar), ',' ORDER BY t) AS techniques, sum(CASE t WHEN 1 THEN 1.0 ELSE 3.0 END) AS score FROM v GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, techniques, CAST(CASE WHEN fa.dir = fb.dir THEN score / 2 ELSE score END AS double) AS score, fa.dir = fb.dir AS structural FROM g JOIN files fa ON fa.file = a JOIN files fb ON fb.file = b"""
)
def combined_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two techniques vote; files of one directory stand for structural pairs."""
    commits, _, files = views(spark, sf_dir, "commits", "commit_files", "files")
    heavy = M.weighted(_usable(spark, sf_dir))
    coupled = M.pairs(heavy, "weight").groupBy("a", "b").agg(F.sum("weight").alias("s")).where("s >= 8")
    fixes = heavy.join(commits.where("is_fix").select("commit_id"), "commit_id", "left_semi")
    defects = M.pairs(fixes).groupBy("a", "b").agg(F.count("*").alias("s")).where("s >= 5")
    votes = coupled.select(F.lit(1).alias("technique"), "a", "b").union(defects.select(F.lit(12), "b", "a"))
    side = lambda x: files.select(F.col("file").alias(x), F.col("dir").alias(f"dir_{x}"))
    same = votes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b").where("dir_a = dir_b")
    found = M.combine_techniques(votes, same.select("a", "b"))
    return found.select("a", "b", F.array_join(F.col("techniques").cast("array<string>"), ",").alias("techniques"), "score", "structural")


@query(ctes("commits", "commit_files") + "SELECT commit_id, author FROM commits WHERE commit_id IN (SELECT commit_id FROM commit_files WHERE file = 1) AND commit_id IN (SELECT commit_id FROM commit_files WHERE file = 2) ORDER BY ts DESC, commit_id DESC LIMIT 50")
def explain_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, files = views(spark, sf_dir, "commits", "commit_files")
    return M.explain_pair(files, commits, 1, 2).select("commit_id", "author")


@query(
    ctes("commits", "commit_files")
    + """, r AS (SELECT DISTINCT file, author AS reviewer FROM commit_files JOIN commits USING (commit_id)), n AS (SELECT file, count(*) AS n FROM r GROUP BY 1),
    p AS (SELECT x.file AS a, y.file AS b, count(*) AS shared FROM r x JOIN r y ON x.reviewer = y.reviewer AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON na.file = a JOIN n nb ON nb.file = b WHERE shared / (na.n + nb.n - shared) >= 0.2"""
)
def reviewer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors stand for reviewers."""
    commits, files = views(spark, sf_dir, "commits", "commit_files")
    reviews = files.join(commits, "commit_id").select("file", F.col("author").alias("reviewer"))
    return _rounded(M.reviewer_overlap(reviews, jaccard=0.2), "jaccard")


@query(ctes("commits") + ", s AS (SELECT * FROM commits ORDER BY ts DESC, commit_id DESC LIMIT 200), w AS (SELECT unnest(regexp_extract_all(lower(subject), '[a-z]{4,}')) AS word FROM s) SELECT word, count(*) AS n FROM w WHERE word NOT IN ('this','that','with','from','into','when','then','also','just','some','more','less','been','have','will','make','made') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def fix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if no commit were told to be a fix."""
    return M.fix_words(views(spark, sf_dir, "commits")[0].withColumn("is_fix", F.lit(False)))


@query(ctes("commit_files") + "SELECT commit_id, count(*) AS n FROM commit_files GROUP BY 1 HAVING count(*) >= 2")
def coordinated_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a commit stands for a renamed one."""
    files = views(spark, sf_dir, "commit_files")[0]
    return M.coordinated_moves(files.select("commit_id", F.col("file").alias("from_path"), (F.col("file") + 1).alias("to_path")))


@query()
def capped_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of at most eight files, pairs ranked by the commits that changed both; tested against one pass in order."""
    files = views(spark, sf_dir, "commit_files")[0]
    counted = M.pairs(files).groupBy("a", "b").agg((-F.count("*")).alias("rank"))
    return clusters(counted)
