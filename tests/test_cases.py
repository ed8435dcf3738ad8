"""Small cases with known results."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import paths as P
from weftline.functions import ranges as R
from weftline.functions import text as T
from weftline.operators import drift as D
from weftline.operators import mining as M
from weftline.operators import mutations as U
from weftline.operators import quality as Q
from weftline.operators import session as S
from weftline.operators import sinks as K
from weftline.sources import logs as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("ranges", "hulls"), [([(1, 20), (15, 35)], {(1, 35)}), ([(1, 10), (15, 25)], {(1, 25)}), ([(1, 10), (20, 30)], {(1, 10), (20, 30)})])
def test_merge_near(spark, ranges, hulls):
    df = spark.createDataFrame([(1, *r) for r in ranges], "k int, start long, end long")
    assert {(r.m_start, r.m_end) for r in R.merge_near(df, ["k"]).collect()} == hulls


def test_iou(spark):
    assert one(spark, R.iou(*map(F.lit, (1, 20, 10, 30)))) == pytest.approx(11 / 30)


@pytest.mark.parametrize(
    ("hunks", "then"),
    [([(5, 0, 6, 3)], (13, 23)), ([(15, 0, 16, 2)], (10, 22)), ([(20, 0, 21, 2)], (10, 20)), ([(2, 3, 2, 0)], (7, 17)), ([(12, 2, 11, 0)], (10, 18)), ([(8, 4, 8, 1)], (8, 17)), ([], (10, 20)), ([(5, 0, 6, 3), (30, 1, 33, 1)], (13, 23))],
)
def test_moved_by(spark, hunks, then):
    h = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("os", "oc", "ns", "nc"), x, strict=True)]) for x in hunks]) if hunks else F.array().cast(D.HUNKS)
    r = spark.range(1).select(h.alias("h")).select(F.expr(R.moved_by("10", "20", "h")).alias("r")).first()["r"]
    assert (r.s, r.e) == then


def test_greedy_is_not_components(spark):
    df = spark.createDataFrame([("p", *r) for r in [(17, 25), (19, 42), (21, 31), (40, 56)]], "path string, start long, end long")
    g = {(r.start, r.end): r.group for r in S.greedy_groups(df).collect()}
    assert g[19, 42] != g[17, 25]
    chain = spark.createDataFrame([("p", *r) for r in [(1, 20), (10, 30), (20, 40)]], "path string, start long, end long")
    assert {r.group for r in S.greedy_groups(chain).collect()} == {0}


def test_tokens(spark):
    assert one(spark, T.identifiers(F.lit("9abc de fgh_1 let abc"))) == ["abc", "fgh_1"]
    assert one(spark, T.trigrams(F.array(F.lit("ab"), F.lit("c")))) == ["ab ", "b c"]
    assert one(spark, T.lines_trimmed(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert one(spark, T.lines_raw(F.lit("a\nb\n"))) == ["a", "b", ""]


def test_paths(spark):
    assert one(spark, P.is_cross_cutting(F.lit("x/Cargo.lock"))) and not one(spark, P.is_cross_cutting(F.lit("x/cargo.lock")))
    assert one(spark, P.canonical(F.lit("./a/b/../c\\d"))) == "a/c/d"
    assert one(spark, P.parsed_address(F.lit("a#L2-L1"))) is None
    assert one(spark, P.parsed_address(F.lit("a/b#L2-L9")))["end"] == 9
    assert one(spark, F.lit("a/x.rs").rlike(P.glob_pattern("a/*.{rs,py}"))) and not one(spark, F.lit("a/b/x.rs").rlike(P.glob_pattern("a/*.rs")))
    assert one(spark, P.is_acceptable(F.lit("src/a.rs"))) and not one(spark, P.is_acceptable(F.lit("/src/a.rs")))
    assert one(spark, P.cluster_key(F.lit("feat(core): x"), F.lit("see AB-12"))) == "ticket:AB-12"
    assert one(spark, S.epoch_ms(F.lit("1970-01-01T00:00:01.123999Z"))) == 1123 and one(spark, S.epoch_ms(F.lit("?"))) == 0


LOG = "sid string, line_no long, path string, start long, end long, ts string, ts_ms long"


def example(spark):
    reads = spark.createDataFrame([("s", 0, "src/auth.rs", 1, 40, "a", 0), ("s", 1, "src/session.rs", 1, 30, "b", 60000)], LOG)
    touches = spark.createDataFrame([("s", 0, "src/auth.rs", None, None, "c", 120000), ("s", 1, "src/session.rs", None, None, "c", 120000)], LOG)
    return reads, touches


def test_worked_example(spark):
    ops = S.located(S.operations(*example(spark)))
    parts = S.participants(ops)
    canon = S.canonical_ranges(parts)
    edge = S.edges(S.evidence(ops, parts, canon), canon).collect()
    assert len(edge) == 1 and edge[0].edit_hits == 3 and edge[0].mean_distance == 1.5
    assert edge[0].score == pytest.approx(0.46)
    shown = S.suggest(*example(spark)).collect()
    assert [(r.composite, r.band, r.viability) for r in shown] == [(0.476, "medium", "ready")]
    line = json.loads(K.suggestion_json(S.suggest(*example(spark))).first().line)
    assert next(iter(line)) == "v" and len(line["participants"]) == 2


def test_bursts_and_coalescing(spark):
    reads = spark.createDataFrame([("s", i, f"f{i}", None, None, "t", 5) for i in range(3)], LOG)
    none = spark.createDataFrame([], LOG)
    assert S.operations(reads, none).count() == 0
    twice = spark.createDataFrame([("s", i, "f", None, None, f"t{i}", i) for i in range(2)], LOG)
    assert [(r["count"], r.op_index) for r in S.operations(none, twice).collect()] == [(2, 0)]
    ranged = spark.createDataFrame([("s", i, "f", 1, 2, f"t{i}", i) for i in range(2)], LOG)
    assert S.operations(none, ranged).count() == 2


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        (list(itertools.combinations(range(4), 2)), {(0, 1, 2, 3)}),
        ([(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], {(0, 1, 2), (1, 2, 3)}),
        ([(0, 1), (1, 2), (2, 3)], set()),
    ],
)
def test_cliques(spark, edges, want):
    df = spark.createDataFrame([("s", *e) for e in edges], "sid string, lo long, hi long")
    found = {tuple(r.ids) for r in S.cliques(df).collect()}
    assert {f for f in found if len(f) > 2} == want and {f for f in found if len(f) == 2} == set(edges)


def test_clique_cap(spark):
    df = spark.createDataFrame([("s", *e) for e in itertools.combinations(range(4), 2)], "sid string, lo long, hi long")
    assert all(len(r.ids) == 2 for r in S.cliques(df, S.Settings(max_clique=3)).collect())


def scored(spark, rows):
    cols = "sid string, ids array<long>, composite double, size long, files long, dominance double, op_distance double, viability string, pair_min double, pair_median double, intersection double, trigram double"
    return spark.createDataFrame([("s", ids, c, len(ids), 2, 0.5, 1.0, "ready", 0.6, 0.6, 0.6, 0.6) for ids, c in rows], cols)


@pytest.mark.parametrize(("clique", "pair", "kept"), [(0.50, 0.71, 2), (0.65, 0.55, 1)])
def test_pair_escape(spark, clique, pair, kept):
    assert S.emitted(scored(spark, [([0, 1, 2], clique), ([0, 1], pair)])).count() == kept


@pytest.mark.parametrize(("composite", "kinds", "density", "band"), [(0.8, 3, 1.0, "high+"), (0.8, 1, 1.0, "medium"), (0.8, 2, 1.0, "high"), (0.8, 3, 0.9, "high"), (0.3, 3, 1.0, "low")])
def test_bands(spark, composite, kinds, density, band):
    df = spark.createDataFrame([(composite, [f"t{i}" for i in range(kinds)], 0, density)], "composite double, techniques array<string>, history_commits long, density double")
    assert df.select(S.band(df).alias("b")).first().b == band


def test_techniques(spark):
    votes = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (1, "b", "a"), (1, "a", "c")], "technique int, a string, b string")
    assert [(r.a, r.b, r.techniques, r.score) for r in M.combine_techniques(votes).collect()] == [("a", "b", [1, 2], 4.0)]


def test_mutations(spark):
    cols = "set_name string, version long, anchor_id string, path string, start long, end long, whole boolean"
    now = spark.createDataFrame([("s", 1, "x", "p", 1, 2, False), ("s", 1, "y", "q", None, None, True), ("t", 4, "z", "p", 1, 2, False)], cols)
    cols = "set_name string, line_no long, op string, path string, start long, end long, whole boolean, anchor_id string"
    staged = spark.createDataFrame([("s", 0, "remove", "q", None, None, True, None), ("s", 1, "add", "p", 1, 2, False, "n1"), ("s", 2, "add", "p", 1, 2, False, "n2")], cols)
    assert {(r.set_name, r.version, r.anchor_id) for r in U.committed(now, staged).collect()} == {("s", 2, "n2"), ("t", 4, "z")}
    wrong = spark.createDataFrame([("s", 0, "remove", "nope", None, None, True, None)], cols)
    assert U.missing_removes(now, wrong).count() == 1 and U.missing_removes(now, staged).count() == 0


def test_save_refuses_a_taken_version(spark, tmp_path):
    rows = spark.range(2)
    assert U.save(rows, str(tmp_path), 0) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        U.save(rows, str(tmp_path), 0)


def test_doctor(spark):
    sets = spark.createDataFrame([("a", 1, "why"), ("a/b", 1, ""), ("Bad", 1, "w")], "name string, version long, message string")
    anchors = spark.createDataFrame([("a", 1, "x", "p", 5, 2, False)], "set_name string, version long, anchor_id string, path string, start long, end long, whole boolean")
    refs = spark.createDataFrame([("gone",)], "anchor_id string")
    found = {(r.check, r.subject) for r in Q.doctor(sets, anchors, refs).collect()}
    assert {("bad-name", "Bad"), ("name-collision", "a/b"), ("empty-set", "a/b"), ("bad-range", "x"), ("dangling-anchor", "gone"), ("no-reason", "a/b")} <= found


def test_diff_source(spark):
    lines = ["--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@ fn a", " c", "+d", "-e", "+++ b/y", "@@ -4 +5,0 @@"]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "commit_id string, line_no long, line string")
    assert [(r.path, r.os, r.oc, r.ns, r.nc, r.heading) for r in L.diff_hunks(df).orderBy("line_no").collect()] == [("x", 1, 2, 1, 3, "fn a"), ("y", 4, 1, 5, 0, "")]
    assert [(r.path, r.churn) for r in L.diff_churn(df).collect()] == [("x", 2)]


def test_format_string_refuses_unknown_tokens(spark):
    with pytest.raises(ValueError, match="unknown token"):
        K.formatted(spark.range(1), "%z")


def test_trails_follow_every_rename(spark):
    moves = [(i + 1, "renamed", f"p{i}", f"p{i + 1}", None) for i in range(66)] + [(67, "modified", "p66", "p66", None)]
    changes = spark.createDataFrame(moves, f"seq long, op string, from_path string, to_path string, hunks {D.HUNKS}").coalesce(1)
    anchors = spark.createDataFrame([(1, "p0", 0)], "anchor_id long, path string, seq long").coalesce(1)
    assert [r.seq for r in D.trails(anchors, changes).orderBy("seq").collect()] == [*range(1, 68)]


def test_ancestors_of_deep_and_merged_histories(spark):
    from weftline.operators import catalog as C

    chain = [(i, i - 1 if i else None) for i in range(2000)]
    parents = spark.createDataFrame(chain, "commit_id long, parent long")
    assert C.ancestors(parents, 1999).count() == 2000 and C.ancestors(parents, 5000).count() == 0
    # forty merges of two ways each: 2**40 paths
    merged = [row for i in range(40) for row in ((3 * i + 3, 3 * i + 1), (3 * i + 3, 3 * i + 2), (3 * i + 1, 3 * i), (3 * i + 2, 3 * i))]
    parents = spark.createDataFrame(merged, "commit_id long, parent long")
    assert sorted(r.commit_id for r in C.ancestors(parents, 120).collect()) == [*range(121)]


def test_reference_tokens_and_hunk_keys(spark):
    from weftline.operators import advice as A

    told = lambda p: one(spark, A.reference_tokens(F.lit(p)))
    assert told("plugins/runtime/.claude-plugin/plugin.json") == ["plugin", "runtime", "plugins"]
    assert told("src/auth/token.rs") == ["token.rs", "token", "auth"]
    key = lambda h, n: one(spark, P.hunk_key(F.lit("a.md"), F.lit(h).cast("string"), F.lit(n)))
    assert key("## 4.1 Foo", 3) == "a.md#4.1 Foo" and key(None, 250) == "a.md#L201-L300" and key("# * ", 1) == "a.md#L1-L100"
    names = ["add", "a-b/c", "A", "pre-commit", "add/x"]
    assert [one(spark, P.is_set_name(F.lit(n))) for n in names] == [False, True, False, False, True]


def test_status_lines(spark):
    from weftline.operators import layers as Y

    lines = [("M  a.txt",), (" D b.txt",), ("RM new.txt\0old.txt",), ("UU c.txt",), ("?? d.txt",), ("## main",)]
    got = {tuple(r) for r in Y.parsed_status(spark.createDataFrame(lines, "line string")).collect()}
    assert got == {("index", "modified", "a.txt", "a.txt", False), ("worktree", "deleted", "b.txt", "b.txt", False), ("index", "renamed", "old.txt", "new.txt", False), ("worktree", "modified", "new.txt", "new.txt", False), ("worktree", "modified", "c.txt", "c.txt", True)}


def test_words_only_where_nothing_is_a_fix(spark):
    rows = [(i, i, "Tighten the parser, with care", False) for i in range(21)]
    schema = "commit_id long, ts long, subject string, is_fix boolean"
    assert [r.word for r in M.fix_words(spark.createDataFrame(rows, schema)).collect()] == ["care", "parser", "tighten"]
    assert M.fix_words(spark.createDataFrame([*rows, (99, 1, "x", True)], schema)).count() == 0
    assert M.fix_words(spark.createDataFrame(rows[:20], schema)).count() == 0
