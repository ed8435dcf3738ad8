"""Cases that a running sum or an open tie decides by chance."""

import itertools

from weftline.operators import drift, mining


def test_sweeps_at_their_bound(spark):
    """Deviations of just a fifth of the mean are no sweeps in any order of the rows, a little less is one."""
    at = [p for values in ((20, 20, 30, 30), (16, 16, 24, 24), (2, 2, 3, 3), (14, 14, 21, 21), (22, 22, 33, 33)) for p in sorted(set(itertools.permutations(values)))]
    under = [(20, 21, 30, 30)]
    rows = [(c, f, float(v)) for c, values in enumerate(at + under) for f, v in enumerate(values)]
    for partitions in (1, 7):
        files = spark.createDataFrame(rows, "commit_id long, file long, churn double").repartition(partitions)
        kept = {r["commit_id"] for r in mining.usable_files(files, sweep_values=4).collect()}
        assert kept == set(range(len(at)))


def test_two_renames_in_one_commit(spark):
    """Both new paths are followed; a deletion of the same commit ends nothing more than the leg."""
    anchors = spark.createDataFrame([(1, "a", 0)], "anchor_id long, path string, seq long")
    changes = [(5, "renamed", "a", "b"), (5, "renamed", "a", "c"), (5, "deleted", "a", "a"), (6, "modified", "b", "b"), (7, "modified", "c", "c"), (8, "modified", "a", "a")]
    table = spark.createDataFrame([(*c, None) for c in changes], f"seq long, op string, from_path string, to_path string, hunks {drift.HUNKS}")
    met = sorted((r["seq"], r["path"], r["op"]) for r in drift.trails(anchors, table).collect())
    assert met == [(5, "a", "deleted"), (5, "a", "renamed"), (5, "a", "renamed"), (6, "b", "modified"), (7, "c", "modified")]


def test_cohesion_of_saturated_pairs(spark):
    """Rare identifiers that weigh enough settle a pair, the others are summed up, and both equal the plain sets."""
    import math
    import random

    from weftline.functions import text as T
    from weftline.operators import session

    r = random.Random(4)
    words = [f"name_{i}" for i in range(40)] + ["abc", "xyz"]
    ids = {i: sorted({r.choice(words) for _ in range(12)} | {f"rare_{k}_{i // 2}" for k in range(i % 5)}) for i in range(30)}
    ids[30] = []
    tokens = spark.createDataFrame([("s", i, v) for i, v in ids.items()], "sid string, id long, identifiers array<string>")
    tokens = tokens.withColumn("trigrams", T.trigrams(tokens["identifiers"]))
    idf = session.inverse_frequency(tokens)
    pairs = [(a, b) for a in ids for b in ids if a < b]
    table = spark.createDataFrame([("s", *p) for p in pairs], "sid string, lo long, hi long")
    found = {(x["lo"], x["hi"]): (round(x["cohesion"], 9), round(x["trigram"], 9)) for x in session.pair_cohesion(table, tokens, idf).collect()}
    df = {t: sum(t in v for v in ids.values()) for v in ids.values() for t in v}
    tri = {i: {" ".join(v)[k : k + 3] for k in range(len(" ".join(v)) - 2)} for i, v in ids.items()}
    want = {}
    for a, b in pairs:
        w = min(1, sum(math.log((len(ids) + 1) / (1 + df[t])) for t in set(ids[a]) & set(ids[b]) if len(t) >= 4) / 6)
        j = len(tri[a] & tri[b]) / len(tri[a] | tri[b]) if tri[a] and tri[b] else 0
        want[a, b] = (round(max(w, j), 9), round(j, 9))
    assert found == want
    weights = tokens.selectExpr("sid", "id", "explode(identifiers) AS token").join(idf, ["sid", "token"])
    assert 0 < session.saturated(table, weights).count() < len(pairs)


def test_tasks_of_series_follow_the_pairs(spark, monkeypatch):
    """A task joins a bounded number of pairs with their series, however many pairs there are."""
    from weftline.operators import mining

    monkeypatch.setattr(mining, "PAIRS_A_TASK", 10)
    churn = spark.createDataFrame([(f, w, float((f * w) % 7)) for f in range(20) for w in range(8)], "file long, week long, churn double")
    pairs = spark.createDataFrame([(a, b) for a in range(20) for b in range(a + 1, 20)], "a long, b long")
    found = mining.churn_correlation(churn, pairs, least=0.0)
    assert found.rdd.getNumPartitions() >= 19 and found.count() == 190


def test_commits_whose_churn_is_unknown(spark):
    """Of as many files as a sweep has, one that knows no churn is left out; with fewer files, or one known value more, it isn't."""
    rows = [(c, f, None) for c, n in ((1, 4), (2, 3), (3, 5)) for f in range(n)] + [(3, 9, 2.0), (3, 10, 8.0)]
    files = spark.createDataFrame(rows, "commit_id long, file long, churn double")
    assert {r["commit_id"] for r in mining.usable_files(files, sweep_values=4).collect()} == {2, 3}


def test_files_without_a_key_are_a_set_as_in_sql(spark, tmp_path):
    """frequent_itemsets and usable_commits equal their SQL on lines without quantity or supplier."""
    import duckdb

    from weftline import queries as core

    lines = [(c, s, None if c == 1 else float(10 * s + c)) for c in range(1, 6) for s in (1, 2, 3, 4)] + [(c, None, 1.0) for c in range(2, 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("usable_commits", "frequent_itemsets"):
        told = duck.sql(core.ORACLES[name])
        ours = core.QUERIES[name](spark, str(tmp_path)).select(*told.columns).collect()
        assert sorted(map(tuple, ours), key=repr) == sorted(told.fetchall(), key=repr)


def test_trigrams_of_ranges_by_blocks(spark, monkeypatch):
    """Likeness from packed trigrams equals that of plain sets, however ranges are dealt to blocks and pairs to batches."""
    import random

    from weftline.operators import session

    monkeypatch.setattr(session, "RANGES_A_BLOCK", 7)
    monkeypatch.setattr(session, "OTHERS_AT_ONCE", 3)
    monkeypatch.setattr(session, "PAIRS_AT_ONCE", 5)
    r = random.Random(9)
    words = ["alpha", "beta_2", "Gamma", "DELTA9", "_x1", "zzz", "zebra", "Z_9", *(f"w{i}" for i in range(100, 130))]
    ids = {(s, i): sorted(r.sample(words, r.randrange(9))) for s in ("s", "t") for i in range(30)}
    ids["s", 30], ids["s", 31] = [], ["abc"]
    tokens = spark.createDataFrame([(*k, v) for k, v in ids.items()], "sid string, id long, identifiers array<string>")
    pairs = [(*a, b[1], (a[1] + b[1]) % 3 == 0) for a in ids for b in ids if a[0] == b[0] and a[1] < b[1]]
    table = spark.createDataFrame([*pairs, ("s", 3, 99, True)], "sid string, lo long, hi long, enough boolean")
    grams = {k: {" ".join(v)[i : i + 3] for i in range(len(" ".join(v)) - 2)} for k, v in ids.items()}
    like = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {(s, a, b, e): like(grams[s, a], grams[s, b]) for s, a, b, e in pairs}
    assert {tuple(x)[:4]: x["trigram"] for x in session.trigram_likeness(table, tokens).collect()} == want


def test_holders_of_rare_tokens(spark):
    """Two or three holders of a token are named, more are counted, and a single one isn't listed."""
    import math

    from weftline.operators import session

    ids = {5: ["aa_1", "bb_2", "cc_3", "dd_4"], -7: ["aa_1", "bb_2", "cc_3"], 2**62: ["bb_2", "cc_3"], 11: ["cc_3"], 2**62 + 1: []}
    tokens = spark.createDataFrame([("s", i, v) for i, v in ids.items()], "sid string, id long, identifiers array<string>")
    found = {x["token"]: (x["n"], x["ids"], round(x["idf"], 9)) for x in session.token_holders(tokens).collect()}
    idf = lambda n: round(math.log(6 / (1 + n)), 9)
    assert found == {"aa_1": (2, [-7, 5], idf(2)), "bb_2": (3, [-7, 5, 2**62], idf(3)), "cc_3": (4, None, idf(4))}


def test_identifiers_of_ranges(spark):
    """Ranges' identifiers found in batches are those of the column expression, of ranges past the end and of nothing too."""
    from pyspark.sql import functions as F

    from weftline.functions import text as T
    from weftline.operators import session

    texts = [("a", "let First_1 = ünder_score\nfn x9y zz 9abc\r\n\n  Last_line"), ("b", ""), ("c", None), ("d", "for if\n--")]
    files = spark.createDataFrame(texts, "path string, text string")
    rows = [("s", i, p, a, b) for i, (p, a, b) in enumerate((p, a, b) for p, _ in texts for a, b in ((1, 1), (2, 3), (2, 99), (4, 4), (5, 9), (1, 2**31 - 1)))]
    canon = spark.createDataFrame(rows, "sid string, id long, path string, start long, end long")
    plain = canon.join(files, "path").select("id", T.identifiers(F.array_join(T.line_slice(T.lines_raw(F.col("text")), F.col("start"), F.col("end")), "\n")).alias("identifiers"))
    found = {r["id"]: r["identifiers"] for r in session.range_tokens(canon, files).collect()}
    assert found == {r["id"]: r["identifiers"] for r in plain.collect()}
