"""Cliques against brute force on random graphs, and one session in many tasks."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from weftline.operators import session


def brute(edges, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {(min(e), max(e)) for e in edges}
    level = {frozenset(e) for e in edges}
    while level:
        bigger = set()
        for c in level:
            more = set.intersection(*(near[u] for u in c))
            if not more and len(c) <= most:
                out.add(tuple(sorted(c)))
            bigger |= {c | {u} for u in more}
        level = bigger
    return out


def told(df):
    got = [(r.sid, tuple(r.ids)) for r in df.collect()]
    assert len(got) == len({*got})
    return {*got}


def test_random_sessions(spark):
    r = random.Random(3)
    rows = []
    for sid in range(12):
        n, share = r.choice([(8, 0.5), (14, 0.4), (11, 0.75), (20, 0.2)])
        rows += [(f"s{sid}", a, b) for a, b in combinations(range(n), 2) if r.random() < share]
    rows += [("big", a, b) for a, b in combinations(range(10), 2)]  # one clique over the limit: its pairs alone
    rows += [("star", 0, b) for b in range(1, 30)] + rows[:5]  # repeated edges
    found = spark.createDataFrame(rows, "sid string, lo long, hi long").withColumn("score", F.lit(1.0))
    for most in (3, 8):
        want = {(s, c) for s in {x[0] for x in rows} for c in brute({x[1:] for x in rows if x[0] == s}, most)}
        assert told(session.cliques(found, session.Settings(max_clique=most))) == want


def test_one_session_is_many_problems(spark):
    """A hub with 4 000 neighbours in a ring: each triangle of the ring and the hub is found, and no problem holds them all."""
    n = 4000
    rows = [("s", 0, i) for i in range(1, n + 1)] + [("s", i, i + 1) for i in range(1, n)] + [("s", 1, n)]
    found = spark.createDataFrame(rows, "sid string, lo long, hi long")
    dealt = session._dealt(found.distinct())
    assert dealt.count() > n // 2 and dealt.agg(F.max(F.size("inner")), F.max(F.size("later"))).first()[0] <= 8
    assert session.cliques(found).where("size(ids) = 3").count() == n


def test_no_edges(spark):
    assert session.cliques(spark.createDataFrame([], "sid string, lo long, hi long")).count() == 0
