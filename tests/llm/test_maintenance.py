"""Aggregate maintenance against a replay of every batch."""

import random
import zlib
from collections import defaultdict

import pytest

from weftline.llm.maintenance import AGGREGATES, maintain, maintenance_report

NONE = (0, 0, 0, None, None, None)


def state(rows):
    values = sorted(v for v in rows if v is not None)
    if not values:
        return (len(rows), 0, 0, None, None, None)
    return (len(rows), len(set(values)), sum(values), values[0], values[-1], values[(len(values) + 1) // 2 - 1])


def replay(changes):
    """{(batch, group): (old, new)} from (group, batch, value, sign), one batch after the other."""
    by_batch = defaultdict(list)
    for g, b, v, s in changes:
        by_batch[b].append((g, v, s))
    present, found = defaultdict(list), {}
    for b in sorted(by_batch):
        old = {g: state(present[g]) for g, _, _ in by_batch[b]}
        for g, v, _ in (x for x in by_batch[b] if x[2] > 0):
            present[g].append(v)
        for g, v, _ in (x for x in by_batch[b] if x[2] < 0):
            present[g].remove(v)
        for g in old:
            if old[g] != (new := state(present[g])):
                found[b, g] = (old[g], new)
    return found


def as_dict(df, *groups):
    rows = df.collect()
    found = {(r["batch"], tuple(r[g] for g in groups)): (tuple(r[f"old_{a}"] for a in AGGREGATES), tuple(r[f"new_{a}"] for a in AGGREGATES)) for r in rows}
    assert len(found) == len(rows)
    return found


def of_documents(rows):
    changes = []
    for doc_id, source, lang, n in rows:
        h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
        b, q = h % 120, h // 120 % 15
        g = (source or "", lang or "")
        changes.append((g, b, n, 1))
        if b + q < 120:
            changes.append((g, b + q, n, -1))
            if q % 3 == 0:
                changes.append((g, b + q, None if n is None else n + q, 1))
    return replay(changes)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, value int, batch string, g string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "b", "g") for r in rows], DOCS)


@pytest.mark.parametrize("spread", [1, 3, 40, 10**12])
def test_replay(spark, spread):
    r = random.Random(spread)
    rows = [(r.choice([i, i, i, None]), r.choice(["a", "b", "", None]), r.choice(["en", None]), r.choice([None, r.randrange(spread), r.randrange(spread), -r.randrange(spread)])) for i in range(400)]
    rows += rows[:60]  # repeated rows
    assert as_dict(maintenance_report(frame(spark, rows)), "source", "lang") == of_documents(rows)


def test_one_group_and_no_values(spark):
    rows = [(i, "hot", "en", 7) for i in range(200)] + [(i, "none", "en", None) for i in range(50)]
    assert as_dict(maintenance_report(frame(spark, rows)), "source", "lang") == of_documents(rows)


def test_empty(spark):
    assert maintenance_report(frame(spark, [])).collect() == []
    assert as_dict(maintenance_report(frame(spark, [(1, None, None, None)])), "source", "lang") == of_documents([(1, None, None, None)])


def test_changes_of_any_groups(spark):
    changes = [(("x",), 5, 10, 1), (("x",), 5, 10, -1), (("x",), 3, 4, 1), ((None,), 9, -3, 1), (("x",), 8, 4, -1), (("x",), 8, 4, 1)]
    df = spark.createDataFrame([(*g, b, v, s, "more") for g, b, v, s in changes], "kind string, batch int, value long, sign int, d string")
    assert as_dict(maintain(df, "kind"), "kind") == replay(changes)
    assert set(maintain(df, "kind").columns) == {"batch", "kind", *(f"{w}_{a}" for w in ("old", "new") for a in AGGREGATES)}


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "source", "lang", "n_chars").collect()
    assert as_dict(maintenance_report(docs), "source", "lang") == of_documents(map(tuple, rows))
