"""The prefix trie against one built turn by turn in a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weftline.llm import prefix_trie
from weftline.llm.prefix_trie import trie_report

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, size = defaultdict(list), {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = (*own.get(c - c % 5, [])[:h], *ts[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        bytes_ = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * bytes_ + sum(saved[k] for k in children[p])
    found = []
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in ms if n == len(p)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        found.append((min(c for c, _ in ms), len(p), parent, len(ms), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def told(df):
    assert [k for n, k in df.dtypes if n != "ends_sha256"] == ["bigint"] * 7
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


KIND = "conv_id long, turn long, role string, text string, name int, depth string, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "d", 1) for r in rows], KIND)


@pytest.mark.parametrize("seed,longest,texts", [(1, 3, 2), (2, 12, 1), (3, 20, 3)])
def test_trie(spark, seed, longest, texts):
    r = random.Random(seed)
    rows = [(c, r.choice([t, t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice([None, "", *"äb"][: texts + 1])) for c in r.sample(range(200), 50) for t in range(r.randrange(1, longest))]
    rows += rows[:20] + [(None, 0, "user", "lost")]
    assert told(trie_report(frame(spark, rows))) == brute(rows)


def test_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = [(c, t, "user", f"t{t % 3}") for c in range(30) for t in range(17 if c % 5 else 9)]
    rows += [(70, t, "u", "long " * 2000) for t in range(70)]
    assert told(trie_report(frame(spark, rows))) == brute(rows)


def test_few(spark):
    assert trie_report(frame(spark, [])).collect() == []
    for rows in ([(3, None, None, None)], [(4, 0, "user", "x")], [(7, 0, "ab", "c"), (8, 0, "a", "bc")]):
        assert told(trie_report(frame(spark, rows))) == brute(rows)


def test_tables(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert told(trie_report(t)) == brute([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])
