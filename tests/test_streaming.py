"""Streams of session logs: equal to the batch on the same log, forgotten in time, carried on after a restart."""

import json
import random
from datetime import datetime, timedelta

import pytest

from weftline.streaming import seen

BEGIN = datetime(2024, 1, 1)
SHOWN = "sid string, key string, at timestamp"
LOG = "sid string, line_no bigint, path string, kind string, start bigint, end bigint, at timestamp, flush boolean"


@pytest.fixture(autouse=True)
def state(spark):
    seen.keep_state_in_rocks_db(spark)
    yield
    spark.conf.unset(seen.PROVIDER)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    told = [{k: v.isoformat(sep=" ") if isinstance(v, datetime) else v for k, v in r.items()} for r in rows]
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in told))


def run(stream, out, check):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shown_rows(seed, n, minutes):
    dice = random.Random(seed)
    times = sorted(dice.uniform(0, minutes) for _ in range(n))
    return [{"sid": dice.choice(["hot", "hot", "s", "t", None]), "key": dice.choice(["a", "b", None]), "at": BEGIN + timedelta(minutes=round(t, 3))} for t in times]


def test_unseen_equals_batch_over_restarts(spark, tmp_path):
    src, log = tmp_path / "log", shown_rows(5, 60, 500)
    for i in range(3):  # each part is read by a query started anew from the checkpoint
        put(src, f"{i}.json", log[20 * i : 20 * i + 20])
        run(seen.unseen_stream(seen.session_log(spark, str(src), SHOWN)), tmp_path / "out", tmp_path / "check")
    told = rows(seen.unseen_batch(spark.read.schema(SHOWN).json(str(src))))
    last, brute = {}, []
    for r in log:
        who = (r["sid"], r["key"])
        if who not in last or r["at"] - last[who] >= timedelta(minutes=30):
            brute.append((*who, r["at"]))
        last[who] = r["at"]
    assert told == sorted(brute, key=repr)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == told


def test_unseen_keys_are_forgotten(spark, tmp_path):
    src = tmp_path / "log"
    minute = lambda m, key: {"sid": "s", "key": key, "at": BEGIN + timedelta(minutes=m)}
    for i, part in enumerate([[minute(0, "a"), minute(29, "b")], [minute(45, "c")], [minute(46, "c")]]):
        put(src, f"{i}.json", part)
        run(seen.unseen_stream(seen.session_log(spark, str(src), SHOWN)), tmp_path / "out", tmp_path / "check")
    kept = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "check"))
    # the watermark is at 35 and 36 minutes: a goes at 30, b at 59
    assert sorted(r.k for r in kept.selectExpr("key.key AS k").collect()) == ["b", "c"]


def flush_rows(seed, n, minutes):
    dice = random.Random(seed)
    times = sorted(dice.randrange(minutes) for _ in range(n))
    return [
        {"sid": dice.choice(["hot", "s"]), "line_no": i, "path": dice.choice(["x", "y"]), "kind": dice.choice(["edit", "read"]), "start": dice.choice([1, 5, None]), "end": 9, "at": BEGIN + timedelta(minutes=t), "flush": dice.random() < 0.2}
        for i, t in enumerate(times)
    ]


def test_flush_equals_batch_over_restarts(spark, tmp_path):
    src, log = tmp_path / "log", flush_rows(7, 90, 400)
    for i in range(3):
        put(src, f"{i}.json", log[30 * i : 30 * i + 30])
        run(seen.flushed_stream(seen.session_log(spark, str(src), LOG)), tmp_path / "out", tmp_path / "check")
    told = rows(seen.flushed_batch(spark.read.schema(LOG).json(str(src))))
    pending, brute = {}, []
    for r in log:
        own = pending.setdefault((r["sid"], r["path"]), {})
        if not r["flush"]:
            own[r["kind"], r["start"], r["end"]] = r["at"]
            continue
        brute += [(r["sid"], r["path"], *touch, at, r["at"]) for touch, at in own.items() if r["at"] - at < timedelta(minutes=30)]
        own.clear()
    assert brute and told == sorted(brute, key=repr)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == told


def test_pending_touches_are_forgotten_one_by_one(spark, tmp_path):
    src = tmp_path / "log"
    touch = lambda n, m: {"sid": "s", "line_no": n, "path": "x", "kind": "edit", "start": n, "end": n, "at": BEGIN + timedelta(minutes=m), "flush": False}
    for i, part in enumerate([[touch(1, 0), touch(2, 20)], [touch(3, 45)], [touch(4, 46)]]):
        put(src, f"{i}.json", part)
        run(seen.flushed_stream(seen.session_log(spark, str(src), LOG)), tmp_path / "out", tmp_path / "check")
    kept = spark.read.format("statestore").option("stateVarName", "touches").load(str(tmp_path / "check"))
    assert sorted(r.s for r in kept.selectExpr("user_map_key.start AS s").collect()) == [2, 3, 4]


class Counted:
    """A state store's handle that counts the calls a batch makes."""

    def __init__(self):
        self.calls, self.map = 0, {}

    def __getattr__(self, name):
        def call(*a):
            self.calls += 1
            return {"getMapState": lambda: self, "iterator": lambda: iter([*self.map.items()]), "updateValue": lambda: self.map.update({a[0]: a[1]}), "removeKey": lambda: self.map.pop(a[0])}.get(name, lambda: None)()

        return call


def test_a_batch_reads_and_writes_its_touches_once():
    """Calls of a store follow the touches that a batch leaves, not its rows."""
    from pyspark.sql import Row

    store, own = Counted(), seen._Pending(10**9)
    own.init(store)
    log = [Row(kind="edit", start=i % 3, end=9, us=i, line_no=i, flush=i % 50 == 49) for i in range(1001)]
    told = list(own.handleInputRows(("s", "x"), iter(log), None))
    assert len(told) == 60 and store.map == {("edit", 1000 % 3, 9): (1000,)} and store.calls < 10


def test_session_windows(spark):
    log = spark.createDataFrame([("s", BEGIN), ("s", BEGIN + timedelta(minutes=10)), ("s", BEGIN + timedelta(hours=2))], "sid string, at timestamp")
    assert sorted(r.n for r in seen.sessions(log).collect()) == [1, 2]


def test_empty_logs(spark):
    assert seen.unseen_batch(spark.createDataFrame([], SHOWN)).count() == 0
    assert seen.flushed_batch(spark.createDataFrame([], LOG)).count() == 0
