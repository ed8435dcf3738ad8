"""Streaming session logs: what a session hasn't shown lately, touches that wait for their flush; both equal the batch on one log.

State is kept for each entry and goes at its own time: EXPIRY_MS of event time after the entry was last met.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EXPIRY_MS = 30 * 60 * 1000
LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOUCH = ("kind", "start", "end")


def session_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream; lines that aren't records are errors."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def keep_state_in_rocks_db(spark: SparkSession) -> None:
    """Entries with timers need this state store; to be called before the query starts."""
    spark.conf.set(PROVIDER, ROCKS_DB)


def unseen_batch(shown: DataFrame, *, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """sid, key, at of each row whose session didn't show its key in the expiry_ms before it; rows without a time are left out.

    Rows are first summed up by stretches of expiry_ms, so a window sees a key once a stretch however often it is shown.
    """
    us = expiry_ms * 1000
    spans = shown.where("at IS NOT NULL").withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).groupBy("sid", "key", F.floor(F.col("us") / us).alias("stretch")).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    before = F.lag("last").over(Window.partitionBy("sid", "key").orderBy("stretch"))
    return spans.withColumn("before", before).where(f"before IS NULL OR first - before >= {us}").select("sid", "key", F.timestamp_micros("first").alias("at"))


class _Unseen(StatefulProcessor):
    """The time at which a session last showed a key."""

    def __init__(self, expiry_us: int):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a batch is folded to its stretches, which follow the time it covers and not its rows
        spans: dict[int, tuple[int, int]] = {}
        for r in rows:
            low, high = spans.get(stretch := r.us // self.expiry_us, (r.us, r.us))
            spans[stretch] = (min(low, r.us), max(high, r.us))
        found = self.last.get()
        known = last = found[0] if found else None
        new = []
        for low, high in (spans[s] for s in sorted(spans)):
            if last is None or low - last >= self.expiry_us:
                new.append(low)
            last = high if last is None else max(last, high)
        if last != known:
            if known is not None:
                self.handle.deleteTimer(_timer(known + self.expiry_us))
            self.last.update((last,))
            self.handle.registerTimer(_timer(last + self.expiry_us))
        return (Row(sid=key[0], key=key[1], us=us) for us in new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timer(us: int) -> int:
    """Milliseconds of a time, rounded up."""
    return -(-us // 1000)


def _with_result(keyed, processor: StatefulProcessor, schema: str) -> DataFrame:
    return keyed.transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def unseen_stream(shown: DataFrame, *, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """The rows of unseen_batch as a stream, where the batches of a log follow each other in time.

    The state is one time for each key of a session, dealt by both, so a busy session is many tasks; it goes expiry_ms after
    the key was last shown. Needs keep_state_in_rocks_db.
    """
    kinds = {f.name: f.dataType.simpleString() for f in shown.schema}
    marked = shown.select("sid", "key", F.col("at").cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at")).where("at IS NOT NULL").withWatermark("at", LATE)
    found = _with_result(marked.groupBy("sid", "key"), _Unseen(expiry_ms * 1000), f"sid {kinds['sid']}, key {kinds['key']}, us bigint")
    return found.select("sid", "key", F.timestamp_micros("us").alias("at"))


def flushed_batch(log: DataFrame, *, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """sid, path, kind, start, end, touched, flushed: what each flush of a path takes from its session's pending touches.

    log: sid, line_no, path, kind, start, end, at, flush. A row with flush takes every touch of its path since the last one;
    equal touches count once, at the last time. Touches that are expiry_ms old by then are forgotten, and so are rows without
    a time. Rows of one time are taken in order of line_no.
    """
    us = expiry_ms * 1000
    rows = log.where("at IS NOT NULL").withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("flush", F.coalesce("flush", F.lit(False)))
    after = Window.partitionBy("sid", "path").orderBy("us", "line_no").rowsBetween(1, Window.unboundedFollowing)
    taken = rows.withColumn("by", F.first(F.when(F.col("flush"), F.struct("us", "line_no")), True).over(after)).where("NOT flush AND by IS NOT NULL")
    met = taken.groupBy("sid", "path", *_TOUCH, "by").agg(F.max("us").alias("us")).where(f"by.us - us < {us}")
    return met.select("sid", "path", *_TOUCH, F.timestamp_micros("us").alias("touched"), F.timestamp_micros("by.us").alias("flushed"))


class _Pending(StatefulProcessor):
    """Pending touches of a session's path with the times at which they were last made."""

    def __init__(self, expiry_us: int):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.touches = handle.getMapState("touches", "kind string, start bigint, end bigint", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # the map is read once and written once, however many touches and flushes a batch has
        kept = {tuple(touch): us for touch, (us,) in self.touches.iterator()}
        pending, out = dict(kept), []
        for r in sorted(rows, key=lambda r: (r.us, r.line_no is None, r.line_no or 0)):
            if not r.flush:
                pending[r.kind, r.start, r.end] = r.us
                continue
            out += [Row(sid=key[0], path=key[1], kind=kind, start=start, end=end, touched=us, flushed=r.us) for (kind, start, end), us in pending.items() if r.us - us < self.expiry_us]
            pending.clear()
        for touch in kept.keys() - pending.keys():
            self.touches.removeKey(touch)
        for touch, us in pending.items():
            if kept.get(touch) != us:
                self.touches.updateValue(touch, (us,))
        self._wait(kept.values(), pending.values())
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept = {tuple(touch): us for touch, (us,) in self.touches.iterator()}
        pending = {touch: us for touch, us in kept.items() if _timer(us + self.expiry_us) > now}
        for touch in kept.keys() - pending.keys():
            self.touches.removeKey(touch)
        self._wait((), pending.values())  # the one that ran out goes by itself
        return iter(())

    def _wait(self, before: Iterable[int], after: Iterable[int]) -> None:
        """One timer a path, for the touch that goes first."""
        old, new = min(before, default=None), min(after, default=None)
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(_timer(old + self.expiry_us))
        if new is not None:
            self.handle.registerTimer(_timer(new + self.expiry_us))

    def close(self) -> None:
        pass


def flushed_stream(log: DataFrame, *, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """The rows of flushed_batch as a stream, where the batches of a log follow each other in time.

    A map state for each session and path holds its pending touches; a task holds one path's rows of one batch of one session.
    Needs keep_state_in_rocks_db.
    """
    sid = log.schema["sid"].dataType.simpleString()
    at = F.col("at").cast("timestamp")
    marked = log.where("at IS NOT NULL").select(
        "sid", "path", "line_no", "kind", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.coalesce("flush", F.lit(False)).alias("flush"), at.alias("at"), F.unix_micros(at).alias("us")
    )
    found = _with_result(marked.withWatermark("at", LATE).groupBy("sid", "path"), _Pending(expiry_ms * 1000), f"sid {sid}, path string, kind string, start bigint, end bigint, touched bigint, flushed bigint")
    return found.select("sid", "path", *_TOUCH, F.timestamp_micros("touched").alias("touched"), F.timestamp_micros("flushed").alias("flushed"))


def activity(log: DataFrame, window: str = "30 minutes") -> DataFrame:
    """sid, kind, window, n of a log (sid, kind, at), a batch or a stream: late rows up to 10 minutes count."""
    own = log.withWatermark("at", LATE) if log.isStreaming else log
    return own.groupBy("sid", "kind", F.window("at", window)).agg(F.count("*").alias("n")).select("sid", "kind", F.col("window.start").alias("start"), "n")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """sid, start, end, n: runs of a session's rows less than gap apart."""
    own = log.withWatermark("at", LATE) if log.isStreaming else log
    return own.groupBy("sid", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("sid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
