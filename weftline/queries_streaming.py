"""Queries of streaming session logs, run over all of the event log as a stream, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.stages import streamed
from .queries import query
from .standins import views
from .streaming import seen

#: Events are far apart, so entries go after half a day.
_HOURS = 12
_MS = _HOURS * 3600 * 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen.keep_state_in_rocks_db(spark)
    # a pattern, since the table may be one file and a stream's plain path must be a folder
    return spark.readStream.schema(views(spark, sf_dir, "events")[0].schema).parquet(f"{sf_dir}/event[s].parquet")


@query(
    f"""WITH l AS (SELECT user_id AS sid, event_type AS key, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL), b AS (SELECT *, lag(us) OVER (PARTITION BY sid, key ORDER BY us) AS before FROM l)
    SELECT sid, key, us AS at_us FROM b WHERE before IS NULL OR us - before >= {_MS * 1000}"""
)
def unseen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that a user shows and didn't in the half day before, from a stream with state."""
    shown = _events(spark, sf_dir).select(F.col("user_id").alias("sid"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return streamed(seen.unseen_stream(shown, expiry_ms=_MS)).select("sid", "key", F.unix_micros("at").alias("at_us"))


@query(
    f"""WITH l AS (SELECT user_id AS sid, event_id AS line_no, concat('src/m', CAST(CAST(floor(value) AS bigint) % 5 AS varchar), '.rs') AS path, event_type AS kind, 1 + CAST(floor(value) AS bigint) % 3 AS start, epoch_us(ts) AS us, event_type = 'purchase' AS flush FROM events WHERE ts IS NOT NULL),
    n AS (SELECT *, first_value(CASE WHEN flush THEN us END IGNORE NULLS) OVER w AS by_us, first_value(CASE WHEN flush THEN line_no END IGNORE NULLS) OVER w AS by_line FROM l WINDOW w AS (PARTITION BY sid, path ORDER BY us, line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    m AS (SELECT sid, path, kind, start, by_us, by_line, max(us) AS us FROM n WHERE NOT flush AND by_us IS NOT NULL GROUP BY ALL)
    SELECT sid, path, kind, start AS start_line, us AS touched_us, by_us AS flushed_us FROM m WHERE by_us - us < {_MS * 1000}"""
)
def flushed_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each purchase flushes of its user's events in the same file, from a stream with state."""
    v = F.floor("value").cast("bigint")
    log = _events(spark, sf_dir).select(
        F.col("user_id").alias("sid"),
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("src/m"), (v % 5).cast("string"), F.lit(".rs")).alias("path"),
        F.col("event_type").alias("kind"),
        (1 + v % 3).alias("start"),
        (3 + v % 3).alias("end"),
        F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_type") == "purchase").alias("flush"),
    )
    found = streamed(seen.flushed_stream(log, expiry_ms=_MS))
    return found.select("sid", "path", "kind", F.col("start").alias("start_line"), F.unix_micros("touched").alias("touched_us"), F.unix_micros("flushed").alias("flushed_us"))
