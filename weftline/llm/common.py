"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir. Only a local master may do without: it gets one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="weftline-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder: computed once, safe against lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows from a compressed Parquet table in the shared folder, or in `folder`.

    Nothing behind the table is read again, so the shuffle files of the query that writes it go when it ends.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/weftline-{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder in the shared one for the tables between an operator's steps; it is deleted when the block ends.

    What the block returns must not read it any more: store the result outside.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def keep(self, df: DataFrame) -> DataFrame:
        return stored(df, self.folder)

    def drop(self, *held: DataFrame) -> None:
        """Deletes tables of this folder that no later step reads."""
        for df in held:
            for file in df.inputFiles()[:1]:
                self._delete(file.rsplit("/", 1)[0])


_caches: dict[str, Callable[[], None]] = {}
#: Tasks under way in this worker, when the last one ended, and how many seconds later the caches go.
_work = {"tasks": 0, "ended": 0.0, "watched": False}
IDLE = 4.0


def begin(operator: str, clear: Callable[[], None] | None = None) -> None:
    """Called in a Python worker where an operator's task begins: what other operators keep in this worker is cleared.

    Workers are reused from task to task and stage to stage, so a cache would else stay beside all that follows. An
    operator with a cache calls done() where the task ends; some seconds after the last one the cache goes too.
    """
    for other in [o for o in _caches if o != operator]:
        _caches.pop(other)()
    if clear:
        _caches[operator] = clear
        _work["tasks"] += 1
        if not _work["watched"]:
            _work["watched"] = True
            threading.Thread(target=_watch, daemon=True).start()


def done() -> None:
    _work["tasks"], _work["ended"] = max(0, _work["tasks"] - 1), time.monotonic()


def _watch() -> None:
    while True:
        time.sleep(1)
        if _caches and not _work["tasks"] and time.monotonic() - _work["ended"] > IDLE:
            for operator in [*_caches]:
                _caches.pop(operator)()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # the C library gives free memory back, where it can
                ctypes.CDLL(None).malloc_trim(0)
