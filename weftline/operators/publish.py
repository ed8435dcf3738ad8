"""A versioned table that several writers change: data first, then one manifest that only one of them can make.

root/data/<unique>/ holds the rows of one attempt, root/versions/<number> the name of the attempt that became the version.
A manifest is written beside and put in place by an operation that fails if the name is taken: a rename without
overwriting, which file systems of clusters make at once, or a hard link on a local disk, whose rename would check first and
then move. Readers see whole versions only: a folder of data that no manifest names doesn't exist for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text


class VersionTaken(Exception):
    """Another writer published the version first."""


class ConflictExhausted(Exception):
    """Every attempt met another writer's version."""


class Catalog:
    """The table under `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}".rstrip("/"))

    def version(self) -> int:
        """The newest version, 0 if there's none."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return 0
        return max((int(name) for s in self._fs.listStatus(folder) if (name := s.getPath().getName()).isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, of the newest one by default; None before the first."""
        version = self.version() if version is None else version
        if not version:
            return None
        stream = self._fs.open(self._path(f"versions/{version:012d}"))
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.root}/data/{name}")

    def publish(self, rows: DataFrame, expected: int) -> int:
        """Makes rows the version after `expected`; VersionTaken if that one is there, and then nothing is left behind."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}")
        draft, final = self._path(f"versions/.{name}"), self._path(f"versions/{expected + 1:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        try:
            self._put(draft, final)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(f"data/{name}"), True)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise VersionTaken(f"version {expected + 1} exists") from None
            raise
        return expected + 1

    def _put(self, draft, final) -> None:
        jvm = self.spark._jvm
        if self._fs.getUri().getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(place(final), place(draft))
            self._fs.delete(draft, False)
        else:
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)

    def update(self, change: Callable[[DataFrame | None], DataFrame], retries: int = 5) -> int:
        """Publishes change(newest rows); where another writer was first, it loads what that one made and tries again."""
        for _ in range(retries):
            version = self.version()
            try:
                return self.publish(change(self.read(version)), version)
            except VersionTaken:
                continue
        raise ConflictExhausted(f"{retries} attempts met other writers")


def prepared_adds(targets: DataFrame, contents: DataFrame) -> DataFrame:
    """Staged adds of targets (set_name, path, start, end, whole), with content_sha of their lines and `refused` where there
    is a reason: the path isn't there, the range isn't one, or it ends beyond the file.

    contents: path, text. A target is refused by the first reason that holds; a refused one has no digest.
    """
    lines = text.lines_trimmed(F.col("text"))
    rows = targets.join(contents.select("path", "text"), "path", "left")
    reason = F.when(F.col("text").isNull(), "no such file").when(F.col("whole"), None).when(~((F.col("start") >= 1) & (F.col("start") <= F.col("end"))), "not a range").when(F.col("end") > F.size(lines), "beyond the end")
    part = F.array_join(text.line_slice(lines, F.col("start"), F.col("end")), "\n")
    kept: Column = F.when(reason.isNull(), F.sha2(F.when(F.col("whole"), F.col("text")).otherwise(part), 256))
    return rows.select("set_name", "path", "start", "end", "whole", paths.address(F.col("path"), F.col("start"), F.col("end"), F.col("whole")).alias("address"), kept.alias("content_sha"), reason.alias("refused"))
