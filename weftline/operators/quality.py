"""Checks of a catalog: findings with a severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import catalog


def doctor(sets: DataFrame, anchors: DataFrame, references: DataFrame) -> DataFrame:
    """check, severity, subject of everything wrong: names, collisions, empty sets, ranges, dangling references, repeated extents."""
    found = [
        sets.where(~paths.is_set_name(F.col("name"))).select(F.lit("bad-name"), F.lit("error"), "name"),
        catalog.name_collisions(sets).select(F.lit("name-collision"), F.lit("error"), "inner"),
        sets.join(anchors.select(F.col("set_name").alias("name")).distinct(), "name", "left_anti").select(F.lit("empty-set"), F.lit("warning"), "name"),
        anchors.where("NOT whole AND (start < 1 OR end < start)").select(F.lit("bad-range"), F.lit("error"), F.col("anchor_id").cast("string")),
        catalog.dangling(references, anchors).select(F.lit("dangling-anchor"), F.lit("warning"), F.col("anchor_id").cast("string")),
        anchors.groupBy("set_name", "path", "start", "end", "whole").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated-extent"), F.lit("warning"), "set_name"),
        sets.where("message IS NULL OR trim(message) = ''").select(F.lit("no-reason"), F.lit("info"), "name"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.toDF("check", "severity", "subject").distinct()


def tampered(adds: DataFrame) -> DataFrame:
    """Staged adds whose content doesn't have the hash that was recorded with it; without content there is no finding."""
    return adds.where(F.col("content").isNotNull() & (F.sha2("content", 256) != F.col("content_sha256")))


def precheck(adds: DataFrame) -> DataFrame:
    """anchor_id, problem of adds that can't be anchored: ranges of binary files, links and submodules, files inside submodules."""
    ranged = ~F.col("whole")
    problem = F.when(ranged & F.col("is_binary"), "range of a binary file").when(ranged & F.col("is_link"), "range of a link").when(ranged & F.col("is_submodule"), "range of a submodule").when(F.col("in_submodule"), "file inside a submodule")
    return adds.withColumn("problem", problem).where("problem IS NOT NULL").select("anchor_id", "problem")
