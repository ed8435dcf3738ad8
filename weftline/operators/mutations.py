"""Catalog mutation: staged operations become a new version of each set.

staging: set_name, line_no, op (add, remove, config, why), path, start, end, whole, key, value, anchor_id, content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .publish import Catalog

EXTENT = ["set_name", "path", "start", "end", "whole"]
DEFAULTS = {"copy_detection": "same-commit", "ignore_whitespace": "false", "follow_moves": "false"}


def staged_adds(staging: DataFrame) -> DataFrame:
    """The last add of each path and extent; a null start is the whole file."""
    last = Window.partitionBy(*EXTENT).orderBy(F.desc("line_no"))
    return staging.where("op = 'add'").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def missing_removes(anchors: DataFrame, staging: DataFrame) -> DataFrame:
    """Removes of what neither the catalog nor the staging area holds: an error of a commit."""
    known = anchors.select(*EXTENT).union(staging.where("op = 'add'").select(*EXTENT))
    gone = staging.where("op = 'remove'").select(*EXTENT, "line_no")
    same = [gone[c].eqNullSafe(known[c]) for c in EXTENT]
    return gone.join(known, same, "left_anti")


def committed(anchors: DataFrame, staging: DataFrame) -> DataFrame:
    """set_name, version, anchor_id, path, start, end, whole after a commit: removes, replaced extents, adds; version goes up.

    Sets without staged adds or removes keep their rows. Anchors of a set go by path and extent.
    """
    adds = staged_adds(staging)
    touched = staging.where("op IN ('add', 'remove')").select("set_name").distinct()
    gone = staging.where("op = 'remove'").select(*EXTENT).union(adds.select(*EXTENT)).distinct()
    now = anchors.join(touched, "set_name", "left_semi").select("set_name", "version", "anchor_id", *EXTENT[1:])
    kept = now.join(gone, [now[c].eqNullSafe(gone[c]) for c in EXTENT], "left_anti").select("set_name", "anchor_id", *EXTENT[1:])
    rows = kept.unionByName(adds.select("set_name", "anchor_id", *EXTENT[1:]))
    version = anchors.groupBy("set_name").agg(F.max("version").alias("v"))
    new = rows.join(version, "set_name", "left").withColumn("version", F.coalesce("v", F.lit(0)).cast("long") + 1)
    rest = anchors.join(touched, "set_name", "left_anti")
    cols = ["set_name", "version", "anchor_id", *EXTENT[1:]]
    return rest.select(*cols).unionByName(new.select(*cols))


def configs(staging: DataFrame, sets: DataFrame) -> DataFrame:
    """set_name, key, value of every set: what was staged last, else the default."""
    last = staging.where("op = 'config'").groupBy("set_name", "key").agg(F.max_by("value", "line_no").alias("staged"))
    every = sets.select(F.col("name").alias("set_name")).distinct().crossJoin(F.broadcast(_defaults(sets.sparkSession)))
    return every.join(last, ["set_name", "key"], "left").select("set_name", "key", F.coalesce("staged", "value").alias("value"))


def _defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULTS.items()), "key string, value string")


def reasons(staging: DataFrame, sets: DataFrame) -> DataFrame:
    """set_name, message: the last staged reason, else the one there is; a new set without one is an error row (null)."""
    last = staging.where("op = 'why'").groupBy("set_name").agg(F.max_by("value", "line_no").alias("staged"))
    now = sets.groupBy(F.col("name").alias("set_name")).agg(F.max_by("message", "version").alias("now"))
    return now.join(last, "set_name", "full_outer").select("set_name", F.coalesce("staged", "now").alias("message"))


def compacted(resolved: DataFrame) -> DataFrame:
    """anchor_id, outcome of compaction; resolved: set_name, anchor_id, status, at_head, whole, head_blob, blob, has_staged.

    Fresh anchors advance to the head; a whole file that only seems orphaned does if the head's blob is the same. Sets
    with staged changes are left alone.
    """
    outcome = (
        F.when(F.col("has_staged"), "skipped: staged")
        .when((F.col("status") == "Fresh") & F.col("at_head"), "unchanged")
        .when(F.col("status") == "Fresh", "advanced")
        .when((F.col("status") == "Orphaned") & F.col("whole") & (F.col("head_blob") == F.col("blob")), "advanced")
        .otherwise(F.concat(F.lit("skipped: "), F.lower("status")))
    )
    return resolved.select("set_name", "anchor_id", outcome.alias("outcome"))


def followed(resolved: DataFrame) -> DataFrame:
    """Anchors that follow their moved lines: same path, no changed anchor in the set, and a blob at the head that differs."""
    steady = resolved.groupBy("set_name").agg(F.max((F.col("status") == "Changed").cast("int")).alias("c")).where("c = 0").select("set_name")
    moved = (F.col("status") == "Moved") & ~F.col("whole") & (F.col("now_path") == F.col("path")) & (F.col("head_blob") != F.col("blob"))
    return resolved.where(moved).join(steady, "set_name", "left_semi")


def rewritten(anchors: DataFrame, rewrites: DataFrame, blobs: DataFrame) -> DataFrame:
    """anchors with their commits mapped (old, new) where path has the same blob (commit_id, path, blob) on both sides.

    Repeated old commits are an error of the caller: see bad_rewrites.
    """
    usable = rewrites.where("old <> new")
    side = lambda c, b: blobs.select(F.col("commit_id").alias(c), "path", F.col("blob").alias(b))
    ok = anchors.select("anchor_id", F.col("commit_id").alias("old"), "path").join(usable, "old").join(side("old", "x"), ["old", "path"]).join(side("new", "y"), ["new", "path"]).where("x = y").select("anchor_id", "new")
    return anchors.join(ok, "anchor_id", "left").withColumn("commit_id", F.coalesce("new", "commit_id")).drop("new")


def bad_rewrites(rewrites: DataFrame) -> DataFrame:
    shape = "^[0-9a-f]{40}$"
    twice = F.count("*").over(Window.partitionBy("old")) > 1
    return rewrites.withColumn("twice", twice).where(F.col("twice") | ~F.col("old").rlike(shape) | ~F.col("new").rlike(shape)).drop("twice")


def renamed(rows: DataFrame, old: str, new: str, *, name: str = "set_name") -> DataFrame:
    """The set under a new name; an error when run if the new name is taken."""
    taken = rows.where(F.col(name) == new).limit(1).agg(F.count("*").alias("__taken"))
    checked = rows.crossJoin(F.broadcast(taken))
    value = F.when((F.col(name) == old) & (F.col("__taken") == 1), F.raise_error(F.lit(f"set {new} exists")).cast("string")).when(F.col(name) == old, new).otherwise(F.col(name))
    return checked.withColumn(name, value).drop("__taken")


def reverted(rows: DataFrame, name: str, version: int) -> DataFrame:
    """rows and, as the newest version, the set as it was at `version`."""
    newest = rows.where(F.col("set_name") == name).agg(F.max("version").alias("__v"))
    old = rows.where((F.col("set_name") == name) & (F.col("version") == version)).crossJoin(F.broadcast(newest))
    return rows.unionByName(old.withColumn("version", F.col("__v") + 1).drop("__v"))


def save(rows: DataFrame, path: str, expected: int) -> int:
    """Publishes a new version of a catalog table if its newest one is still `expected`, and gives the new number.

    Of two writers at once one gets VersionTaken, and can load and try again; Catalog.update does that.
    """
    return Catalog(rows.sparkSession, path).publish(rows, expected)
