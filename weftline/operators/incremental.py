"""Drift resolved anew for the anchors that a change of the layers, of conflicts or of the anchors can reach, and for no others.

A baseline keeps what the commits tell of each anchor, the files of the last commit, the layers it was made with, and the
findings. The commits are told by a key of the caller's (the id of the last one): under another key nothing is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import held
from . import content


@dataclass(frozen=True)
class Baseline:
    """key: of the commits and how lines are compared. followed, findings: a row an anchor, with `mark`, the anchor's digest.
    head: path, lines of the last commit. layers, conflicted: those that the findings were made with. All are tables."""

    key: tuple[str, bool]
    columns: tuple[str, ...]
    followed: DataFrame
    head: DataFrame
    layers: DataFrame
    conflicted: DataFrame
    findings: DataFrame

    def result(self) -> DataFrame:
        """The columns of content.resolve."""
        return self.findings.drop("mark", "index_path")


def mark(columns: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(columns)])


def _torn(conflicted: DataFrame | None, anchors: DataFrame) -> DataFrame:
    return anchors.select("path").limit(0) if conflicted is None else conflicted.select("path").distinct()


def _follow(anchors: DataFrame, versions: DataFrame, changes: DataFrame, ignore_space: bool) -> tuple[DataFrame, DataFrame]:
    contents = held(content.digests(versions, ignore_space=ignore_space))
    rows = content.followed(anchors, contents, changes)
    return rows.withColumn("mark", mark(anchors.columns)), contents


def baseline(anchors: DataFrame, versions: DataFrame, changes: DataFrame, layers: DataFrame, key: str, *, conflicted: DataFrame | None = None, ignore_space: bool = False) -> Baseline:
    """Everything resolved from the start."""
    rows, contents = _follow(anchors, versions, changes, ignore_space)
    rows, head = held(rows), held(content.latest(contents))
    over, torn = held(content.digests(layers, ignore_space=ignore_space)), held(_torn(conflicted, anchors))
    found = held(content.layered(rows, [*anchors.columns, "mark"], head, over, torn))
    return Baseline((key, ignore_space), tuple(anchors.columns), rows, head, over, torn, found)


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows on one side alone; a row that is repeated counts once."""
    both = old.withColumn("__side", F.lit(1)).unionByName(new.withColumn("__side", F.lit(2)))
    return both.groupBy(*old.columns).agg(F.count_distinct("__side").alias("__n")).where("__n = 1").drop("__n")


def dirty_paths(base: Baseline, over: DataFrame, torn: DataFrame) -> DataFrame:
    """The paths named by a layer's entry or a conflict that is new, gone or another one than in the baseline."""
    brief = lambda rows: rows.select("layer", "path", "to_path", F.xxhash64("lines").alias("mark"), F.size("lines").alias("n"))
    entries = _differing(brief(base.layers), brief(over)).select(F.explode(F.array("path", "to_path")).alias("path"))
    return entries.where("path IS NOT NULL").union(_differing(base.conflicted.select("path"), torn)).distinct()


def affected(base: Baseline, rows: DataFrame, dirty: DataFrame) -> DataFrame:
    """anchor_id, mark of the followed anchors to be resolved anew.

    A finding reads the layers at three paths: the anchor's own, the one it has in the last commit, and the one it has in
    the index. Where no entry at these differs, and the anchor is the baseline's, the finding is the same.
    """
    known = base.findings.select("anchor_id", "mark", "index_path", F.lit(True).alias("known"))
    told = rows.select("anchor_id", "mark", "path", "head_path").join(known, ["anchor_id", "mark"], "left")
    new = told.where("known IS NULL").select("anchor_id", "mark")
    reached = told.where("known").select("anchor_id", "mark", F.explode(F.array_distinct(F.array("path", "head_path", "index_path"))).alias("path"))
    return new.union(reached.join(dirty, "path", "left_semi").select("anchor_id", "mark")).distinct()


def update(base: Baseline, anchors: DataFrame, versions: DataFrame, changes: DataFrame, layers: DataFrame, key: str, *, conflicted: DataFrame | None = None, ignore_space: bool = False) -> Baseline:
    """The baseline of the present anchors, layers and conflicts; its result equals that of content.resolve.

    Under another key, comparison or set of anchor columns everything is resolved from the start. Else versions and changes
    are read only if anchors are new or differ, and of the files and layers only what affected anchors ask for.
    """
    if base.key != (key, ignore_space) or base.columns != tuple(anchors.columns):
        return baseline(anchors, versions, changes, layers, key, conflicted=conflicted, ignore_space=ignore_space)
    over, torn = held(content.digests(layers, ignore_space=ignore_space)), held(_torn(conflicted, anchors))
    marked = held(anchors.withColumn("mark", mark(anchors.columns)))
    same = base.followed.join(marked.select("anchor_id", "mark"), ["anchor_id", "mark"], "left_semi")
    fresh = marked.join(base.followed.select("anchor_id", "mark"), ["anchor_id", "mark"], "left_anti").drop("mark")
    rows = same if fresh.isEmpty() else same.unionByName(_follow(fresh, versions, changes, ignore_space)[0])
    rows = held(rows)
    redone = held(affected(base, rows, dirty_paths(base, over, torn)))
    kept = base.findings.join(marked.select("anchor_id", "mark"), ["anchor_id", "mark"], "left_semi").join(redone, ["anchor_id", "mark"], "left_anti")
    asked = held(rows.join(redone, ["anchor_id", "mark"], "left_semi"))
    # what the affected anchors can read: their own paths, and the entries that lead from those
    own = asked.select(F.explode(F.array("path", "head_path")).alias("path"))
    named = over.select(F.explode(F.array("path", "to_path")).alias("path"))
    head = base.head.join(own.union(named).distinct(), "path", "left_semi")
    found = content.layered(asked, [*anchors.columns, "mark"], head, over, torn)
    return Baseline(base.key, base.columns, rows, base.head, over, torn, held(kept.unionByName(found.select(*kept.columns))))
