"""Drift read from contents: which anchors' lines changed, where and when, from versions of files and the layers over them.

versions: path, seq, text (null where the commit deleted the file), one row for each change of a file's content.
changes: seq, op, from_path, to_path as in `drift`, without hunks. anchors: anchor_id, path, start, end, whole, seq (the
commit they were set at). layers: layer ('index', 'worktree'), path (in the layer below), to_path (null if deleted there),
text. Lines are compared by 64-bit hashes; texts never meet anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges, text
from ..plans.stages import spread, stage
from . import diff, drift

LINES = "array<bigint>"


def digests(rows: DataFrame, *, ignore_space: bool = False) -> DataFrame:
    """rows with `lines`, the hashes of the text's lines, in place of text; null for a null text."""
    bare = (lambda x: F.regexp_replace(x, r"\s+", "")) if ignore_space else (lambda x: x)
    lines = F.transform(text.lines_trimmed(F.col("text")), lambda x: F.xxhash64(bare(x)))
    return rows.select(*(c for c in rows.columns if c != "text"), lines.alias("lines"))


def as_of(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """asked (path, at, ...) with `version`, the seq of the path's newest version up to `at`, null if there's none.

    Questions and versions of a path are merged in order of seq by one window; nothing is paired.
    """
    told = versions.select("path", F.col("seq").alias("at"), F.col("seq").cast("long").alias("__own"))
    rows = asked.withColumn("__asks", F.lit(1)).unionByName(told.withColumn("__asks", F.lit(0)), allowMissingColumns=True)
    up_to = Window.partitionBy("path").orderBy("at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("version", F.last("__own", ignorenulls=True).over(up_to))
    return found.where("__asks = 1").drop("__asks", "__own")


def _places(contents: DataFrame) -> int:
    """The number of lines of all versions."""
    return contents.agg(F.coalesce(F.sum(F.greatest(F.size("lines"), F.lit(0))), F.lit(0))).head()[0]


def line_changes(contents: DataFrame, rows: int) -> DataFrame:
    """path, line, seq: the places (1-based) whose line a version changed, made or took away, compared with the version before.

    rows: the number of lines of all versions. A place that a version made may be told twice.
    """
    sizes = contents.select("path", "seq", F.coalesce(F.size("lines"), F.lit(0)).alias("n"))
    sizes = sizes.withColumn("n", F.greatest("n", F.lit(0)))
    older = sizes.withColumn("was", F.lag("n").over(Window.partitionBy("path").orderBy("seq"))).where("was <> n")
    ends = older.select("path", F.explode(F.sequence((F.least("n", "was") + 1).cast("long"), F.greatest("n", "was").cast("long"))).alias("line"), "seq")
    each = contents.select("path", "seq", F.posexplode("lines").alias("line", "hash")).withColumn("line", (F.col("line") + 1).cast("long"))
    each = spread(each, rows, "path", "line")
    before = F.lag("hash").over(Window.partitionBy("path", "line").orderBy("seq"))
    return each.withColumn("was", before).where("was <> hash").select("path", "line", "seq").union(ends)


def locus(anchors: DataFrame, contents: DataFrame, changes: DataFrame) -> DataFrame:
    """anchor_id, kind, seq of the first change that made an anchor drift: its file's deletion or renaming (orphaned), or a
    version in which its original lines read otherwise (changed); null where there was none and for whole files.

    contents: path, seq, lines. An anchor asks for each of its lines when that place next changes.
    """
    n = _places(contents)
    some = anchors.where("NOT whole").select("anchor_id", "path", F.col("seq").alias("since"), "start", "end")
    lines = some.where("start <= end").select("anchor_id", "path", "since", F.explode(F.sequence("start", "end")).alias("line"))
    changed = drift.next_after(lines, line_changes(contents, n), "path", "line", rows=n).groupBy("anchor_id").agg(F.min("next").alias("changed"))
    moves = changes.where("op IN ('deleted', 'renamed')").select(F.col("from_path").alias("path"), "seq")
    moved = drift.next_after(some.select("anchor_id", "path", "since"), moves, "path").select("anchor_id", F.col("next").alias("moved"))
    both = anchors.select("anchor_id").join(changed, "anchor_id", "left").join(moved, "anchor_id", "left")
    first = F.least("changed", "moved")
    kind = F.when(F.col("moved") == first, "orphaned").when(F.col("changed") == first, "changed")
    return both.select("anchor_id", kind.alias("kind"), first.alias("seq"))


def with_content(rows: DataFrame, contents: DataFrame, path: str, version: str, name: str) -> DataFrame:
    """rows with the lines of (path, version) under `name`."""
    held = contents.select(F.col("path").alias(path), F.col("seq").alias(version), F.col("lines").alias(name))
    return rows.join(held, [path, version], "left")


def hunked(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """changes with hunks from the contents before and after; those that aren't modifications or renames have none."""
    read = changes.where("op IN ('modified', 'renamed')")
    asked = as_of(read.withColumn("path", F.col("from_path")).withColumn("at", F.col("seq") - 1), contents).drop("path", "at")
    both = with_content(with_content(asked, contents, "from_path", "version", "old"), contents, "to_path", "seq", "new")
    found = diff.with_hunks(both.select("seq", "op", "from_path", "to_path", "old", "new")).drop("old", "new")
    rest = changes.where("op NOT IN ('modified', 'renamed')").select("seq", "op", "from_path", "to_path", F.lit(None).cast(drift.HUNKS).alias("hunks"))
    return stage(found.select("seq", "op", "from_path", "to_path", "hunks").union(rest))


def _place(path: str) -> Column:
    """A path to join on; an anchor without one has a key of its own, which no path equals, so those don't meet in one task."""
    return F.coalesce(F.col(path), F.concat(F.lit("\0"), F.col("anchor_id").cast("string")))


def _through(rows: DataFrame, layer: DataFrame, head: DataFrame, of: str) -> DataFrame:
    """rows with path_, lines_ and range_ of a layer, from those of the layer below (path, lines, s, e).

    layer: path, to_path, lines of changed files; head: path, lines below. A change is compared with its file once, if an
    anchor lies there.
    """
    layer = layer.join(rows.select(F.col("path_").alias("path")).distinct(), "path", "left_semi")
    changed = stage(diff.with_hunks(layer.join(head.select("path", F.col("lines").alias("old")), "path", "left").withColumnRenamed("lines", "new")))
    met = changed.select(F.col("path").alias("b_path"), F.lit(True).alias("hit"), "to_path", F.col("new").alias("to_lines"), "hunks")
    out = rows.join(met, _place("path_") == F.col("b_path"), "left").drop("b_path")
    hunks = F.coalesce("hunks", F.array().cast(drift.HUNKS))
    out = out.withColumn("hunks", hunks).withColumn("m", F.expr(ranges.moved_by("s_", "e_", "hunks")))
    moved = F.coalesce("hit", F.lit(False))
    out = out.withColumn("path_", F.when(moved, F.col("to_path")).otherwise(F.col("path_"))).withColumn("lines_", F.when(moved, F.col("to_lines")).otherwise(F.col("lines_")))
    ranged = F.col("path_").isNotNull() & ~F.col("whole")
    out = out.withColumn("s_", F.when(ranged, F.col("m.s"))).withColumn("e_", F.when(ranged, F.col("m.e")))
    part = F.when(F.col("whole"), F.col("lines_")).otherwise(text.line_slice(F.col("lines_"), F.col("s_"), F.col("e_")))
    return out.withColumn(of, F.when(F.col("path_").isNotNull(), part)).drop("hit", "to_path", "to_lines", "hunks", "m")


def latest(contents: DataFrame) -> DataFrame:
    """path, lines of each file as the last commit left it, without deleted ones."""
    last = contents.groupBy("path").agg(F.max("seq").alias("seq"))
    return contents.join(last, ["path", "seq"], "left_semi").where("lines IS NOT NULL").select("path", "lines")


def under(layer: DataFrame, below: DataFrame) -> DataFrame:
    """path, lines of all files with a layer's changes put over those below."""
    kept = below.join(layer.select("path").union(layer.where("to_path IS NOT NULL").select("to_path")).distinct(), "path", "left_anti")
    return kept.unionByName(layer.where("to_path IS NOT NULL").select(F.col("to_path").alias("path"), "lines"))


def followed(anchors: DataFrame, contents: DataFrame, changes: DataFrame) -> DataFrame:
    """anchors with what the commits alone tell: then_lines as they were set, head_path, head_start, head_end, kind, locus_seq."""
    carried = stage(drift.carried(anchors, drift.trails(anchors, hunked(changes, contents))))
    rows = with_content(as_of(carried.withColumn("at", F.col("seq")), contents), contents, "path", "version", "anchored").drop("at", "version")
    then = F.when(F.col("whole"), F.col("anchored")).otherwise(text.line_slice(F.col("anchored"), F.col("start"), F.col("end")))
    rows = rows.select(*anchors.columns, then.alias("then_lines"), F.col("now_path").alias("head_path"), F.col("now_start").alias("head_start"), F.col("now_end").alias("head_end"))
    return rows.join(stage(locus(anchors, contents, changes)).withColumnRenamed("seq", "locus_seq"), "anchor_id", "left")


def layered(rows: DataFrame, columns: list[str], head: DataFrame, layers: DataFrame, conflicted: DataFrame | None = None) -> DataFrame:
    """The findings of followed anchors with the layers put over the last commit, and index_path, where the index has each.

    columns: the anchors' own. head: path, lines. layers: layer, path, to_path, lines.
    """
    index, worktree = (layers.where(F.col("layer") == of).select("path", "to_path", "lines") for of in ("index", "worktree"))
    indexed = stage(under(index, head))
    now = under(worktree, indexed)

    rows = rows.withColumn("path_", F.col("head_path")).withColumnRenamed("head_start", "s_").withColumnRenamed("head_end", "e_")
    rows = rows.join(head.select(F.col("path").alias("b_path"), F.col("lines").alias("lines_")), _place("path_") == F.col("b_path"), "left").drop("b_path")
    rows = rows.withColumn("path_", F.when(F.col("lines_").isNotNull(), F.col("path_")))
    at_head = F.when(F.col("whole"), F.col("lines_")).otherwise(text.line_slice(F.col("lines_"), F.col("s_"), F.col("e_")))
    rows = rows.withColumn("in_head", at_head)
    rows = stage(_through(stage(rows), index, head, "in_index").withColumn("index_path", F.col("path_")))
    rows = stage(_through(rows, worktree, indexed, "in_worktree"))

    there = now.select("path", F.lit(True).alias("path_there"))
    rows = rows.join(there, "path", "left").withColumn("path_there", F.coalesce("path_there", F.lit(False)))
    torn = (conflicted.select("path") if conflicted is not None else rows.select("path").limit(0)).distinct().withColumn("conflicted", F.lit(True))
    rows = rows.join(torn, "path", "left").withColumn("conflicted", F.coalesce("conflicted", F.lit(False)))
    sources = drift.layer_sources(F.col("in_head"), F.col("in_index"), F.col("in_worktree"), F.col("then_lines"), F.col("whole"))
    named = rows.select(
        *columns, F.lit(True).alias("reachable"), "conflicted", F.lit(None).cast("string").alias("unavailable"), "path_there",
        F.col("path_").alias("now_path"), F.col("s_").alias("now_start"), F.col("e_").alias("now_end"), "then_lines", F.col("in_worktree").alias("now_lines"), sources.alias("sources"),
        "kind", "locus_seq", "index_path",
    )
    return drift.classified(named).select(*columns, "now_path", "now_start", "now_end", "status", "sources", "kind", "locus_seq", "index_path")


def resolve(anchors: DataFrame, versions: DataFrame, changes: DataFrame, layers: DataFrame, *, conflicted: DataFrame | None = None, ignore_space: bool = False) -> DataFrame:
    """anchors with now_path, now_start, now_end, status, sources (layers that drift), kind and locus_seq.

    Ranges are carried through the commits' hunks, then through the index' and the working tree's, all of them computed from
    the contents. conflicted: paths with unmerged entries. An anchor whose range isn't whole but has no start is an error of
    the caller's.
    """
    contents = stage(digests(versions, ignore_space=ignore_space))
    rows = followed(anchors, contents, changes)
    found = layered(rows, anchors.columns, stage(latest(contents)), digests(layers, ignore_space=ignore_space), conflicted)
    return found.drop("index_path")
