"""Layers over the catalog: what the index and the working tree change, what is staged, and what is asked for by name.

layer_changes: layer ('index', 'worktree'), op ('added', 'modified', 'deleted', 'renamed', 'mode'), from_path, to_path,
unmerged. staged: set_name, op ('add', 'remove', 'config', 'why'), path, start, end, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: The two letters of a status line: what happened in the index, and in the working tree. Fixed values.
STATUS_OPS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "mode"}
UNMERGED = ("DD", "AU", "UD", "UA", "DU", "AA", "UU")


def parsed_status(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """layer_changes of status lines `XY path` or `XY to<NUL>from`; untracked files and branch lines give none."""
    code, rest = F.substr(line, F.lit(1), F.lit(2)), F.split(F.expr(f"substr({line}, 4)"), "\0")
    unmerged = code.isin(*UNMERGED)
    known = F.create_map(*[F.lit(x) for kv in STATUS_OPS.items() for x in kv])
    rows = lines.where(F.col(line).rlike("^[ A-Z]{2} .")).select(unmerged.alias("unmerged"), code.alias("code"), rest.getItem(0).alias("to_path"), F.try_element_at(rest, F.lit(2)).alias("old"))
    sides = F.array(*[F.struct(F.lit(layer).alias("layer"), F.try_element_at(known, F.substr("code", F.lit(k), F.lit(1))).alias("op")) for layer, k in (("index", 1), ("worktree", 2))])
    each = F.when(F.col("unmerged"), F.array(F.struct(F.lit("worktree").alias("layer"), F.lit("modified").alias("op")))).otherwise(F.filter(sides, lambda s: s["op"].isNotNull()))
    out = rows.select(F.explode(each).alias("s"), "to_path", "old", "unmerged")
    return out.select("s.layer", "s.op", F.when(F.col("s.op").isin("renamed", "copied"), F.col("old")).otherwise(F.col("to_path")).alias("from_path"), "to_path", "unmerged")


def layer_probe(changes: DataFrame) -> DataFrame:
    """One row: whether the index, the working tree and conflicts hold anything, and how many paths they touch."""
    named = F.when(F.col("layer") == "index", F.col("to_path")), F.when(F.col("layer") == "worktree", F.col("to_path"))
    return changes.agg(
        F.coalesce(F.max(F.col("layer") == "index"), F.lit(False)).alias("index_dirty"),
        F.coalesce(F.max(F.col("layer") == "worktree"), F.lit(False)).alias("worktree_dirty"),
        F.coalesce(F.max("unmerged"), F.lit(False)).alias("conflicted"),
        F.countDistinct(named[0]).alias("index_paths"),
        F.countDistinct(named[1]).alias("worktree_paths"),
    )


def layer_diff(changes: DataFrame, layer: str, wanted: DataFrame | None = None) -> DataFrame:
    """op, from_path, to_path of a layer's changes; of the wanted ones (path) only, by either path, if given."""
    rows = changes.where(F.col("layer") == layer).select("op", "from_path", "to_path").distinct()
    if wanted is None:
        return rows
    asked = wanted.select("path").distinct()
    return rows.join(asked, F.col("to_path") == F.col("path"), "left_semi").union(rows.join(asked, F.col("to_path") == F.col("path"), "left_anti").join(asked, F.col("from_path") == F.col("path"), "left_semi"))


def conflicted(changes: DataFrame) -> DataFrame:
    return changes.where("unmerged").select(F.col("to_path").alias("path")).distinct()


def dirty_paths(changes: DataFrame, staged: DataFrame) -> DataFrame:
    """path of all that a layer changes, both sides of a rename, and of all that is staged."""
    sides = changes.select(F.explode(F.array_compact(F.array("from_path", "to_path"))).alias("path"))
    return sides.union(staged.where("path IS NOT NULL").select("path")).distinct()


def path_fingerprints(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """path, print of wanted paths: a hash of kind and content (path, kind, body), or of `missing`."""
    rows = wanted.select("path").distinct().join(contents, "path", "left")
    return rows.select("path", F.sha2(F.concat_ws("\0", F.coalesce("kind", F.lit("missing")), F.coalesce("body", F.lit(""))), 256).alias("print"))


def overlay_key(prints: DataFrame) -> DataFrame:
    """One row: a hash that tells the state of all dirty paths, from hashes by path that are combined in any order."""
    each = F.xxhash64("path", "print")
    return prints.agg(F.count("*").alias("paths"), F.coalesce(F.bit_xor(each), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(F.xxhash64(each, F.lit(1))), F.lit(0)).alias("y"))


def clean_sets(anchors: DataFrame, dirty: DataFrame, head: str | int) -> DataFrame:
    """set_name of sets all of whose anchors (commit_id, path, blob, head_blob) are at head, unchanged, on paths that no layer touches."""
    marked = anchors.join(dirty.select("path").distinct().withColumn("__dirty", F.lit(True)), "path", "left")
    ok = (F.col("commit_id") == F.lit(head)) & F.col("blob").eqNullSafe(F.col("head_blob")) & F.col("__dirty").isNull()
    return marked.groupBy("set_name").agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok")).where("ok").select("set_name")


def anchor_by_id(anchors: DataFrame, references: DataFrame, anchor_id: str | int) -> DataFrame:
    """The anchor's rows by its reference (anchor_id, set_name); if it has none, by a look at all sets."""
    of = anchors.where(F.col("anchor_id") == F.lit(anchor_id))
    named = of.join(references.where(F.col("anchor_id") == F.lit(anchor_id)).select("set_name").distinct(), "set_name", "left_semi")
    found = named.agg((F.count("*") > 0).alias("__found"))
    return named.select(*anchors.columns).union(of.crossJoin(F.broadcast(found)).where("NOT __found").select(*anchors.columns))


def resolve_named(anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """ord, set_name, anchor_id, path, status for each set asked for (ord, set_name), in that order.

    A set that isn't there has one row with the status `unknown set`; an anchor listed in a set whose own record is
    missing (path is null) is an orphaned placeholder.
    """
    rows = wanted.join(anchors.select("set_name", "anchor_id", "path"), "set_name", "left")
    status = F.when(F.col("anchor_id").isNull(), "unknown set").when(F.col("path").isNull(), "orphaned").otherwise("resolved")
    return rows.select("ord", "set_name", "anchor_id", "path", status.alias("status")).orderBy("ord", "anchor_id")


def staged_only(staged: DataFrame) -> DataFrame:
    """set_name of sets with anything staged."""
    return staged.where(F.col("op").isin("add", "remove", "config", "why")).select("set_name").distinct()


def shown_anchors(anchors: DataFrame, staged: DataFrame) -> DataFrame:
    """set_name, path, start, end, whole, state: committed anchors less those staged for removal, and staged additions not there yet."""
    keys = ["set_name", "path", "start", "end", "whole"]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    removed = staged.where("op = 'remove'").select(*keys).distinct()
    added = staged.where("op = 'add'").select(*keys).distinct()
    held = anchors.select(*keys)
    kept = held.join(removed, same(held, removed), "left_anti").withColumn("state", F.lit("committed"))
    return kept.union(added.join(held, same(added, held), "left_anti").withColumn("state", F.lit("staged")))


def target_cascade(anchors: DataFrame, staged: DataFrame, files: DataFrame, targets: list[str]) -> DataFrame:
    """target, set_name, rule: the sets that each target means, by the first rule that finds any.

    0 a range `path#L<s>-L<e>`, 1 a set's name, 2 a staged set's name, 3 a glob over paths, 4 a path. A target that
    finds none is a row with the rule `no sets` if it is a file (path), else `missing`.
    """
    spark = anchors.sparkSession
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    parsed = asked.withColumn("a", paths.parsed_address(F.col("target")))
    held = anchors.select("set_name", "path", "start", "end", "whole").union(staged.where("op = 'add'").select("set_name", "path", "start", "end", "whole"))
    ranged = parsed.where("NOT a.whole").select("target", F.col("a.path").alias("path"), F.col("a.start").alias("s"), F.col("a.end").alias("e"))
    found = ranged.join(held, "path").where("whole OR (start <= e AND end >= s)").select("target", "set_name", F.lit(0).alias("rule"))
    plain = parsed.where("a.whole").select("target")
    for rule, rows in ((1, anchors), (2, staged)):
        found = found.union(plain.join(rows.select("set_name").distinct(), F.col("target") == F.col("set_name")).select("target", "set_name", F.lit(rule)))
    for glob in [t for t in targets if any(c in t for c in "*?[{")]:
        found = found.union(held.where(F.col("path").rlike(paths.glob_pattern(glob))).select(F.lit(glob), "set_name", F.lit(3)).distinct())
    found = found.union(plain.join(held.select("path", "set_name").distinct(), F.col("target") == F.col("path")).select("target", "set_name", F.lit(4)))
    first = Window.partitionBy("target")
    best = found.withColumn("least", F.min("rule").over(first)).where("rule = least").select("target", "set_name", F.col("rule").cast("string").alias("rule")).distinct()
    none = parsed.join(best.select("target").distinct(), "target", "left_anti").select("target", F.coalesce("a.path", "target").alias("path"))
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    rule = F.when(F.coalesce("there", F.lit(False)), "no sets").otherwise("missing")
    return best.union(none.join(there, "path", "left").select("target", F.lit(None).cast("string"), rule))


def copy_pool(files: DataFrame, added: DataFrame, mode: str, *, all_refs: DataFrame | None = None, budget: int = 10_000) -> DataFrame:
    """path of the files that a copy may come from: none (off, same-commit), the commit's tree less what it adds, or the files
    of all references, for which the tree stands where they are over the budget."""
    tree = files.select("path").distinct().join(added.select("path"), "path", "left_anti")
    if mode in ("off", "same-commit"):
        return tree.limit(0)
    if mode == "any-file-in-commit" or all_refs is None:
        return tree
    wide = all_refs.select("path").distinct().join(added.select("path"), "path", "left_anti")
    size = all_refs.agg((F.countDistinct("path") <= budget).alias("__fits"))
    pick = lambda rows, yes: rows.crossJoin(F.broadcast(size)).where(F.col("__fits") == F.lit(yes)).select("path")
    return pick(wide, True).union(pick(tree, False))


def first_of_each(rows: DataFrame, value: str, place: str) -> DataFrame:
    """Each value once, at its first place."""
    return rows.groupBy(value).agg(F.min(place).alias(place))


def one_line(set_name: Column, path: Column, start: Column, end: Column, whole: Column) -> Column:
    return F.concat(F.lit("`"), set_name, F.lit("` `"), paths.address(path, start, end, whole), F.lit("`"))
