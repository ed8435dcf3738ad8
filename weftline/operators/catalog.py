"""Queries of a versioned catalog of anchor sets.

sets: name, version, message; anchors: set_name, version, anchor_id, path, start, end, whole. A version of a set is its
rows of the largest version up to the one asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, ranges
from ..plans.stages import stage


def at_version(rows: DataFrame, version: int | None = None, *, name: str = "set_name") -> DataFrame:
    """Each set's rows as of a version, or as they are now. The newest version comes from one aggregate by name."""
    seen = rows if version is None else rows.where(F.col("version") <= version)
    newest = seen.groupBy(name).agg(F.max("version").alias("version"))
    return seen.join(newest, [name, "version"], "left_semi")


def names(rows: DataFrame, *, name: str = "set_name") -> DataFrame:
    return rows.select(name).distinct().orderBy(name)


def history(sets: DataFrame, name: str, limit: int) -> DataFrame:
    """The newest versions that hold the set, whether they changed it or not."""
    return sets.where(F.col("name") == name).orderBy(F.desc("version")).limit(limit)


def listed(anchors: DataFrame) -> DataFrame:
    """The file index: path, set_name, start, end in order, 0 to 0 for whole files."""
    return anchors.select("path", "set_name", F.when(F.col("whole"), 0).otherwise(F.col("start")).cast("bigint").alias("start"), F.when(F.col("whole"), 0).otherwise(F.col("end")).cast("bigint").alias("end")).orderBy("path", "start", "end", "set_name")


def matches(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, set_name of each set with an anchor that a target (query_id, path, start, end) meets."""
    met = ranges.overlaps(F.col("start"), F.col("end"), F.col("whole"), F.col("q_start"), F.col("q_end"))
    asked = targets.select("query_id", "path", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    # a range is compared once with what a set has at its path, however many targets ask for it and anchors have it
    own = anchors.select("set_name", "path", "start", "end", "whole").distinct()
    found = own.join(asked.select("path", "q_start", "q_end").distinct(), "path").where(met).select("set_name", F.col("path").alias("p"), F.col("q_start").alias("s"), F.col("q_end").alias("e")).distinct()
    same = (F.col("path") == F.col("p")) & F.col("q_start").eqNullSafe(F.col("s")) & F.col("q_end").eqNullSafe(F.col("e"))
    return asked.join(found, same).select("query_id", "set_name").distinct()


#: A set's targets and its lines are dealt to parts of about so many each. Every part of the one meets every part of the other.
TARGETS_A_PART, LINES_A_PART = 4096, 4096


def point_queries(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, line of every anchor of every set that a target meets, `no sets` for a target without any.

    The rows are as many as a set's targets times its lines. They come last, from targets that meet a part's lines as one
    array, so none of them is shuffled and no task holds a set.
    """
    found = matches(anchors, targets).where("set_name IS NOT NULL")
    sizes = anchors.groupBy("set_name").agg(F.count("*").alias("n")).join(found.groupBy("set_name").agg(F.count("*").alias("q")), "set_name")
    sizes = sizes.select("set_name", F.ceil(F.col("q") / TARGETS_A_PART).alias("q_parts"), F.ceil(F.col("n") / LINES_A_PART).alias("n_parts"))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    # targets without a set have no parts, and are dealt to many
    asked = targets.select("query_id").join(found, "query_id", "left").join(sizes, "set_name", "left")
    asked = asked.select("query_id", "set_name", F.pmod(F.xxhash64("query_id"), F.coalesce("q_parts", F.lit(TARGETS_A_PART))).alias("q_part"), every(F.coalesce("n_parts", F.lit(1))).alias("n_part"))
    lines = anchors.select("set_name", porcelain().alias("line"), F.xxhash64(*anchors.columns).alias("h")).join(sizes, "set_name")
    lines = lines.groupBy("set_name", "q_parts", F.pmod("h", "n_parts").alias("n_part")).agg(F.collect_list("line").alias("lines"))
    lines = lines.select("set_name", "n_part", "lines", every(F.col("q_parts")).alias("q_part"))
    by, spark = ["set_name", "q_part", "n_part"], targets.sparkSession
    # Spark keeps a number of tasks that is given; by the bytes that go in, which say little of the rows that come out, it would take few
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # a hash may leave a part without lines
    met = asked.repartition(tasks, *by).join(lines.repartition(tasks, *by), by, "left").where("set_name IS NULL OR lines IS NOT NULL")
    return met.select("query_id", F.explode(F.coalesce("lines", F.array(F.lit("no sets")))).alias("line"))


def porcelain() -> Column:
    """name, path and range of an anchor separated by tabs, 0-0 for a whole file."""
    span = F.when(F.col("whole"), "0-0").otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    return F.concat_ws("\t", "set_name", "path", span)


def search(sets: DataFrame, anchors: DataFrame, pattern: str) -> DataFrame:
    """Names of sets whose name, a line of whose message, or a path or address of whose anchors matches, in any case."""
    any_case = "(?i)" + pattern
    own = sets.where(F.col("name").rlike(any_case) | F.exists(F.split("message", "\n"), lambda x: x.rlike(any_case))).select("name")
    shown = F.when(F.col("whole"), F.concat("path", F.lit("  (whole)"))).otherwise(paths.address(F.col("path"), F.col("start"), F.col("end"), F.col("whole")))
    return own.union(anchors.where(F.col("path").rlike(any_case) | shown.rlike(any_case)).select("set_name")).distinct()


def by_glob(anchors: DataFrame, glob: str) -> DataFrame:
    return anchors.where(F.col("path").rlike(paths.glob_pattern(glob)))


def resolve_targets(anchors: DataFrame, staged: DataFrame, targets: DataFrame) -> DataFrame:
    """target, set_name by the first rule that finds any: a range, a set's name, a staged set's name, a path.

    targets: target. An address with a range is only looked up as one.
    """
    parsed = targets.withColumn("a", paths.parsed_address(F.col("target")))
    ranged = parsed.where("NOT a.whole").select(F.col("target").alias("query_id"), F.col("a.path").alias("path"), F.col("a.start").alias("start"), F.col("a.end").alias("end"))
    plain = parsed.where("a.whole").select("target")
    every = matches(anchors, ranged).select(F.col("query_id").alias("target"), "set_name", F.lit(0).alias("rule"))
    for rule, rows in ((1, anchors.select("set_name").distinct()), (2, staged.select("set_name").distinct())):
        every = every.union(plain.join(rows, F.col("target") == F.col("set_name")).select("target", "set_name", F.lit(rule)))
    every = every.union(plain.join(anchors.select("path", "set_name").distinct(), F.col("target") == F.col("path")).select("target", "set_name", F.lit(3)))
    best = F.min("rule").over(Window.partitionBy("target"))
    return every.withColumn("best", best).where("rule = best").select("target", "set_name").distinct()


def page(rows: DataFrame, offset: int, limit: int, *, name: str = "set_name") -> DataFrame:
    return rows.orderBy(name).offset(offset).limit(limit)


def overlapping_sets(anchors: DataFrame) -> DataFrame:
    """a, b: pairs of sets with the same list of paths and extents that meet."""
    # an anchor carries a digest of the list, which grows with its set; only sets whose list another has are compared
    shape = anchors.groupBy("set_name").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("path"))), 256).alias("paths"))
    shared = shape.groupBy("paths").agg(F.count("*").alias("n")).where("n > 1").select("paths")
    own = anchors.join(shape.join(shared, "paths", "left_semi"), "set_name").select("set_name", "paths", "path", "start", "end", "whole")
    other = own.select(F.col("set_name").alias("b"), "paths", "path", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("whole").alias("w2"))
    met = own.join(other, ["paths", "path"]).where((F.col("set_name") < F.col("b")) & ranges.extents_meet(F.col("start"), F.col("end"), F.col("whole"), F.col("s2"), F.col("e2"), F.col("w2")))
    return met.select(F.col("set_name").alias("a"), "b").distinct()


def result_order(anchors: DataFrame) -> DataFrame:
    """set_name, place: by sorted paths (a shorter list first), sets that overlap another with the same paths first, then name."""
    met = overlapping_sets(anchors)
    both = met.select("a").union(met.select("b")).distinct().select(F.col("a").alias("set_name"), F.lit(0).alias("alone"))
    shape = anchors.groupBy("set_name").agg(F.sort_array(F.collect_list("path")).alias("paths")).join(both, "set_name", "left").fillna(1, ["alone"])
    return shape.withColumn("place", F.row_number().over(Window.orderBy("paths", "alone", "set_name"))).select("set_name", "place")


def name_collisions(sets: DataFrame) -> DataFrame:
    """outer, inner: a set's name that is a folder of another's; found by the prefixes of names, not by comparing pairs."""
    parts = sets.select("name", F.split("name", "/").alias("p"))
    prefixes = parts.select(F.col("name").alias("inner"), F.explode(F.expr("transform(sequence(1, greatest(size(p) - 1, 1)), n -> array_join(slice(p, 1, n), '/'))")).alias("outer"))
    return prefixes.where("inner <> outer").join(sets.select(F.col("name").alias("outer")), "outer").select("outer", "inner").distinct()


def dangling(references: DataFrame, anchors: DataFrame) -> DataFrame:
    """References (anchor_id) to anchors that no set holds."""
    return references.join(anchors.select("anchor_id"), "anchor_id", "left_anti")


def with_overlay(baseline: DataFrame, affected: DataFrame, overlay: DataFrame, *, name: str = "set_name") -> DataFrame:
    """The baseline with affected sets replaced by their overlay rows, or dropped where it has none; new sets are added."""
    return baseline.join(affected.select(name).distinct(), name, "left_anti").unionByName(overlay)


def affected_sets(anchors: DataFrame, dirty: DataFrame) -> DataFrame:
    return anchors.join(dirty.select("path").distinct(), "path", "left_semi").select("set_name").distinct()


def ancestors(parents: DataFrame, start: int | str) -> DataFrame:
    """commit_id of every ancestor of start, itself included; parents: commit_id, parent. An unknown start has none.

    Steps are doubled: round k knows the ancestors fewer than 2**k parents away and the pairs that many apart, so rounds
    follow the logarithm of the depth, and each commit is kept once however many ways lead to it. When a round finds no
    commit, there is none further away.
    """
    kind = parents.schema["commit_id"].dataType
    found = stage(parents.where(F.col("commit_id") == F.lit(start)).select("commit_id").distinct())
    steps = parents.where("parent IS NOT NULL").select("commit_id", F.col("parent").cast(kind).alias("parent")).distinct()
    known = found.count()
    while known:
        steps = stage(steps)
        found = stage(found.union(found.join(steps, "commit_id").select(F.col("parent").alias("commit_id"))).distinct())
        if (now := found.count()) == known:
            break
        known = now
        further = steps.select(F.col("commit_id").alias("parent"), F.col("parent").alias("next"))
        steps = steps.join(further, "parent").select("commit_id", F.col("next").alias("parent")).distinct()
    return found
