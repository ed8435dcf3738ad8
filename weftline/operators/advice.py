"""What a session is told: sets that its reads and edits touch, and suggestions that are new to it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, ranges
from ..plans.stages import held


def touched_sets(touches: DataFrame, anchors: DataFrame) -> DataFrame:
    """sid, set_name, touch_no, anchor_id: the first touch that meets each set; added and deleted files don't count.

    touches: sid, line_no, path, kind, start, end; anchors: set_name, anchor_no, anchor_id, path, start, end, whole.
    """
    own = touches.where("kind NOT IN ('added', 'deleted')").select("sid", "line_no", "path", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    # of a session's equal touches the first counts; what a range meets is found once, in whatever sessions it is touched
    place = ["path", "t_start", "t_end"]
    once = held(own.groupBy("sid", *place).agg(F.min("line_no").alias("touch_no")))
    places = once.select(*place).distinct()
    met = places.join(anchors, "path").where(ranges.edit_meets(F.col("start"), F.col("end"), F.col("whole"), F.col("t_start"), F.col("t_end")))
    of = held(met.groupBy(*place, "set_name").agg(F.min(F.struct("anchor_no", "anchor_id")).alias("a")))
    sets = of.select(F.col("path").alias("o_path"), F.col("t_start").alias("o_start"), F.col("t_end").alias("o_end"), "set_name", "a")
    same = (F.col("path") == F.col("o_path")) & F.col("t_start").eqNullSafe(F.col("o_start")) & F.col("t_end").eqNullSafe(F.col("o_end"))
    first = once.join(sets, same).groupBy("sid", "set_name").agg(F.min(F.struct("touch_no", "a")).alias("m"))
    return first.select("sid", "set_name", F.col("m.touch_no").alias("touch_no"), F.col("m.a.anchor_id").alias("anchor_id"))


def read_sets(reads: DataFrame, anchors: DataFrame, committed: DataFrame, seen: DataFrame) -> DataFrame:
    """sid, set_name of sets committed in the session (sid, set_name) that a read meets and that weren't shown yet (seen)."""
    r = reads.select("sid", "path", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = r.join(anchors, "path").where(ranges.read_meets(F.col("start"), F.col("end"), F.col("whole"), F.col("r_start"), F.col("r_end")))
    return met.select("sid", "set_name").distinct().join(committed, ["sid", "set_name"], "left_semi").join(seen, ["sid", "set_name"], "left_anti")


def changed_since(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """name of sets (name, oid) that are new or differ from the baseline."""
    return now.join(baseline.select("name", F.col("oid").alias("was")), "name", "left").where(~F.col("oid").eqNullSafe(F.col("was"))).select("name")


def new_touches(pending: DataFrame, known: DataFrame) -> DataFrame:
    """Touches by path, kind and range, each once, that aren't known."""
    keys = ["path", "kind", "start", "end"]
    once, old = pending.dropDuplicates(keys), known.select(*keys).distinct()
    return once.join(old, [once[k].eqNullSafe(old[k]) for k in keys], "left_anti")


def touched_paths(touches: DataFrame) -> DataFrame:
    """sid, path, first: files in order of their first touch; changes of mode don't count."""
    return touches.where("kind <> 'mode'").groupBy("sid", "path").agg(F.min("line_no").alias("first"))


def reference_tokens(path: Column) -> Column:
    """What a text that refers to a file would hold, three tokens at most: its name, the name without ending, its folders from
    the innermost; generic names, and all but the whole name under four characters, say nothing."""
    base = paths.basename(path)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    own = F.array(F.when(~base.isin(*paths.GENERIC_NAMES), base), F.when((F.length(stem) >= 4) & ~stem.isin(*paths.GENERIC_NAMES), stem))
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))
    telling = F.filter(folders, lambda f: (F.length(f) >= 4) & ~f.isin(*paths.GENERIC_FOLDERS))
    return F.slice(F.array_distinct(F.concat(F.array_compact(own), telling)), 1, 3)


def structural_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """pairs (a, b) with structural: whether either file's text (path, text) holds a token of the other's path.

    Files that are both at the top are never structural.
    """
    side = lambda x: files.select(F.col("path").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")

    def holds(text: str, path: str) -> Column:
        return F.exists(reference_tokens(F.col(path)), lambda t: F.coalesce(F.contains(F.col(text), t), F.lit(False)))

    return both.withColumn("structural", (F.contains(F.col("a"), F.lit("/")) | F.contains(F.col("b"), F.lit("/"))) & (holds("text_a", "b") | holds("text_b", "a"))).drop("text_a", "text_b")


def self_referring(members: DataFrame, files: DataFrame) -> DataFrame:
    """key of suggestions (key, path) one of whose files names another's path."""
    text = members.join(files, "path").select("key", F.col("path").alias("p"), "text")
    return text.join(members.select("key", F.col("path").alias("other")), "key").where((F.col("p") != F.col("other")) & F.contains(F.col("text"), F.col("other"))).select("key").distinct()


def surfaced(shown: DataFrame, seen: DataFrame, deleted: DataFrame, files: DataFrame) -> DataFrame:
    """Suggestions (sid, key, band, participants) worth telling: high, new to the session, of files that exist and don't name each other."""
    high = shown.where(F.col("band").isin("high", "high+")).dropDuplicates(["sid", "key"])
    members = high.select("sid", "key", F.explode("participants").alias("p")).select("sid", "key", F.col("p.path").alias("path"))
    gone = members.join(deleted.select("path").distinct(), "path", "left_semi").select("sid", "key")
    own = members.withColumn("key", F.concat_ws("\0", F.col("sid").cast("string"), "key"))
    cross = self_referring(own.select("key", "path"), files)
    out = high.join(seen.select("sid", "key"), ["sid", "key"], "left_anti").join(gone.distinct(), ["sid", "key"], "left_anti")
    return out.withColumn("__k", F.concat_ws("\0", F.col("sid").cast("string"), "key")).join(cross.select(F.col("key").alias("__k")), "__k", "left_anti").drop("__k")


def fingerprint(*fields: Column) -> Column:
    """A suggestion's identity: the hash of its fields, set apart by NUL."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def since(anchors: DataFrame, ancestors_of: DataFrame, commit: str) -> DataFrame:
    """Anchors whose commit has `commit` as itself or an ancestor (commit_id, ancestor); those of unknown commits stay."""
    known = ancestors_of.select("commit_id").distinct().withColumn("known", F.lit(True))
    later = ancestors_of.where(F.col("ancestor") == commit).select("commit_id").distinct().withColumn("later", F.lit(True))
    out = anchors.join(known, "commit_id", "left").join(later, "commit_id", "left")
    return out.where("known IS NULL OR later").drop("known", "later")


def merged_branches(merges: DataFrame, ancestry: DataFrame, changes: DataFrame) -> DataFrame:
    """merge, path: files changed on the side that a merge (commit_id, first, second) brought in.

    ancestry: commit_id, ancestor (itself included). The side is the ancestors of the second parent less the first's.
    """
    side = merges.join(ancestry.select(F.col("commit_id").alias("second"), "ancestor"), "second").select(F.col("commit_id").alias("merge"), "first", "ancestor")
    main = ancestry.select(F.col("commit_id").alias("first"), "ancestor")
    own = side.join(main, ["first", "ancestor"], "left_anti")
    return own.join(changes.select(F.col("commit_id").alias("ancestor"), "path"), "ancestor").select("merge", "path").distinct()


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change, from_path of two trees (path, blob, mode); a deleted and an added file with one blob are a rename.

    Of several files with a blob the first added pairs with the first deleted, by path.
    """
    b, a = (t.select("path", F.struct("blob", "mode").alias(n)) for t, n in ((before, "b"), (after, "a")))
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a.blob") != F.col("b.blob"), "modified").when(F.col("a.mode") != F.col("b.mode"), "mode")
    rows = both.select("path", change.alias("change"), F.coalesce("b.blob", "a.blob").alias("blob")).where("change IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("change", "blob").orderBy("path"))
    part = lambda k, n: rows.where(F.col("change") == k).select("blob", F.col("path").alias(n), place.alias("i"))
    moves = part("added", "path").join(part("deleted", "from_path"), ["blob", "i"]).select("path", F.lit("renamed").alias("change"), "from_path")
    used = moves.select("path").union(moves.select("from_path"))
    return rows.join(used, "path", "left_anti").select("path", "change", F.lit(None).cast("string").alias("from_path")).unionByName(moves)


#: Pairs that one pass of capped_clusters decides in order.
IN_ORDER = 200_000


def _decided(pairs: DataFrame, most: int) -> DataFrame:
    """old, new: clusters and the lesser names they take from one pass over pairs (a, b, order, n_a, n_b) in order."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[str, str] = {}
        size: dict[str, int] = {}

        def top(x: str) -> str:
            while (up := above.get(x, x)) != x:
                x = up
            return x

        for batch in batches:
            for a, b, n_a, n_b in zip(*(batch[c].to_pylist() for c in ("a", "b", "n_a", "n_b")), strict=True):
                low, high = sorted((top(a), top(b)))
                n = size.get(low, n_a if low == a else n_b) + size.get(high, n_b if high == b else n_a)
                if low != high and n <= most:
                    above[high], size[low] = low, n
        old = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(old, pa.string()), pa.array([top(x) for x in old], pa.string())], names=["old", "new"])

    own = pairs.repartition(1).sortWithinPartitions("order").select("a", "b", "n_a", "n_b")
    return own.mapInArrow(merged, "old string, new string")


def _first_part(pairs: DataFrame, n: int) -> Column:
    """Whether a pair's order is within about the first sixteenth of n pairs, or half of IN_ORDER; the bound is one row, from every kth pair by hash."""
    every = max(1, n // 20_000)
    some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(every)) == 0).orderBy("order").limit(max(1, max(n // 16, IN_ORDER // 2) // every))
    bound = some.agg(F.max("order").alias("o")).first().o
    return F.col("order") <= F.struct(F.lit(bound.rank).cast("long").alias("rank"), F.lit(bound.a).alias("a"), F.lit(bound.b).alias("b"))


def capped_clusters(pairs: DataFrame, most: int = 8) -> DataFrame:
    """node, cluster (its least node) from ranked pairs (rank, a, b): two clusters merge if together they have at most `most`
    nodes. Nodes left alone are in none.

    The result is that of one pass in order of rank, then a and b. Clusters only grow, so a pair that would be too large leaves
    for good, and of pairs between the same clusters only the first counts. Pairs are cut into parts by their order, earlier
    ones the smaller, until a part has IN_ORDER pairs at most and one task goes through it; what follows is put in terms of
    the clusters by then before it is cut again, and most of it has left by that time.
    """
    named = pairs.select(F.struct(F.col("rank").cast("long").alias("rank"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).alias("order"))
    once = lambda df: df.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("order").alias("order"))
    edges = held(once(named.select("order", "order.a", "order.b").where("a <> b")))
    nodes = held(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("cluster")))
    todo = [edges]
    while todo:
        now = nodes.join(nodes.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
        side = lambda of, now=now: now.select(F.col("node").alias(of), F.col("cluster").alias(f"to_{of}"), F.col("n").alias(f"n_{of}"))
        met = todo.pop().join(side("a"), "a").join(side("b"), "b").where((F.col("to_a") != F.col("to_b")) & (F.col("n_a") + F.col("n_b") <= most))
        least = F.col("to_a") < F.col("to_b")
        pair = [F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")]
        part = held(met.groupBy(*pair, F.when(least, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(least, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).agg(F.min("order").alias("order")))
        n = part.count()
        if n > IN_ORDER:
            first = _first_part(part, n)
            todo += [part.where(~first).select("a", "b", "order"), part.where(first).select("a", "b", "order")]
        elif n:
            new = _decided(part, most)
            nodes = held(nodes.join(new.select(F.col("old").alias("cluster"), "new"), "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster")))
    shared = nodes.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return nodes.join(shared.select("cluster"), "cluster", "left_semi").select("node", "cluster")
