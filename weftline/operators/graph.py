"""Ancestry of many commits at once, by chains of first parents.

parents: commit_id, place (0 for the first parent), parent; a root has one row with a null parent. Each commit lies on one
chain at one position; a chain goes on from a commit to its first parent unless a smaller child of that parent does. What a
commit reaches is then one position for each chain, all below it included, so questions are answered by walking the edges
between chains: rounds follow how deep branches nest, not how long the history is, and no closure is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import held


def longest_below(first: DataFrame) -> DataFrame:
    """commit_id, tip: the greatest depth among a commit and all that descend from it by first parents.

    first: commit_id, parent, one row a commit, null for a root. A round doubles the steps to the ancestor that a commit
    tells its depth and what it has been told.
    """
    at = held(first.select("commit_id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while at.where("up IS NOT NULL").limit(1).count():
        further = at.select(F.col("commit_id").alias("up"), F.col("up").alias("up_"), F.col("depth").alias("depth_"))
        at = held(at.join(further, "up", "left").select("commit_id", F.col("up_").alias("up"), (F.col("depth") + F.coalesce("depth_", F.lit(0))).alias("depth")))
    at = held(first.join(at.select("commit_id", "depth"), "commit_id").select("commit_id", F.col("parent").alias("up"), F.col("depth").alias("tip")))
    while at.where("up IS NOT NULL").limit(1).count():
        told = at.where("up IS NOT NULL").groupBy(F.col("up").alias("commit_id")).agg(F.max("tip").alias("told"))
        further = at.select(F.col("commit_id").alias("up"), F.col("up").alias("up_"))
        at = held(at.join(further, "up", "left").join(told, "commit_id", "left").select("commit_id", F.col("up_").alias("up"), F.greatest("tip", F.coalesce("told", "tip")).alias("tip")))
    return at.select("commit_id", "tip")


def chains(parents: DataFrame) -> DataFrame:
    """commit_id, chain (its lowest commit), pos (0 there): by list ranking, each round doubling the steps to the end.

    A commit's chain goes up to the child with the longest line of first parents above, of equals the least, so a main line
    is one chain however often it was branched from.
    """
    first = held(parents.where("place = 0").select("commit_id", "parent"))
    chosen = first.where("parent IS NOT NULL").join(longest_below(first), "commit_id").groupBy(F.col("parent").alias("next")).agg(F.min_by("commit_id", F.struct(-F.col("tip"), "commit_id")).alias("commit_id"))
    at = held(first.select("commit_id").join(chosen, "commit_id", "left").select("commit_id", F.coalesce("next", "commit_id").alias("end"), F.col("next").isNotNull().cast("long").alias("pos")))
    while True:
        further = at.select(F.col("commit_id").alias("end"), F.col("end").alias("end_"), F.col("pos").alias("pos_"))
        new = held(at.join(further, "end").select("commit_id", F.col("end_").alias("end"), (F.col("pos") + F.col("pos_")).alias("pos"), (F.col("end") != F.col("end_")).alias("went")))
        at = new.select("commit_id", "end", "pos")
        if not new.where("went").limit(1).count():
            return at.select("commit_id", F.col("end").alias("chain"), "pos")


def crossings(parents: DataFrame, chained: DataFrame) -> DataFrame:
    """chain, pos, to_chain, to_pos: edges that leave their chain."""
    up = chained.select(F.col("commit_id").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    met = parents.where("parent IS NOT NULL").select("commit_id", "parent").join(chained, "commit_id").join(up, "parent")
    return met.where("chain <> to_chain").select("chain", "pos", "to_chain", "to_pos").distinct()


class Ancestry:
    """Labels of a history, each made once: chains, the edges between them, and where each commit meets the longest chain.

    Of the longest chain, the main line, a commit tells the highest position it reaches (down) and the lowest that reaches it
    (up). A path that touches the main line is then a comparison of two numbers. What is left are paths beside it; they are
    walked, and end where branches are merged.
    """

    def __init__(self, parents: DataFrame):
        labels = held(chains(parents))
        longest = labels.groupBy("chain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chain").limit(1).select("chain", F.lit(True).alias("main"))
        marked = lambda df, of, to: df.join(F.broadcast(longest.withColumnsRenamed({"chain": of, "main": to})), of, "left").fillna(False, [to])
        own = held(marked(labels, "chain", "main"))
        crossed = held(marked(marked(crossings(parents, labels), "chain", "from_main"), "to_chain", "to_main"))
        beside = own.where("NOT main").drop("main")
        self.crossed = crossed.where("NOT from_main AND NOT to_main").select("chain", "pos", "to_chain", "to_pos")
        self.beside = held(self._reach(beside))

        into = crossed.where("NOT from_main AND to_main").groupBy("chain", "pos").agg(F.max("to_pos").alias("into"))
        below = Window.partitionBy("chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        lowest = beside.join(into, ["chain", "pos"], "left").select("chain", "pos", F.max("into").over(below).alias("down"))
        down = self.beside.join(lowest, ["chain", "pos"]).groupBy("commit_id").agg(F.max("down").alias("down"))
        merged = crossed.where("from_main AND NOT to_main").groupBy(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos")).agg(F.min("pos").alias("by"))
        merged = beside.join(merged, ["chain", "pos"]).select("commit_id", "by")
        told = self.beside.join(merged, "commit_id").groupBy("chain", "pos").agg(F.min("by").alias("by"))
        above = Window.partitionBy("chain").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
        up = beside.join(told, ["chain", "pos"], "left").select("commit_id", F.min("by").over(above).alias("up"))
        rest = beside.join(down, "commit_id", "left").join(up, "commit_id", "left")
        on = own.where("main").select("commit_id", "chain", "pos", F.col("pos").alias("down"), F.col("pos").alias("up"), "main")
        #: commit_id, chain, pos, down (-1 for none), up (null for none), main
        self.labels = held(on.union(rest.select("commit_id", "chain", "pos", F.coalesce("down", F.lit(-1)).alias("down"), "up", F.lit(False))))

    def _reach(self, starts: DataFrame) -> DataFrame:
        """commit_id, chain, pos: the highest commit of each chain that a start (commit_id, chain, pos) reaches beside the main
        line, itself included.

        A round takes the edges between the positions known before and now, so that each edge is walked once for a start.
        """
        known = held(starts.select("commit_id", "chain", "pos", F.lit(-1).cast("long").alias("was")))
        edges = self.crossed.select("chain", F.col("pos").alias("at"), "to_chain", "to_pos")
        while True:
            met = known.where("pos > was").join(edges, "chain").where("at > was AND at <= pos")
            found = met.select("commit_id", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.lit(-1).cast("long").alias("was"))
            done = known.select("commit_id", "chain", "pos", F.col("pos").alias("was"))
            known = held(done.union(found).groupBy("commit_id", "chain").agg(F.max("pos").alias("pos"), F.max("was").alias("was")))
            if not known.where("pos > was").limit(1).count():
                return known.select("commit_id", "chain", "pos")

    def _named(self, name: str) -> DataFrame:
        return self.labels.select(F.col("commit_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("chain", "pos", "down", "up")])

    def _beside(self, name: str, pos: str) -> DataFrame:
        return self.beside.select(F.col("commit_id").alias(name), "chain", F.col("pos").alias(pos))

    def is_ancestor(self, pairs: DataFrame) -> DataFrame:
        """pairs (ancestor, commit_id) with is_ancestor, true for equal ones too and null if either is unknown."""
        asked = pairs.join(self._named("ancestor"), "ancestor", "left").join(self.labels.select("commit_id", F.col("down").alias("c_down")), "commit_id", "left")
        met = asked.join(self._beside("commit_id", "r_pos").withColumnRenamed("chain", "ancestor_chain"), ["commit_id", "ancestor_chain"], "left")
        by_main = F.coalesce(F.col("c_down") >= F.col("ancestor_up"), F.lit(False))
        told = F.when(F.col("ancestor_pos").isNotNull() & F.col("c_down").isNotNull(), by_main | F.coalesce(F.col("r_pos") >= F.col("ancestor_pos"), F.lit(False)))
        return met.select(*pairs.columns, told.alias("is_ancestor"))

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with base: every best common ancestor, one from which no other common one descends; null if there's none.

        Common ancestors are all below one position of each chain. The main line's highest is one; what that one doesn't reach
        is beside the main line for the commit that reaches less of it. The highest of a chain is best unless a child of it on
        another chain is common too, which the edges into it tell.
        """
        downs = lambda of: self.labels.select(F.col("commit_id").alias(of), F.col("down").alias(f"down_{of}"))
        asked = pairs.select("a", "b").distinct().join(downs("a"), "a").join(downs("b"), "b")
        first = F.col("down_a") <= F.col("down_b")
        asked = held(asked.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), F.least("down_a", "down_b").alias("low"), F.greatest("down_a", "down_b").alias("high")))
        ours = asked.join(self._beside("x", "pos_x"), "x")
        # the highest of the chain that y reaches by the main line: of those merged by then the last
        places = self.labels.where("NOT main AND up IS NOT NULL").select("chain", F.col("up").alias("at"), F.lit(0).alias("kind"), "pos")
        questions = ours.select("chain", "high").distinct()
        upto = Window.partitionBy("chain").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        by_main = places.union(questions.select("chain", "high", F.lit(1), F.lit(None).cast("long"))).withColumn("by_main", F.max("pos").over(upto)).where("kind = 1").select("chain", F.col("at").alias("high"), "by_main")
        both = ours.join(by_main, ["chain", "high"], "left").join(self._beside("y", "pos_y"), ["y", "chain"], "left")
        both = both.withColumn("pos", F.least("pos_x", F.greatest(F.coalesce("by_main", F.lit(-1)), F.coalesce("pos_y", F.lit(-1)))))
        tops = both.join(self.labels.where("NOT main").select("chain", "pos", "up", "down", "commit_id"), ["chain", "pos"]).where("up IS NULL OR up > low")
        tops = held(tops.select("a", "b", "chain", "pos", "low", "down", "commit_id"))
        into = self.crossed.select(F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), F.col("chain").alias("of"), F.col("pos").alias("at"))
        children = tops.join(into, ["chain", "pos"]).join(tops.select("a", "b", F.col("chain").alias("of"), F.col("pos").alias("top")), ["a", "b", "of"]).where("at <= top")
        best = tops.join(children.select("a", "b", "chain").distinct(), ["a", "b", "chain"], "left_anti").select("a", "b", F.col("commit_id").alias("base"))
        on_main = asked.where("low >= 0").join(tops.where("down >= low").select("a", "b").distinct(), ["a", "b"], "left_anti")
        on_main = on_main.join(self.labels.where("main").select(F.col("pos").alias("low"), F.col("commit_id").alias("base")), "low").select("a", "b", "base")
        return pairs.join(best.union(on_main), ["a", "b"], "left")

    def side_commits(self, merges: DataFrame) -> DataFrame:
        """commit_id, side: for merges (commit_id, first, second) the commits that only the second parent reaches."""
        downs = lambda of: self.labels.select(F.col("commit_id").alias(of), F.col("down").alias(f"down_{of}"))
        asked = held(merges.join(downs("first"), "first").join(downs("second"), "second"))
        # what the main line brought in between the two: its own commits and those merged there
        each = asked.where("down_second > down_first").select("commit_id", "first", F.explode(F.sequence(F.col("down_first") + 1, "down_second")).alias("up"))
        by_main = each.join(self.labels.select(F.col("commit_id").alias("side"), "chain", "pos", "up"), "up").select("commit_id", "first", "side", "chain", "pos")
        bottom = self._beside("first", "bottom")
        spans = asked.join(self._beside("second", "top"), "second").join(bottom, ["first", "chain"], "left").withColumn("bottom", F.coalesce("bottom", F.lit(-1))).where("top > bottom")
        own = spans.select("commit_id", "first", "down_first", "chain", F.explode(F.sequence(F.col("bottom") + 1, "top")).alias("pos"))
        own = own.join(self.labels.select(F.col("commit_id").alias("side"), "chain", "pos", "up"), ["chain", "pos"]).where("up IS NULL OR up > down_first")
        known = by_main.join(bottom, ["first", "chain"], "left").where("bottom IS NULL OR pos > bottom")
        return known.select("commit_id", "side").union(own.select("commit_id", "side")).distinct()


def set_since(anchors: DataFrame, ancestry: Ancestry, since: int | str) -> DataFrame:
    """Anchors (with commit_id) set at `since` or a commit that descends from it; those of unknown commits stay, and all if
    `since` is unknown."""
    kind = ancestry.labels.schema["commit_id"].dataType
    pairs = anchors.select("commit_id").distinct().withColumn("ancestor", F.lit(since).cast(kind))
    told = ancestry.is_ancestor(pairs).where("is_ancestor = false").select("commit_id")
    return anchors.join(told, "commit_id", "left_anti")


def merges_of(parents: DataFrame) -> DataFrame:
    """commit_id, first, second: a row for each further parent of a merge."""
    first = parents.where("place = 0").select("commit_id", F.col("parent").alias("first"))
    return parents.where("place > 0").select("commit_id", F.col("parent").alias("second")).join(first, "commit_id").select("commit_id", "first", "second")


def branch_files(parents: DataFrame, commit_files: DataFrame, ancestry: Ancestry) -> DataFrame:
    """commit_id, file: the files that the branches a merge brought in have changed."""
    side = ancestry.side_commits(merges_of(parents))
    return side.join(commit_files.select(F.col("commit_id").alias("side"), "file"), "side").select("commit_id", "file").distinct()
