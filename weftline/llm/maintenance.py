"""Aggregates kept up to date under batches of signed changes: counts, sums, distinct values and order statistics.

Changes are rows (groups ..., batch, value, sign): sign is 1 for a row that enters with the batch and -1 for one that
leaves. Distinct values follow from the multiplicity of each value over the batches. Order statistics come from a
binary search over the values that runs for the ranks of all groups and batches at once: each round halves every
interval by one join with signed counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stored

AGGREGATES = ("n_rows", "n_distinct", "total", "least", "greatest", "median")

#: Rounds of the search between two tables of intermediate bounds.
ROUNDS = 4


def _left_counts(net: DataFrame, lowest: int, bits: int) -> DataFrame:
    """level, g, prefix, steps: signed counts by batch of the lower half of each dyadic interval of values.

    The interval `prefix` at a level holds the values from lowest + (prefix << level + 1) on, 1 << level + 1 of them. An
    interval has a count for each batch at most, whatever the number of rows, and a value is in one interval a level.
    """
    spread = net.where("value is not null").select("g", "batch", "d", (F.col("value") - lowest).alias("u"), F.explode(F.array(*map(F.lit, range(bits)))).alias("level"))
    lower = spread.where("shiftright(u, level) & 1 = 0").select("level", "g", F.expr("shiftright(u, level + 1)").alias("prefix"), "batch", "d")
    counts = lower.groupBy("level", "g", "prefix", "batch").agg(F.sum("d").alias("d")).where("d <> 0")
    return counts.groupBy("level", "g", "prefix").agg(F.collect_list(F.struct("batch", "d")).alias("steps")).sortWithinPartitions("level", "g", "prefix")


def _search(own: Scratch, net: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (g, batch, kind, k) -> g, batch, kind, found: the k-th value, from 1, of the group after the batch."""
    lowest, highest = net.agg(F.min("value"), F.max("value")).first()
    if lowest is None:
        return asked.select("g", "batch", "kind", F.lit(None).cast("long").alias("found"))
    bits = (highest - lowest).bit_length()
    counts = own.keep(_left_counts(net, lowest, bits)) if bits else None
    bound = asked.withColumn("low", F.lit(0).cast("long"))
    for level in reversed(range(bits)):
        half = counts.where(F.col("level") == level).select("g", "prefix", "steps")
        met = bound.withColumn("prefix", F.shiftright("low", level + 1)).join(half, ["g", "prefix"], "left")
        now = F.filter("steps", lambda s: s["batch"] <= F.col("batch"))
        below = F.coalesce(F.aggregate(now, F.lit(0).cast("long"), lambda sum_, s: sum_ + s["d"]), F.lit(0))
        met = met.withColumn("below", below)
        up = F.col("k") > F.col("below")
        bound = met.select("g", "batch", "kind", F.when(up, F.col("k") - F.col("below")).otherwise(F.col("k")).alias("k"), F.when(up, F.col("low") + (1 << level)).otherwise(F.col("low")).alias("low"))
        if level % ROUNDS == 0 and level:
            bound = own.keep(bound)
    return bound.select("g", "batch", "kind", (F.col("low") + lowest).alias("found"))


def maintain(changes: DataFrame, *groups: str) -> DataFrame:
    """batch, the groups, and old_ and new_ values of AGGREGATES for each batch and group where one of them changes.

    changes: the groups, batch, value and sign. Null groups are groups of their own and null values count in n_rows
    alone; the six are 0, 0, 0 and null three times before the first batch and without rows. Rows of one group, batch
    and value are summed before anything is dealt out, so repeated rows cost one row, and a batch whose changes cancel
    out isn't returned. Values must be integers whose span is under 2^63. No changes give no rows; other columns of
    `changes` are ignored.
    """
    with Scratch(changes.sparkSession) as own:
        keyed = changes.select(F.struct(*(F.col(c) for c in groups)).alias("g"), F.col("batch").cast("int").alias("batch"), F.col("value").cast("long").alias("value"), F.col("sign").cast("long").alias("d"))
        net = own.keep(keyed.where("batch is not null").groupBy("g", "value", "batch").agg(F.sum("d").alias("d")).where("d <> 0"))

        copies = F.sum("d").over(Window.partitionBy("g", "value").orderBy("batch"))
        met = (F.col("copies") > 0).cast("long") - (F.col("copies") - F.col("d") > 0).cast("long")
        real = F.col("value").isNotNull()
        moved = (
            net.withColumn("copies", copies)
            .groupBy("g", "batch")
            .agg(F.sum("d").alias("n_rows"), F.sum(F.when(real, met).otherwise(0)).alias("n_distinct"), F.sum(F.when(real, F.col("d") * F.col("value")).otherwise(0)).alias("total"), F.sum(F.when(real, F.col("d")).otherwise(0)).alias("n"))
        )
        # a group has one row for each batch here
        so_far = Window.partitionBy("g").orderBy("batch")
        states = own.keep(moved.select("g", "batch", *(F.sum(c).over(so_far).alias(c) for c in ("n_rows", "n_distinct", "total", "n"))))

        ranks = {"least": F.lit(1).cast("long"), "greatest": F.col("n"), "median": F.expr("(n + 1) div 2")}
        asked = states.where("n > 0").select("g", "batch", F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), k.alias("k")) for kind, k in ranks.items()))))
        found = _search(own, net, asked).groupBy("g", "batch").agg(*(F.max(F.when(F.col("kind") == kind, F.col("found"))).alias(kind) for kind in ranks))
        whole = states.join(found, ["g", "batch"], "left")

        def before(name: str) -> Column:
            old = F.lag(name).over(Window.partitionBy("g").orderBy("batch"))
            return old if name in ranks else F.coalesce(old, F.lit(0).cast("long"))

        both = whole.select("g", "batch", *(before(a).alias(f"old_{a}") for a in AGGREGATES), *(F.col(a).alias(f"new_{a}") for a in AGGREGATES))
        changed = ~F.lit(True)
        for a in AGGREGATES:
            changed = changed | ~F.col(f"old_{a}").eqNullSafe(F.col(f"new_{a}"))
        return stored(both.where(changed).select("batch", "g.*", *(f"{when}_{a}" for a in AGGREGATES for when in ("old", "new"))))


#: Batches of the report, and the number of batches within which a row leaves.
BATCHES, STAYS = 120, 15


def stays(docs: DataFrame) -> DataFrame:
    """source, lang, batch, value, sign: each document's entry, leaving and return by the hash of its id.

    A null source or lang is the empty string, and a null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    b, q = h % BATCHES, F.floor(h / BATCHES) % STAYS
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), F.col("n_chars").cast("long").alias("n"), b.alias("b"), q.cast("long").alias("q"))

    def change(batch: Column, value: Column, sign: int) -> Column:
        return F.struct(batch.cast("int").alias("batch"), value.alias("value"), F.lit(sign).alias("sign"))

    out = F.col("b") + F.col("q")
    each = F.array(change(F.col("b"), F.col("n"), 1), change(out, F.col("n"), -1), F.when(F.col("q") % 3 == 0, change(out, F.col("n") + F.col("q"), 1)))
    return rows.select("source", "lang", F.inline(each)).where(F.col("batch") < BATCHES)


def maintenance_report(docs: DataFrame) -> DataFrame:
    """The aggregates' changes by batch, source and lang for documents that come, go and come back as `stays` says."""
    return maintain(stays(docs), "source", "lang")
