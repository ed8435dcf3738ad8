"""The trie of all conversations' prefixes, by prefix doubling.

Turns get names; blocks of 2, 4, 8, ... turns get names from the names of their halves, one join a doubling; a prefix of d
turns is the blocks of d's binary digits, its name made from the prefix without the last block and that block. Equal names
are equal sequences, so the trie's nodes are groups of names. No conversation and no node is gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, begin, stored, text_of

#: Turns that one window task sums up, and ids that one piece of a node's list holds.
BLOCK, PIECE = 1024, 1024
#: monotonically_increasing_id puts the row of a partition below this bit.
ROW_BITS = 33


def numbered(own: Scratch, df: DataFrame, name: str) -> DataFrame:
    """df with dense numbers from 0, ascending along its partitions' rows. The offsets are one row for each partition."""
    marked = own.keep(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", ROW_BITS)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offset = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(offset, F.lit(0)).alias("__first"))
    found = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return found.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)).drop("__at", "__part", "__first")


def named(own: Scratch, df: DataFrame, *keys: str) -> DataFrame:
    """df with `name`: equal numbers where the keys are equal, dense from 0."""
    names = numbered(own, df.select(*keys).distinct(), "name")
    return own.keep(df.join(names, [*keys]))


def positions(own: Scratch, turns: DataFrame) -> DataFrame:
    """conv, pos, digest, size: turns with their place from 0, by turn (null first), then by digest.

    Places come from one sort by ranges and the first number of each conversation, so a conversation of any length is
    spread over tasks.
    """
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    hashed = turns.select(F.col("conv_id").alias("conv"), "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
    sized = own.keep(hashed)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    at = own.keep(numbered(own, sized.repartitionByRange(*order).sortWithinPartitions(*order), "at"))
    first = at.groupBy("conv").agg(F.min("at").alias("first"))
    return at.join(first, "conv").select("conv", (F.col("at") - F.col("first")).alias("pos"), "digest", "size")


def grafted(own: Scratch, at: DataFrame, share: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n) and their rebuilt turns: the first `share` turns of conversation `source`, then their own
    turns from place `share` on. share and source are expressions over conv; share has a small bound."""
    own_turns = at.groupBy("conv").agg(F.count("*").alias("n"))
    convs = own.keep(own_turns.select("conv", "n", share.alias("share"), source.alias("source")))
    counts = convs.select(F.col("conv").alias("source"), F.col("n").alias("n_source"))
    plan = convs.join(counts, "source", "left").select("conv", "share", "source", "n", F.least("share", F.coalesce("n_source", F.lit(0))).alias("taken"))
    plan = own.keep(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("share"), F.lit(0))))
    wanted = plan.where("taken > 0").select("conv", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("pos"))
    given = at.select(F.col("conv").alias("source"), "pos", "digest", "size").join(wanted, ["source", "pos"]).select("conv", "pos", "digest", "size")
    kept = at.join(plan.select("conv", "share", "taken"), "conv").where("pos >= share").select("conv", (F.col("pos") - F.col("share") + F.col("taken")).alias("pos"), "digest", "size")
    return plan.select("conv", "length"), own.keep(given.union(kept))


def prefix_names(own: Scratch, turns: DataFrame) -> DataFrame:
    """conv, depth, name, size: the name of every prefix of depth turns, 1 or more; names are unique over all depths.

    Blocks are named by levels: (lower half, upper half) of the level below. A prefix whose depth has j binary digits set is
    named after the one without its lowest digit, which j - 1 rounds have named, and the block of that digit.
    """
    longest = turns.agg(F.max("pos")).first()[0]
    if longest is None:
        return turns.select("conv", F.col("pos").alias("depth"), F.struct(F.lit(1).alias("digits"), F.col("pos").alias("name")).alias("name"), "size")
    longest += 1
    level = named(own, turns.select("conv", F.col("pos").alias("i"), "digest"), "digest").select("conv", "i", "name")
    levels = [level]
    while longest >> len(levels):
        odd = level.where("i % 2 = 1").select("conv", F.shiftright("i", 1).alias("i"), F.col("name").alias("upper"))
        even = level.where("i % 2 = 0").select("conv", F.shiftright("i", 1).alias("i"), F.col("name").alias("lower"))
        level = named(own, even.join(odd, ["conv", "i"]), "lower", "upper").select("conv", "i", "name")
        levels.append(level)
    blocks = levels[0].select("conv", F.lit(0).alias("level"), "i", "name").limit(0)
    for k, of in enumerate(levels):
        blocks = blocks.union(of.select("conv", F.lit(k).alias("level"), "i", "name"))
    # the last block of the prefix of depth d: its lowest digit 1 << level, beginning at d without it
    blocks = blocks.where("i % 2 = 0").withColumn("before", F.expr("shiftleft(i, level)")).withColumn("depth", F.expr("before + shiftleft(1L, level)"))
    blocks = own.keep(blocks.select("conv", "depth", "before", "level", F.col("name").alias("block"), F.bit_count("depth").alias("digits")))
    done = blocks.where("digits = 1").select("conv", "depth", F.lit(-1).cast("long").alias("first"), "level", "block")
    done = front = named(own, done, "first", "level", "block").select("conv", "depth", F.lit(1).alias("digits"), "name")
    for digits in range(2, longest.bit_length() + 1):
        next_ = blocks.where(F.col("digits") == digits).join(front.select("conv", F.col("depth").alias("before"), F.col("name").alias("first")), ["conv", "before"])
        front = named(own, next_.select("conv", "depth", "first", "level", "block"), "first", "level", "block").select("conv", "depth", F.lit(digits).alias("digits"), "name")
        done = done.union(front)
    # a name is unique among those of one number of digits
    whole = done.select("conv", "depth", F.struct("digits", "name").alias("name"))
    return own.keep(whole.join(turns.select("conv", (F.col("pos") + 1).alias("depth"), "size"), ["conv", "depth"]))


def suffix_sums(own: Scratch, rows: DataFrame) -> DataFrame:
    """conv, depth, sum of value over this and greater depths; a task holds BLOCK rows and a conversation's block sums."""
    block = F.floor(F.col("depth") / BLOCK)
    by_block = rows.groupBy("conv", block.alias("block")).agg(F.sum("value").alias("sum"))
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later_blocks = by_block.select("conv", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("later"))
    within = Window.partitionBy("conv", "block").orderBy(F.desc("depth"))
    inside = rows.withColumn("block", block).withColumn("sum", F.sum("value").over(within))
    return inside.join(later_blocks, ["conv", "block"]).select("conv", "depth", (F.col("sum") + F.col("later")).alias("sum"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run of rows of a node: the digest of its pieces, fed to it one by one."""
    begin("prefix_trie")
    name, state = None, None
    for batch in batches:
        out = []
        for node, piece in zip(batch["id"], batch["piece"], strict=True):
            if node != name:
                if state:
                    out.append((name, state.hexdigest()))
                name, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pd.DataFrame(out, columns=["id", "digest"])
    if state:
        yield pd.DataFrame([(name, state.hexdigest())], columns=["id", "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """id, digest of the comma-joined ascending convs of each id in ends (id, conv).

    Ids are joined within ranges of PIECE numbers first. A digest has to read its node's pieces one after the other: they
    stream through a task in order, and none is held.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("id", F.floor(F.col("conv") / PIECE).alias("range")).agg(piece.alias("piece"))
    return pieces.repartition("id").sortWithinPartitions("id", "range").select("id", "piece").mapInPandas(_digests, "id long, digest string")


def trie(own: Scratch, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes for conversations (conv, length) and their turns (conv, pos, digest, size)."""
    rows = prefix_names(own, turns)
    root = F.struct(F.lit(0).alias("digits"), F.lit(0).cast("long").alias("name"))
    rows = own.keep(rows.select("conv", "depth", "name", "size").union(convs.select("conv", F.lit(0).cast("long"), root, F.lit(0).cast("long"))))
    groups = own.keep(rows.groupBy("name", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size")))
    # a node's parent has the rows of the same conversations one turn earlier; its smallest member tells its name
    above = rows.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = groups.join(above, ["conv_id", "depth"], "left")
    parents = groups.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    id_ = numbered(own, nodes.join(children, "name", "left").select("name", "depth", "conv_id", "n_convs", "size", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children")), "id")
    nodes = own.keep(id_)

    # sums over subtrees: a node below stands at its smallest member's place, and all above it are that one's prefixes
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("conv"), F.lit(1).alias("leaf"))
    own_value = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    valued = rows.join(own_value, ["conv", "depth"], "left").select("conv", "depth", F.coalesce("own", F.lit(0)).alias("value"))
    sums = suffix_sums(own, valued).join(leaves, "conv", "left")
    below = rows.select("conv", "depth", "name").join(sums, ["conv", "depth"]).groupBy("name").agg(F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum("sum").alias("saved_tokens"))

    last = rows.join(convs.select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("name", "conv")
    ends = own.keep(last.join(nodes.select("name", "id"), "name").select("id", "conv"))
    found = nodes.join(parents, "parent", "left").join(below, "name").join(end_digests(ends), "id", "left")
    none = hashlib.sha256().hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(none)).alias("ends_sha256"))


def trie_report(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, one row each.

    Conversation c takes its first h turns from conversation c - c % 5, h being crc32(decimal c) % 9. Rows without a conv_id
    belong to no conversation and are left out; a null role or text is the empty one; turns of one number, null ones first,
    are ordered by the digest of role and text, so repeated rows are turns of their own. No conversations give no nodes, and
    other columns are ignored. Texts of any length meet only their own row: sequences are compared by SHA-256 digests of
    role and text.
    """
    with Scratch(conversations.sparkSession) as own:
        turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
        share = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("long")
        convs, rebuilt = grafted(own, positions(own, turns), share, F.col("conv") - F.pmod("conv", F.lit(5)))
        return stored(trie(own, convs, rebuilt))
