"""Document fingerprints by I-Match over randomised lexicons, in DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of


@dataclass(frozen=True)
class Lexicons:
    """rare and common: the band of document frequency, as shares of all documents, whose terms are kept (inverse
    document frequency from ln(1 / common) to ln(1 / rare)). Documents with the same `sketch` smallest hashes of terms,
    which copies and most near copies have, count as one. slots: (number of slots that a hash deals the terms to at random,
    how many of the slots are lexicons); small lexicons stay the same when a part of a text changes, those of
    many slots in long texts.

    Terms over rare are at most (terms of a text) / rare in number, however many documents there are; up to `broadcast`
    of them the lexicon is sent to all executors, and beyond that it is joined by a shuffle. So are the sketches of copies.
    """

    rare: float = 0.0005
    common: float = 0.2
    least: int = 2
    slots: tuple[tuple[int, int], ...] = ((64, 32), (512, 32))
    sketch: int = 16
    broadcast: int = 2_000_000


def term_hashes(text: Column) -> Column:
    """64-bit hashes of the distinct lower-case runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, rules: Lexicons) -> DataFrame:
    """term of each term in the band; texts: a column `text`. Counts cover all documents and are summed before the shuffle.

    Each of n documents of a sketch counts 1 / n, in units of 2**-32, so that sums are rounded to whole numbers right.
    """
    one = 1 << 32
    keyed = texts.select(term_hashes(F.col("text")).alias("terms")).select("terms", F.xxhash64(F.slice(F.array_sort("terms"), 1, rules.sketch)).alias("alike"))
    groups = cut(keyed.groupBy("alike").agg(F.count("*").alias("n")))
    total, copied = groups.count(), groups.where("n > 1")
    joined = keyed.join(F.broadcast(copied) if copied.count() <= rules.broadcast else copied, "alike", "left")
    shares = joined.select(F.explode("terms").alias("term"), F.expr(f"coalesce({one}L div n, {one}L)").alias("share"))
    counts = shares.groupBy("term").agg(F.shiftright(F.sum("share") + F.lit(one // 2), 32).alias("count"))
    low, high = max(rules.least, rules.rare * total), rules.common * total
    return counts.where((F.col("count") >= low) & (F.col("count") <= max(high, rules.least))).select("term")


def slotted(terms: Column, slots: int, used: int, seed: int) -> Column:
    """(slot, term) of the terms in the slots that are lexicons, in the order of the terms."""
    dealt = F.transform(terms, lambda h: F.struct(F.pmod(F.xxhash64(h, F.lit(seed)), F.lit(slots)).alias("slot"), h.alias("term")))
    return F.filter(dealt, lambda t: t["slot"] < used)


def slot_hashes(dealt: Column, used: int) -> Column:
    """For each random lexicon, 32 bits of the hash of the sorted terms in it; null where none is."""

    def inside(number: int) -> Column:
        return F.transform(F.filter(dealt, lambda t: t["slot"] == number), lambda t: t["term"])

    kept = F.array(*[inside(i) for i in range(used)])
    return F.transform(kept, lambda k: F.when(F.size(k) > 0, F.xxhash64(k).bitwiseAND(F.lit(0xFFFFFFFF))))


def spelled(parts: Column) -> Column:
    """The fingerprint as text: hexadecimal hashes joined by dots, nothing for a lexicon without terms."""
    return F.array_join(F.transform(parts, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 8, "0"), F.lit(""))), ".")


def likeness(a: Column, b: Column) -> Column:
    """The share of lexicons with equal hashes among those in which either has terms; 1 if neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / F.greatest(either, F.lit(1)))


def fingerprints(texts: DataFrame, lexicon_terms: DataFrame, keys: list[str], columns: list[str], rules: Lexicons) -> DataFrame:
    """keys and, for each text column, its fingerprint parts. keys are unique.

    Terms are exploded, met with the lexicon and collected again by key; where the rows already lie by the first key,
    as after a window over it, only the lexicon moves. A text's terms are one group, as large as the text. Where none of
    them is in the lexicon, the first two parts are the halves of a hash of them all, and the others null.
    """

    def sided(side: int, column: str) -> Column:
        return F.transform(term_hashes(F.col(column)), lambda h: F.struct(h.alias("term"), F.lit(side).alias("side")))

    both = F.flatten(F.array(*[sided(i, c) for i, c in enumerate(columns)]))
    rows = texts.select(*keys, F.explode_outer(both).alias("t")).select(*keys, "t.term", "t.side")
    few = lexicon_terms.withColumn("__in", F.lit(True))
    rows = rows.join(F.broadcast(few) if few.count() <= rules.broadcast else few, "term", "left")
    sides = [F.sort_array(F.collect_list(F.when(F.col("__in") & (F.col("side") == i), F.col("term")))).alias(c) for i, c in enumerate(columns)]
    alls = [F.bit_xor(F.when(F.col("side") == i, F.xxhash64("term", F.lit(-1)))).alias(f"{c}_all") for i, c in enumerate(columns)]
    grouped = rows.groupBy(*keys).agg(*sides, *alls)
    # columns of their own, so that each is made once
    bare = [F.when(F.size(c) == 0, F.col(f"{c}_all")).alias(f"{c}_all") for c in columns]
    dealt = grouped.select(*keys, *bare, *[slotted(F.col(c), n, used, k).alias(f"{c}_{k}") for c in columns for k, (n, used) in enumerate(rules.slots)])
    low = F.lit(0xFFFFFFFF)
    rest = F.array_repeat(F.lit(None).cast("bigint"), sum(used for _, used in rules.slots) - 2)
    whole = lambda c: F.concat(F.array(F.col(c).bitwiseAND(low), F.shiftrightunsigned(c, 32)), rest)
    parts = lambda c: F.concat(*[slot_hashes(F.col(f"{c}_{k}"), used) for k, (_, used) in enumerate(rules.slots)])
    return dealt.select(*keys, *[F.when(F.col(f"{c}_all").isNotNull(), whole(f"{c}_all")).otherwise(parts(c)).alias(c) for c in columns])


def with_next(docs: DataFrame, *, key: str = "doc_id", width: int = 2000) -> DataFrame:
    """docs (key, text) with __bucket, __row, the next document's text in order of the key, and its bucket and row.

    Buckets are equal ranges of the key with about `width` documents on average; within one a window finds the next, and the first
    text of the next bucket serves its last row. Only that table, a row for each bucket, is ordered as a whole. After
    the last document comes the first. Null keys go first; equal keys go by text.
    """
    low, high, n = docs.agg(F.min(key), F.max(key), F.count("*")).first()
    step = max(1, ((high or 0) - (low or 0) + 1) * width // max(1, n))
    placed = docs.withColumn("__bucket", F.coalesce(F.floor((F.col(key) - F.lit(low or 0)) / step), F.lit(-1)).cast("long"))
    order = Window.partitionBy("__bucket").orderBy(F.col(key).asc_nulls_first(), "text")
    inside = placed.withColumn("__row", F.row_number().over(order)).withColumn("__own", F.lead("text").over(order))
    heads = cut(placed.groupBy("__bucket").agg(F.min_by("text", F.struct(key, "text")).alias("__head")))
    whole = Window.orderBy("__bucket")
    ends = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("__bucket"),
        F.coalesce(F.lead("__bucket").over(whole), F.first("__bucket").over(ends)).alias("__next_bucket"),
        F.coalesce(F.lead("__head").over(whole), F.first("__head").over(ends)).alias("__head"),
    )
    joined = inside.join(heads, "__bucket")
    last = F.col("__own").isNull()
    return joined.select(
        *docs.columns,
        "__bucket",
        "__row",
        F.coalesce("__own", "__head").alias("__next"),
        F.when(last, F.col("__next_bucket")).otherwise(F.col("__bucket")).alias("__next_bucket"),
        F.when(last, F.lit(1)).otherwise(F.col("__row") + 1).alias("__next_row"),
    )


def fingerprint_report(docs: DataFrame, rules: Lexicons | None = None) -> DataFrame:
    """The contract: each text's fingerprint, that of its edited text, and the likeness to that and to the next document's.

    Null and empty texts have no terms: their fingerprint has no hash, and two such are alike (1). Repeated rows get a row each.
    """
    rules = rules or Lexicons()
    given = docs.select("doc_id", text_of().alias("text"))
    terms = cut(lexicon(given, rules))
    n = F.char_length("text")
    linked = with_next(given).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - CAST(floor(char_length(text) / 4) AS int))"), F.expr("left(__next, CAST(floor(char_length(text) / 4) AS int))")))
    facts = ["doc_id", "__bucket", "__row", "__next_bucket", "__next_row", "__chars", "__sha"]
    linked = linked.withColumn("__chars", n.cast("long")).withColumn("__sha", F.sha2("edited", 256))
    keys = ["__bucket", "__row", "doc_id", "__next_bucket", "__next_row", "__chars", "__sha"]
    parts = cut(fingerprints(linked, terms, keys, ["text", "edited"], rules).select(*facts, "text", "edited"))
    after = parts.select(F.col("__bucket").alias("__next_bucket"), F.col("__row").alias("__next_row"), F.col("text").alias("__after"))
    return parts.join(after, ["__next_bucket", "__next_row"]).select(
        "doc_id",
        F.col("__chars").alias("n_chars"),
        F.col("__sha").alias("edited_sha256"),
        spelled(F.col("text")).alias("fingerprint"),
        spelled(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("__after")).alias("near_next"),
    )
