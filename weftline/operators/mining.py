"""Change coupling mined from whole histories: commits (commit_id, ts, ...) and commit_files (commit_id, file, churn)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.stages import held


def usable_files(files: DataFrame, *, most: int = 40, sweep_values: int = 8, sweep_spread: float = 0.2) -> DataFrame:
    """commit_files of commits with 2 to `most` files that aren't sweeps.

    A sweep has at least sweep_values churn values whose deviation is under sweep_spread of their mean, as a mechanical
    rewrite has. One aggregate by commit decides, and a semi join keeps the rows. Both sides are taken times the number of
    values, from sums: of whole numbers these are exact, so a deviation of just that share is never under it, in whatever
    order the rows come (a running variance is off by a last digit either way). A commit of so many files that knows no
    churn at all may be one, and is left out.
    """
    churn = F.col("churn").cast("double")
    stats = files.groupBy("commit_id").agg(F.count("*").alias("n"), F.count("churn").alias("m"), F.sum(churn).alias("sum"), F.sum(churn * churn).alias("squares"))
    dev = F.sqrt(F.greatest(F.col("m") * F.col("squares") - F.col("sum") * F.col("sum"), F.lit(0.0)))
    sweep = (F.col("n") >= sweep_values) & (F.col("sum") != 0) & (dev < sweep_spread * F.col("sum"))
    return files.join(stats.where(F.col("n").between(2, most) & ~sweep).select("commit_id"), "commit_id", "left_semi")


def weighted(files: DataFrame) -> DataFrame:
    """commit_files with n and weight: 1 / log2(n + 1) for the n files of a commit."""
    n = files.groupBy("commit_id").agg(F.count("*").alias("n"))
    return files.join(n, "commit_id").withColumn("weight", 1 / F.log2(F.col("n") + 1))


def item_support(files: DataFrame) -> DataFrame:
    return weighted(files).groupBy("file").agg(F.sum("weight").alias("support"), F.count("*").alias("commits"))


def pairs(files: DataFrame, *carried: str) -> DataFrame:
    """Each unordered pair a < b of files of a commit; commits are bounded by usable_files, and so are their pairs."""
    left = files.select("commit_id", F.col("file").alias("a"), *carried)
    right = files.select("commit_id", F.col("file").alias("b"))
    return left.join(right, "commit_id").where("a < b")


def file_pairs(files: DataFrame, commits: DataFrame, *, support: float = 4.0, confidence: float = 0.5) -> DataFrame:
    """Coupled pairs: weighted support, confidence both ways, and how far authors of the two files differ.

    jaccard compares the files' author sets; hidden = support * conf * (1 - jaccard) is high for pairs that different
    people keep in step.
    """
    heavy = weighted(files)
    items = heavy.groupBy("file").agg(F.sum("weight").alias("s"))
    found = pairs(heavy, "weight").groupBy("a", "b").agg(F.sum("weight").alias("support")).where(F.col("support") >= support)
    side = lambda x: items.select(F.col("file").alias(x), F.col("s").alias(f"s_{x}"))
    found = found.join(side("a"), "a").join(side("b"), "b")
    found = found.withColumn("conf_ab", F.col("support") / F.col("s_a")).withColumn("conf_ba", F.col("support") / F.col("s_b"))
    found = found.withColumn("conf", F.greatest("conf_ab", "conf_ba")).where(F.col("conf") >= confidence)
    people = files.join(commits.select("commit_id", "author"), "commit_id").select("file", "author").distinct()
    n = people.groupBy("file").agg(F.count("*").alias("n"))
    both = (
        found.select("a", "b")
        .join(people.select(F.col("file").alias("a"), "author"), "a")
        .join(people.select(F.col("file").alias("b"), F.col("author").alias("other")), "b")
        .where("author = other")
        .groupBy("a", "b")
        .agg(F.count("*").alias("both"))
    )
    out = found.join(both, ["a", "b"], "left").join(n.select(F.col("file").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("n_b")), "b")
    shared = F.coalesce("both", F.lit(0))
    out = out.withColumn("jaccard", F.coalesce(shared / F.nullif(F.col("n_a") + F.col("n_b") - shared, F.lit(0)), F.lit(0.0)))
    return out.select("a", "b", "support", "conf_ab", "conf_ba", "conf", "jaccard", (F.col("support") * F.col("conf") * (1 - F.col("jaccard"))).alias("hidden"))


def itemsets(files: DataFrame, *, least: int = 3, size: int = 3) -> DataFrame:
    """items (sorted array), n: sets of 1 to `size` files found in at least `least` commits.

    Level k joins the sets of k - 1 with the frequent items beyond their last one, in commits that hold both, so by
    downward closure nothing infrequent is extended.
    """
    counts = files.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    frequent = files.join(counts.select("file"), "file", "left_semi").select("commit_id", "file")
    levels = counts.select(F.array("file").alias("items"), "n")
    held = frequent.select("commit_id", F.array("file").alias("items"))
    for _ in range(size - 1):
        grown = held.join(frequent, "commit_id").where(F.col("file") > F.element_at("items", -1)).select("commit_id", F.concat("items", F.array("file")).alias("items"))
        level = grown.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        held = grown.join(level.select("items"), "items", "left_semi")
        levels = levels.union(level)
    return levels


def rules(sets: DataFrame, total: int | Column, *, lift: float = 1.5) -> DataFrame:
    """lhs, rhs, confidence, lift, leverage for every split of a frequent set in two, larger right sides too."""
    masks = F.explode(F.expr("sequence(1, CAST(power(2, size(items)) AS int) - 2)"))
    splits = sets.where(F.size("items") > 1).select("items", "n", masks.alias("mask"))
    part = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {bit})")
    splits = splits.select("n", part(1).alias("lhs"), part(0).alias("rhs"))
    known = sets.select(F.col("items"), F.col("n").alias("m"))
    both = splits.join(known.select(F.col("items").alias("lhs"), F.col("m").alias("n_lhs")), "lhs").join(known.select(F.col("items").alias("rhs"), F.col("m").alias("n_rhs")), "rhs")
    whole = F.lit(total) if isinstance(total, int) else total
    out = both.withColumn("confidence", F.col("n") / F.col("n_lhs")).withColumn("lift", F.col("n") * whole / (F.col("n_lhs") * F.col("n_rhs")))
    out = out.withColumn("leverage", F.col("n") / whole - (F.col("n_lhs") / whole) * (F.col("n_rhs") / whole))
    return out.where(F.col("lift") >= lift).select("lhs", "rhs", "n", "confidence", "lift", "leverage")


#: Positions of the history that one window goes over.
POSITIONS_A_BLOCK = 1024


def lagged_pairs(files: DataFrame, commits: DataFrame, *, window: int = 5, days: int = 7) -> DataFrame:
    """earlier, later, n: files of commits at most `window` positions and `days` days apart, the older one's first.

    Positions come from ranks within days, whose counts are few, added up over the days before: no task sorts all
    commits. A window over blocks of positions, each with the first `window` of the next, gives a commit the files of those
    that follow. These travel as one array a file to the task of the earlier one, and pairs are made and counted there.
    """
    held_files = files.groupBy("commit_id").agg(F.collect_list("file").alias("files"))
    placed = positions(commits.select("commit_id", "ts").join(held_files, "commit_id")).select("position", F.unix_timestamp("ts").alias("at"), "files")
    block = F.floor(F.col("position") / POSITIONS_A_BLOCK)
    before = F.floor((F.col("position") - window) / POSITIONS_A_BLOCK)
    dealt = placed.withColumn("block", F.explode(F.sequence(F.greatest(before, F.lit(0)), block)))
    behind = Window.partitionBy("block").orderBy("position").rowsBetween(1, window)
    near = dealt.withColumn("next", F.collect_list(F.struct("at", "files")).over(behind)).where(F.col("block") == block)
    soon = F.filter("next", lambda x: x["at"] - F.col("at") <= days * 86400)
    sent = near.select(F.explode("files").alias("earlier"), F.flatten(F.transform(soon, lambda x: x["files"])).alias("later")).where(F.size("later") > 0)
    return _counted_beside(sent, "earlier", "later").where("earlier <> later").groupBy("earlier", "later").agg(F.count("*").alias("n"))


def _counted_beside(sent: DataFrame, key: str, others: str) -> DataFrame:
    """A row for each element of the array `others`, all of a key in one task, so that counting (key, other) sends nothing more."""
    return sent.repartition(key).withColumn(others, F.explode(others))


def positions(commits: DataFrame) -> DataFrame:
    """commits with position: 0-based place by (ts, commit_id), oldest first."""
    dated = commits.withColumn("__day", F.to_date("ts"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy("__day").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("__day").orderBy("ts", "commit_id"))
    return dated.withColumn("__local", local).join(days, "__day").withColumn("position", F.col("__before") + F.col("__local") - 1).drop("__day", "__local", "__n", "__before")


def recency(commits: DataFrame, scale: float = 200.0) -> DataFrame:
    """commits with recency 0 (newest) upward and decay = exp(-recency / scale)."""
    placed = positions(commits)
    last = placed.agg(F.max("position").alias("__last"))
    return placed.crossJoin(F.broadcast(last)).withColumn("recency", F.col("__last") - F.col("position")).drop("__last").withColumn("decay", F.exp(-F.col("recency") / scale))


def size_cap(files: DataFrame, *, floor: int = 12, ceiling: int = 20) -> DataFrame:
    """One row: cap = max(floor, min(p90, ceiling)), p90 being the size at place floor(0.9 n) of the sorted commit sizes.

    Sizes are counted first; the place is found in the running sum of those counts.
    """
    sizes = files.groupBy("commit_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    up = F.sum("n").over(Window.orderBy("size"))
    total = sizes.agg(F.sum("n").alias("total"))
    at = sizes.withColumn("up", up).crossJoin(F.broadcast(total)).where(F.col("up") > F.floor(F.lit(0.9) * F.col("total")))
    return at.agg(F.min("size").alias("p90")).select(F.greatest(F.lit(floor), F.least("p90", F.lit(ceiling))).cast("long").alias("cap"))


def pair_history(files: DataFrame, commits: DataFrame, *, scale: float = 200.0, floor: int = 12, ceiling: int = 20) -> DataFrame:
    """a, b, shared commits and their decayed weight; commits over the size cap are left out but keep their place."""
    sizes = files.groupBy("commit_id").agg(F.count("*").alias("size"))
    small = sizes.crossJoin(F.broadcast(size_cap(files, floor=floor, ceiling=ceiling))).where("size <= cap").select("commit_id")
    aged = recency(commits.join(files.select("commit_id").distinct(), "commit_id", "left_semi"), scale).select("commit_id", "decay")
    kept = files.join(small, "commit_id", "left_semi").join(aged, "commit_id")
    return pairs(kept, "decay").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("decay").alias("weight"))


def weekly_churn(files: DataFrame, commits: DataFrame) -> DataFrame:
    week = F.floor(F.unix_timestamp("ts") / 604800).alias("week")
    return files.join(commits.select("commit_id", "ts"), "commit_id").groupBy("file", week).agg(F.sum("churn").alias("churn"))


def _pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's r of each row of x with the same row of y; 0 where either doesn't vary."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    down = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
    return np.divide((x * y).sum(axis=1), down, out=np.zeros(len(x)), where=down > 1e-9)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks in each row: equal values share the mean of their places."""
    order = np.argsort(x, axis=1)
    ordered, place = np.take_along_axis(x, order, axis=1), np.arange(x.shape[1])
    same = ordered[:, 1:] == ordered[:, :-1]
    edge = np.ones((len(x), 1), dtype=bool)
    first = np.maximum.accumulate(np.where(np.hstack([edge, ~same]), place, 0), axis=1)
    last = np.minimum.accumulate(np.where(np.hstack([~same, edge]), place, x.shape[1] - 1)[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty(x.shape)
    np.put_along_axis(ranks, order, (first + last) / 2, axis=1)
    return ranks


def _strongest(x: np.ndarray, y: np.ndarray, lag: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lag, whether by ranks, and r of each row's strongest view: no lag by values, no lag by ranks, then lags upward."""
    n = x.shape[1]
    views = [(0, False, _pearson(x, y)), (0, True, _pearson(_ranks(x), _ranks(y)))]
    for by in range(-lag, lag + 1):
        if by and n - abs(by) >= overlap:
            xs, ys = (x[:, : n - by], y[:, by:]) if by > 0 else (x[:, -by:], y[:, : n + by])
            views += [(by, False, _pearson(xs, ys)), (by, True, _pearson(_ranks(xs), _ranks(ys)))]
    r = np.stack([v[2] for v in views])
    best = np.argmax(np.abs(r).round(9), axis=0)  # the first of equals
    return np.array([v[0] for v in views])[best], np.array([v[1] for v in views])[best], r[best, np.arange(len(x))]


#: Pairs whose series one step of a task holds as arrays.
AT_ONCE = 500
#: Pairs whose series one task sorts for a join.
PAIRS_A_TASK = 20_000


def churn_correlation(churn: DataFrame, candidates: DataFrame, *, weeks: int = 6, least: float = 0.6, lag: int = 4, overlap: int = 4) -> DataFrame:
    """a, b, lag, method, r: the strongest of Pearson and Spearman over lags of -lag to lag weeks.

    Series hold the weeks in which either file changed, 0 where one didn't. Of equal |r| (to nine places) the view without
    a lag comes first, Pearson before Spearman, then the most negative lag; method is the view's, r isn't rounded. Pairs
    need `weeks` weeks and |r| of at least `least`, lagged series `overlap` weeks.
    A file's weeks are one row, as many as the history has; pairs of series are compared in Arrow batches.
    """
    kinds = f"a {churn.schema['file'].dataType.simpleString()}, b {churn.schema['file'].dataType.simpleString()}, lag int, method string, r double"
    series = churn.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(F.col("week").cast("long").alias("week"), F.col("churn").cast("double").alias("churn")))).alias("s"))
    side = lambda of: series.select(F.col("file").alias(of), F.col("s.week").alias(f"week_{of}"), F.col("s.churn").alias(f"churn_{of}"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE)
                arrays = [[np.asarray(v) for v in rows[c].to_pylist()] for c in ("week_a", "churn_a", "week_b", "churn_b")]
                by_length: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
                for i, (wa, ca, wb, cb) in enumerate(zip(*arrays, strict=True)):
                    both = np.union1d(wa, wb)
                    x, y = np.zeros(len(both)), np.zeros(len(both))
                    x[np.searchsorted(both, wa)], y[np.searchsorted(both, wb)] = ca, cb
                    by_length.setdefault(len(both), []).append((i, x, y))
                kept: list[tuple[int, int, bool, float]] = []
                for n, group in by_length.items():
                    if n >= weeks:
                        lags, ranked, r = _strongest(np.stack([g[1] for g in group]), np.stack([g[2] for g in group]), lag, overlap)
                        kept += [(g[0], int(k), bool(s), float(v)) for g, k, s, v in zip(group, lags, ranked, r, strict=True) if abs(v) >= least]
                of = pa.array([k[0] for k in kept], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows["a"].take(of), rows["b"].take(of), pa.array([k[1] for k in kept], pa.int32()), pa.array(["spearman" if k[2] else "pearson" for k in kept], pa.string()), pa.array([k[3] for k in kept], pa.float64())],
                    names=["a", "b", "lag", "method", "r"],
                )

    # a pair carries two series, so tasks follow the number of pairs; few pairs are much work too and stay apart
    asked = held(candidates.select("a", "b"))
    parts = max(int(churn.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // PAIRS_A_TASK))
    pairs_ = asked.repartition(parts, "a").join(side("a"), "a").repartition(parts, "b").join(side("b"), "b").repartition(parts)
    return pairs_.select("a", "b", "week_a", "churn_a", "week_b", "churn_b").mapInArrow(compared, kinds)


def subject_clusters(files: DataFrame, keyed: DataFrame, *, least: int = 2, top: int = 8) -> DataFrame:
    """key, files (the top ones with at least `least` commits, most first), total; keyed: commit_id, key. Clusters need two files."""
    counts = files.join(keyed, "commit_id").groupBy("key", "file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "file"))).where(F.col("place") <= top)
    grouped = best.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]).alias("files"), F.sum("n").alias("total"))
    return grouped.where(F.size("files") >= 2)


#: Words that say nothing of a commit. Fixed values.
STOPWORDS = ("this", "that", "with", "from", "into", "when", "then", "also", "just", "some", "more", "less", "been", "have", "will", "fix", "add", "use", "set", "get", "make", "made", "new")


def message_words(text: Column, letters: str = "a-z0-9_") -> Column:
    """The lower-case words of four characters or more that aren't stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"[{letters}]{{4,}}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def rarest_words(messages: DataFrame) -> DataFrame:
    """commit_id, token: each message (commit_id, text) with its rarest usable word, the first in the text on ties.

    Usable words occur in 2 messages up to a quarter of all.
    """
    total = messages.agg(F.count("*").alias("total"))
    words = messages.select("commit_id", F.posexplode(message_words(F.col("text"))).alias("place", "token"))
    df = words.groupBy("token").agg(F.countDistinct("commit_id").alias("df")).crossJoin(F.broadcast(total)).where((F.col("df") >= 2) & (F.col("df") * 4 <= F.col("total")))
    return words.join(df, "token").groupBy("commit_id").agg(F.min_by("token", F.struct("df", "place")).alias("token"))


def token_clusters(messages: DataFrame, *, least: int = 3) -> DataFrame:
    """token, commits: messages (commit_id, text) by their rarest word, of `least` commits or more."""
    return rarest_words(messages).groupBy("token").agg(F.count("*").alias("commits")).where(F.col("commits") >= least)


def message_keys(messages: DataFrame, *, least: int = 3) -> DataFrame:
    """commit_id, key: a ticket or scope in the message (commit_id, subject, body), or, where fewer than `least` commits
    have one, its rarest word."""
    keyed = messages.select("commit_id", paths.cluster_key(F.col("subject"), F.col("body")).alias("key")).where("key IS NOT NULL")
    enough = keyed.agg((F.count("*") >= least).alias("enough"))
    words = rarest_words(messages.select("commit_id", F.col("subject").alias("text"))).select("commit_id", F.col("token").alias("key"))
    pick = lambda rows, yes: rows.crossJoin(F.broadcast(enough)).where(F.col("enough") == F.lit(yes)).select("commit_id", "key")
    return pick(keyed, True).union(pick(words, False))


def defect_edges(changes: DataFrame, *, least: int = 2) -> DataFrame:
    """introducer, other, n: for fixes' deleted lines (commit_id, parent, path), how often each path points at the others."""
    groups = changes.select("commit_id", "parent", "path").distinct()
    others = changes.select("commit_id", F.col("path").alias("other")).distinct()
    return groups.join(others, "commit_id").where("path <> other").groupBy(F.col("path").alias("introducer"), "other").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cross_language(files: DataFrame, symbols: DataFrame, *, examples: int = 3) -> DataFrame:
    """lang_a, lang_b, n, examples: symbols (commit_id, symbol) of commits that touch several languages; files: commit_id, lang."""
    langs = files.select("commit_id", "lang").distinct()
    both = langs.select("commit_id", F.col("lang").alias("lang_a")).join(langs.select("commit_id", F.col("lang").alias("lang_b")), "commit_id").where("lang_a < lang_b")
    found = both.join(symbols.select("commit_id", "symbol").distinct(), "commit_id")
    by = found.groupBy("lang_a", "lang_b", "symbol").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang_a", "lang_b").orderBy(F.desc("n"), "symbol"))
    by = by.withColumn("place", place)
    shown = F.sort_array(F.collect_list(F.when(F.col("place") <= examples, F.struct("place", "symbol"))))
    return by.groupBy("lang_a", "lang_b").agg(F.sum("n").alias("n"), F.concat_ws(",", F.transform(shown, lambda x: x["symbol"])).alias("examples"))


def shared_constants(symbols: Column) -> Column:
    """Symbols that look like shared constants: SCREAMING_SNAKE of six characters or more, or Pascal case of seven."""
    return symbols.rlike("^[A-Z][A-Z0-9_]{5,}$") | symbols.rlike("^[A-Z][a-z0-9]+([A-Z][a-z0-9]+)+$") & (F.length(symbols) >= 7)


def coordinated_moves(moves: DataFrame, *, least: int = 2) -> DataFrame:
    """commit_id, n of commits with several renames or copies; moves: commit_id, from_path, to_path."""
    return moves.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: What each technique's vote for a pair is worth. Fixed values.
TECHNIQUE_WEIGHTS = {1: 1.0, 2: 3.0, 4: 1.5, 7: 1.5, 11: 1.0, 12: 3.0, 13: 2.0}


def combine_techniques(votes: DataFrame, structural: DataFrame | None = None, *, least: int = 2) -> DataFrame:
    """a, b, techniques (sorted), score: votes (technique, a, b) in either order count once; half for structural pairs (a, b)."""
    weight = F.create_map(*[F.lit(x) for kv in TECHNIQUE_WEIGHTS.items() for x in kv])
    once = votes.select("technique", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by = once.groupBy("a", "b").agg(F.sort_array(F.collect_set("technique")).alias("techniques"), F.sum(F.coalesce(F.try_element_at(weight, F.col("technique")), F.lit(0.0))).alias("score"))
    by = by.where(F.size("techniques") >= least)
    if structural is None:
        return by.withColumn("structural", F.lit(False))
    known = structural.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("structural", F.lit(True))
    by = by.join(known, ["a", "b"], "left").withColumn("structural", F.coalesce("structural", F.lit(False)))
    return by.withColumn("score", F.when(F.col("structural"), F.col("score") / 2).otherwise(F.col("score")))


def top_slice(df: DataFrame, order: list[Column], *, n: int | None = None, percent: float | None = None) -> DataFrame:
    """The first n rows, or the first percent of them (one at least)."""
    if n is not None:
        return df.orderBy(*order).limit(n)
    return df.orderBy(*order).limit(max(1, -(-int(df.count() * percent * 1000) // 100_000)))


def shortlist(combined: DataFrame, *, least: int = 2, score: float = 0.0, top: int = 25, structural: bool = False) -> DataFrame:
    kept = combined.where((F.size("techniques") >= least) & (F.col("score") >= score))
    kept = kept if structural else kept.where(~F.col("structural"))
    return kept.orderBy(F.desc("score"), "a", "b").limit(top)


def explain_pair(files: DataFrame, commits: DataFrame, a, b, *, limit: int = 50) -> DataFrame:
    """The newest commits that touch both files."""
    touch = lambda f: files.where(F.col("file") == f).select("commit_id")
    return commits.join(touch(a), "commit_id", "left_semi").join(touch(b), "commit_id", "left_semi").orderBy(F.desc("ts"), F.desc("commit_id")).limit(limit)


#: Files of a reviewer that one array holds.
FILES_AN_ARRAY = 1000


def reviewer_overlap(reviews: DataFrame, *, jaccard: float = 0.5, shared: int = 2) -> DataFrame:
    """a, b, shared, jaccard of files with much the same reviewers; reviews: file, reviewer.

    A reviewer's files go in order of their numbers of reviewers. Each sends those behind it, arrays of FILES_AN_ARRAY at
    most, to its own task, where pairs are made and counted; so a file that many review is the rarer one of few pairs.
    """
    once = reviews.select("file", "reviewer").distinct()
    n = once.groupBy("file").agg(F.count("*").alias("n"))
    placed = once.where("reviewer IS NOT NULL AND file IS NOT NULL").join(n, "file")
    place = F.row_number().over(Window.partitionBy("reviewer").orderBy("n", "file")) - 1
    placed = placed.withColumn("place", place).withColumn("part", F.floor(F.col("place") / FILES_AN_ARRAY))
    parts = placed.groupBy("reviewer", F.col("part").alias("other_part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]).alias("others"))
    met = placed.select("reviewer", "part", "place", F.col("file").alias("rare"), F.col("n").alias("n_rare")).join(parts, "reviewer").where("other_part >= part")
    behind = F.when(F.col("part") == F.col("other_part"), F.slice("others", (F.col("place") % FILES_AN_ARRAY + 2).cast("int"), FILES_AN_ARRAY)).otherwise(F.col("others"))
    sent = met.select("rare", "n_rare", behind.alias("other")).where(F.size("other") > 0)
    both = _counted_beside(sent, "rare", "other").groupBy("rare", "other").agg(F.first("n_rare").alias("n_rare"), F.count("*").alias("shared")).where(F.col("shared") >= shared)
    # the other has as many reviewers at least, so what is below this bound can't reach the index
    both = both.where(F.col("shared") * (1 + jaccard) >= 2 * jaccard * F.col("n_rare") - 1e-6)
    out = both.join(n.select(F.col("file").alias("other"), F.col("n").alias("n_other")), "other")
    out = out.withColumn("jaccard", F.col("shared") / (F.col("n_rare") + F.col("n_other") - F.col("shared"))).where(F.col("jaccard") >= jaccard)
    return out.select(F.least("rare", "other").alias("a"), F.greatest("rare", "other").alias("b"), "shared", "jaccard")


def fix_words(commits: DataFrame, *, first: int = 200, top: int = 8, more_than: int = 20) -> DataFrame:
    """word, n: the commonest words of the newest usable commits' subjects, to suggest a pattern for fixes.

    Only where no commit is a fix and there are more than `more_than` of them; else there are no rows.
    """
    all_ = commits.agg(((F.count("*") > more_than) & (F.coalesce(F.sum(F.col("is_fix").cast("int")), F.lit(0)) == 0)).alias("asked"))
    newest = commits.orderBy(F.desc("ts"), F.desc("commit_id")).limit(first).crossJoin(F.broadcast(all_)).where("asked")
    words = newest.select(F.explode(message_words(F.col("subject"), "a-z")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
