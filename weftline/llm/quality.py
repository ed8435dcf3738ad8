"""Quality rules with risk-controlled thresholds: cutoffs whose rate of wrongly rejected documents is certified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, text_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RiskRules:
    """How much risk is allowed, and which cutoffs are tried.

    alpha: at most this share of good documents of a stratum may be rejected; delta: the chance that any stratum
    breaks that, over all strata and cutoffs (Bonferroni). scales: the value of each feature that gives a junk score
    of 1; a document's score is its largest feature over its scale. grid: cutoffs of that score. A cutoff is certified
    if P(Binomial(n, alpha) <= k) <= delta / tests for the k of n good holdout documents that it rejects, which is
    the exact (Clopper-Pearson) upper bound being at most alpha. Of the certified ones the tuning half chooses: the
    most junk rejected, less `price` times the share of good documents, the higher cutoff on ties.
    """

    alpha: float = 0.02
    delta: float = 0.05
    price: float = 10.0
    grid: tuple[float, ...] = tuple(round(0.3 + 0.1 * i, 1) for i in range(18))
    scales: tuple[tuple[str, float], ...] = (
        ("symbol_ratio", 0.08),
        ("upper_ratio", 0.4),
        ("shout_ratio", 0.5),
        ("dup_line_ratio", 0.5),
        ("repeat_ratio", 0.25),
        ("word_length", 25.0),
    )


def with_repeats(df: DataFrame, words: str, out: str, size: int = 5) -> DataFrame:
    """df with `out` (long): words in windows of `size` words that the array `words` holds twice or more, first included.

    Every step is an array function of the row: hashes of words, hashes of windows, and only where those aren't
    distinct a sort of (hash, position). With p the sorted positions of windows found again, the words covered are the
    sum of least(size, distance to the next p), the last one counting in full.
    """
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    later = ", ".join(f"__h[i + {k}]" for k in range(1, size))
    df = df.withColumn("__w", F.expr(f"CASE WHEN size(__h) > {size} THEN transform(slice(__h, 1, size(__h) - {size - 1}), (x, i) -> xxhash64(x, {later})) ELSE array() END"))
    df = df.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__w)) < size(__w) THEN sort_array(transform(__w, (x, i) -> struct(x AS x, i AS i))) ELSE array() END"))
    df = df.withColumn("__p", F.expr("sort_array(transform(filter(__s, (s, k) -> (k > 0 AND __s[k - 1].x = s.x) OR (k < size(__s) - 1 AND __s[k + 1].x = s.x)), s -> s.i))"))
    covered = F.expr(f"CAST(aggregate(transform(__p, (p, k) -> CASE WHEN k = size(__p) - 1 THEN {size} ELSE least({size}, __p[k + 1] - p) END), 0, (a, x) -> a + x) AS bigint)")
    return df.withColumn(out, F.when(F.size("__p") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("__h", "__w", "__s", "__p")


def features(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """A row for each document: key, stratum, text_hash, the counts, and the features of RiskRules. Null texts have no words."""
    df = docs.select(F.col(key).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), text_of(text).alias("__t"))
    df = df.withColumn("__words", F.regexp_extract_all("__t", F.lit(WORD_PATTERN), F.lit(0)))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD_PATTERN)))
    df = df.select(
        "doc_id",
        "stratum",
        F.xxhash64("__t").alias("text_hash"),
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        F.char_length(F.regexp_replace("__t", r"\P{Lu}+", "")).alias("__upper"),
        (F.char_length("__t") - F.char_length(F.translate("__t", "!", ""))).alias("__shouts"),
        "__words",
    )
    df = with_repeats(df, "__words", "n_repeat_words").drop("__words")
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.select(
        "doc_id",
        "stratum",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        over("n_symbols", "word_chars").alias("symbol_ratio"),
        over("__upper", "word_chars").alias("upper_ratio"),
        over("__shouts", "n_words").alias("shout_ratio"),
        over("n_dup_lines", "__n_lines").alias("dup_line_ratio"),
        over("n_repeat_words", "n_words").alias("repeat_ratio"),
        over("word_chars", "n_words").alias("word_length"),
    )


def _log_factorial(n: str) -> str:
    """ln n! in SQL by Stirling's series at n + 9, exact to about 1e-13."""
    x = f"(double({n}) + 9)"
    series = f"({x} - 0.5) * ln({x}) - {x} + 0.9189385332046727418 + 1 / (12 * {x}) - 1 / (360 * power({x}, 3)) + 1 / (1260 * power({x}, 5)) - 1 / (1680 * power({x}, 7))"
    return f"({series} - ln({' * '.join(f'(double({n}) + {i})' for i in range(1, 9))}))"


def binomial_tail(k: str, n: str, alpha: float) -> str:
    """SQL of P(Binomial(n, alpha) <= k).

    From k down terms fall at least geometrically when k is under the mean; those more than 12 deviations and 60
    below add nothing to a double. From the mean up the probability is too large to certify anything: it is 1.
    """
    term = f"exp({_log_factorial(n)} - {_log_factorial('j')} - {_log_factorial(f'({n} - j)')} + j * ln(double({alpha})) + ({n} - j) * ln(1 - double({alpha})))"
    low = f"greatest(0, {k} - 60 - CAST(12 * sqrt({n} * double({alpha})) AS bigint))"
    return f"CASE WHEN {k} >= {n} * double({alpha}) THEN 1D ELSE aggregate(transform(sequence(CAST({low} AS bigint), CAST({k} AS bigint)), j -> {term}), 0D, (a, x) -> a + x) END"


def certified_cutoffs(scored: DataFrame, labels: DataFrame, rules: RiskRules) -> DataFrame:
    """stratum, cutoff of each stratum that has a certified one; scored: doc_id, stratum, text_hash, base_failed, junk_score.

    Copies aren't draws of their own: a text counts once in a stratum, as good if any of its labelled copies is. The
    distinct texts split by a hash of the text into a tuning and a holdout half. Only counts by stratum leave that step;
    their rows are strata x cutoffs.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).where("quality is not null").groupBy("__id").agg(F.max("quality").alias("quality"))
    both = scored.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("__id"))
    both = both.groupBy("stratum", "text_hash").agg(F.max("quality").alias("quality"), F.max("junk_score").alias("junk_score"))
    hold = F.pmod(F.xxhash64("text_hash", F.lit("holdout")), F.lit(2)) == 0
    good = F.col("quality") == 1
    tally = [F.count_if(hold & good).alias("n"), F.count_if(~hold & good).alias("tune_good"), F.count_if(~hold & ~good).alias("tune_bad")]
    for i, c in enumerate(rules.grid):
        over = F.col("junk_score") > c
        tally += [F.count_if(hold & good & over).alias(f"k{i}"), F.count_if(~hold & good & over).alias(f"g{i}"), F.count_if(~hold & ~good & over).alias(f"b{i}")]
    cuts = F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"g{i}").alias("g"), F.col(f"b{i}").alias("b")) for i, c in enumerate(rules.grid)]))
    by = both.groupBy("stratum").agg(*tally)
    tests = by.agg((F.count("*") * len(rules.grid)).alias("tests"))
    rows = by.select("stratum", "n", "tune_good", "tune_bad", cuts.alias("c")).select("stratum", "n", "tune_good", "tune_bad", "c.*").join(F.broadcast(tests))  # one row
    rows = rows.where("n > 0").withColumn("p", F.expr(binomial_tail("k", "n", rules.alpha))).where(F.col("p") <= rules.delta / F.col("tests"))
    gain = F.col("b") / F.greatest("tune_bad", F.lit(1)) - rules.price * F.col("g") / F.greatest("tune_good", F.lit(1))
    return rows.groupBy("stratum").agg(F.max(F.struct(gain.alias("gain"), F.col("cutoff"))).alias("best")).select("stratum", "best.cutoff")


def judge_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", rules: RiskRules | None = None) -> DataFrame:
    """key's row with its stratum, text_hash, counts, features, base_failed, junk_score, cutoff and kept.

    kept is false if base_failed or if the score is over the stratum's certified cutoff. A stratum without one (no
    labels, or too few to certify any) rejects nothing beyond the base rule; null is a stratum too. Null and empty
    texts have no words and so fail the base rule. Repeated rows are judged each, alike; repeated labels of a document
    count once, as good if any is. Features are computed once and kept in the shared folder: they, not the texts, move.
    """
    rules = rules or RiskRules()
    scored = features(docs, key=key, text=text, stratum=stratum)
    scored = cut(scored.withColumn("junk_score", F.greatest(*[F.col(f) / s for f, s in rules.scales])))
    cutoffs = certified_cutoffs(scored, labels, rules).select(F.col("stratum").alias("__s"), "cutoff")
    out = scored.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__s")), "left").drop("__s")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("junk_score") <= F.col("cutoff"), F.lit(True))).withColumnRenamed("doc_id", key)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of judge_quality."""
    judged = judge_quality(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "junk_score", "cutoff")
