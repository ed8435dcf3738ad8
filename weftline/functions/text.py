"""Identifiers, trigrams, lines and similarities of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about what a range is about. Fixed values.
KEYWORDS = (
    "fn", "let", "mut", "pub", "use", "mod", "self", "Self", "super", "crate", "struct", "enum", "impl", "trait", "where", "as", "in", "if", "else",
    "match", "for", "while", "loop", "return", "break", "continue", "true", "false", "None", "Some", "Ok", "Err", "Result", "Option", "String",
    "str", "usize", "isize", "u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "bool", "Vec", "Box", "Arc", "Rc", "PathBuf", "Path", "HashMap",
    "HashSet", "BTreeMap", "and", "or", "not", "await", "async", "dyn", "ref", "static", "const", "echo", "set", "done", "then", "esac", "case",
    "function", "var", "this", "new", "class", "export", "import", "from", "default", "extends", "implements", "interface", "type", "void", "null",
    "undefined", "number", "string", "boolean", "object", "any", "http", "https", "com", "org", "www", "TODO", "FIXME", "XXX", "NOTE", "the", "with",
    "when", "that", "into", "has", "have", "are", "was", "were", "been", "being",
)


def identifiers(text: Column) -> Column:
    """Sorted distinct identifiers of three characters or more, without KEYWORDS."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, KEYWORDS))))


def trigrams(tokens: Column) -> Column:
    """Distinct runs of three characters of the tokens joined by spaces."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(tokens, " "), F.lit("(?s)(?=(...))"), F.lit(1)))


def lines_raw(text: Column) -> Column:
    """Pieces between line feeds, an empty last one too."""
    return F.split(text, "\n", -1)


def lines_trimmed(text: Column) -> Column:
    """Lines without carriage returns at their ends, and without an empty last one."""
    pieces = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, as far as there are any."""
    stop = F.least(end, F.size(lines).cast("bigint"))
    return F.slice(lines, start.cast("int"), F.greatest(F.lit(0), stop - start + 1).cast("int"))


def lines_equal(a: Column, b: Column, ignore_space: bool = False) -> Column:
    if not ignore_space:
        return a == b
    bare = lambda x: F.transform(x, lambda s: F.regexp_replace(s, r"\s+", ""))
    return bare(a) == bare(b)


def without_returns(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def is_binary(content: Column) -> Column:
    """A NUL among the first 8 KiB."""
    return F.instr(F.substr(content, F.lit(1), F.lit(8192)), "\0") > 0


def multiset_jaccard(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity for pairs (a, b) of documents: sum of smaller counts over sum of larger ones of their lines.

    lines: doc, line. Of two documents without lines it is 0. Only common lines meet: the larger counts add up to both
    totals less what is common.
    """
    counts = lines.groupBy("doc", "line").agg(F.count("*").alias("n"))
    total = counts.groupBy("doc").agg(F.sum("n").alias("total"))
    side = lambda x: counts.select(F.col("doc").alias(x), "line", F.col("n").alias(f"n_{x}"))
    common = pairs.join(side("a"), "a").join(side("b"), ["b", "line"]).groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    out = pairs.join(common, ["a", "b"], "left")
    for x in ("a", "b"):
        out = out.join(total.select(F.col("doc").alias(x), F.col("total").alias(f"t_{x}")), x, "left")
    c, t = F.coalesce("common", F.lit(0)), F.coalesce("t_a", F.lit(0)) + F.coalesce("t_b", F.lit(0))
    return out.select("a", "b", F.when(t == 0, 0.0).otherwise(c / F.nullif(t - c, F.lit(0))).alias("similarity"))
