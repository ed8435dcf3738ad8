"""Rendering of results as lines: tables, JSON, annotations, format strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Tokens of format strings: commits' first, then those that give a row for each anchor. Fixed values.
COMMIT_TOKENS = {"H": "commit_id", "h": "short_id", "an": "author", "ae": "email", "ad": "date", "ar": "age", "s": "subject"}
ANCHOR_TOKENS = {"p": "path", "r": "range", "P": "address", "a": "anchor_id"}


def formatted(rows: DataFrame, template: str) -> DataFrame:
    """line: a format string filled from the columns it names; %% and %n are a percent sign and a line feed.

    Without a token of anchors there is one row a commit. An unknown token is an error.
    """
    known = COMMIT_TOKENS | ANCHOR_TOKENS
    pieces, used, at = [], set(), 0
    for m in re.finditer(r"%(an|ae|ad|ar|.)", template):
        pieces.append(F.lit(template[at : m.start()]))
        if m[1] in ("%", "n"):
            pieces.append(F.lit("%" if m[1] == "%" else "\n"))
        elif m[1] in known:
            used.add(m[1])
            pieces.append(F.coalesce(F.col(known[m[1]]).cast("string"), F.lit("")))
        else:
            raise ValueError(f"unknown token %{m[1]}")
        at = m.end()
    line = F.concat(*pieces, F.lit(template[at:]))
    if used & {*ANCHOR_TOKENS}:
        return rows.select(line.alias("line"))
    return rows.select("commit_id", line.alias("line")).dropDuplicates(["commit_id"]).select("line")


def finding_lines(found: DataFrame) -> DataFrame:
    """status, layer (- without one), /ack, set, path, start and end by tabs."""
    ack = F.when(F.col("acknowledged"), "/ack").otherwise("")
    start, end = (F.when(F.col("whole"), "0").otherwise(F.col(c).cast("string")) for c in ("start", "end"))
    return found.select(F.concat_ws("\t", F.upper("status"), F.concat(F.coalesce("source", F.lit("-")), ack), "set_name", "path", start, end).alias("line"))


def finding_json(found: DataFrame, *columns: str) -> DataFrame:
    """One document: the version and every finding, ordered within its set; a row for each set, so none is the whole result."""
    item = F.struct(*columns)
    return found.groupBy("set_name").agg(F.to_json(F.struct(F.lit(2).alias("v"), F.first("set_name").alias("set"), F.sort_array(F.collect_list(item)).alias("findings"))).alias("line"))


def annotation(found: DataFrame) -> DataFrame:
    """A line for each finding that a build shows at its file: moved ones warn, others fail."""
    level = F.when(F.col("status") == "Moved", "warning").otherwise("error")
    place = F.when(F.col("whole"), "").otherwise(F.concat(F.lit(",line="), F.col("start").cast("string"), F.lit(",endLine="), F.col("end").cast("string")))
    return found.select(F.concat(F.lit("::"), level, F.lit(" file="), F.col("path"), place, F.lit("::"), F.col("set_name"), F.lit(": "), F.lower("status")).alias("line"))


def _xml(c: str) -> Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def junit(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit('<testcase classname="'), _xml("set_name"), F.lit('" name="'), _xml("path"), F.lit('"><failure type="'), F.lower("status"), F.lit('"/></testcase>')).alias("line"))


def deepest(found: DataFrame) -> DataFrame:
    """The finding of the deepest layer of each anchor: worktree, index, head."""
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("W", 3, "I", 2, "H", 1)]), F.coalesce("source", F.lit("H")))
    row = F.struct(*[c for c in found.columns if c != "anchor_id"])
    return found.groupBy("anchor_id").agg(F.max_by(row, rank).alias("r")).select("anchor_id", "r.*")


def set_blocks(sets: DataFrame, anchors: DataFrame) -> DataFrame:
    """set_name, block: a heading, the reason, and a bullet for each anchor in order."""
    bullet = F.concat(F.lit("- "), paths.address(F.col("path"), F.col("start"), F.col("end"), F.col("whole")))
    row = F.struct("path", F.coalesce("start", F.lit(0)).alias("s"), F.coalesce("end", F.lit(0)).alias("e"), bullet.alias("b"))
    by = anchors.groupBy("set_name").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["b"]).alias("bullets"))
    return sets.join(by, sets["name"] == by["set_name"]).select("set_name", F.concat_ws("\n", F.concat(F.lit("## "), F.col("set_name")), "message", F.array_join("bullets", "\n")).alias("block"))


def failing(found: DataFrame, *, ignore_unavailable: bool = False) -> DataFrame:
    """One row: how many findings count against an exit code of 0."""
    counted = ~F.col("acknowledged") & ~F.coalesce(F.col("followed"), F.lit(False))
    if ignore_unavailable:
        counted = counted & (F.col("status") != "ContentUnavailable")
    return found.agg(F.count_if(counted).alias("failing"))


def trace(rows: DataFrame, path: str) -> None:
    """The trace as CSV with a header, its columns in a stable order."""
    rows.select("set_name", "anchor_id", "anchor_sha", "path", "wall_us", "fast_path", "status").write.mode("overwrite").option("header", True).csv(path)


def suggestion_json(shown: DataFrame) -> DataFrame:
    """sid, line: suggestions as JSON, the version first."""
    return shown.select("sid", F.to_json(F.struct(F.lit(1).alias("v"), "band", "viability", F.struct("composite", "density", "edge_score", "trigram").alias("score"), "participants", F.sha2(F.col("key"), 256).alias("label"))).alias("line"))
