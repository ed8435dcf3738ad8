"""Line dedup: repeated runs of lines found by distributed prefix doubling; later copies are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, begin, stored, text_of


def _blocks(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the lines of the shortest run with `least` words that begins, and that ends, with it (0: none)."""
    total = np.concatenate([[0], np.cumsum(words)])
    ahead = np.searchsorted(total, total[:-1] + least)
    begins = np.where(ahead < len(total), ahead - np.arange(len(words)), 0)
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    ends = np.where(back >= 0, np.arange(1, len(words) + 1) - back, 0)
    return begins, ends


def _mark(text: str, named: bool) -> int:
    """A hash of the text, another one for rows without an id."""
    return xxhash.xxh3_64_intdigest(text, seed=0 if named else 1) - 2**63


def line_table(docs: DataFrame, least_words: int) -> DataFrame:
    """doc, text_hash, position among the lines with a word, 128-bit line id, and the lengths of _blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("linededup")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, hashes, places, ids, begins, ends = [], [], [], [], [], []
                for i, (text, named) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    counted = [(x, n) for x in text.encode("utf-8", "surrogatepass").split(b"\n") if (n := len(x.split()))]
                    lines, words = [x for x, _ in counted], np.array([n for _, n in counted], np.int64)
                    if int(words.sum()) < least_words:
                        continue
                    a, z = _blocks(words, least_words)
                    own = _mark(text, named)
                    rows += [i] * len(lines)
                    hashes += [own] * len(lines)
                    places += range(len(lines))
                    ids += [xxhash.xxh3_128_digest(x) for x in lines]
                    begins += a.tolist()
                    ends += z.tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.binary()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                    names=["doc", "text_hash", "at", "line", "begins", "ends"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, text_hash bigint, at int, line binary, begins int, ends int")


def _ranked(rows: DataFrame, keys: list[str], name: str, own: Scratch) -> DataFrame:
    """The keys that several rows have, with a number that grows in the order of the keys.

    Counts are summed before the shuffle, and a range sort deals out distinct keys, so a frequent one is one row.
    """
    several = rows.groupBy(*keys).count().where("count > 1").drop("count")
    return own.keep(several.sort(*keys).withColumn(name, F.monotonically_increasing_id()))


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """doc, text_hash, `deleted`: sorted positions (among lines with a word) that lie in a later copy of a repeated run.

    Lines are the pieces between line feeds; those without a word are passed over. Ranks of runs of 1, 2, 4, ... lines
    come from prefix doubling: the rank of 2k lines is the place of the pair (rank of the first k, rank of the next k)
    in sorted order, so equal runs, an interval of the suffix array with a common prefix of 2k lines, share a rank; runs
    found once leave. A run of m lines is then named by the two ranks that cover it. A maximal repeated run of at least
    least_words words is the union of the shortest such runs beginning or ending at its lines; hence those, at most
    least_words lines long, tell all deleted lines exactly and bound the number of rounds. The first copy by
    (document id, position) stays. Rows with the same id and text count as one document.
    So do rows without an id and with the same text, in the order as if their id were 0. Texts of fewer than least_words
    words hold no such run and stay as they are, whole copies too. The result is a table in the shared folder.
    """
    with Scratch(docs.sparkSession) as own:
        return _repeated(docs.select(_id(docs, key).alias("doc"), text_of(text).alias("text"), F.col(key).isNotNull().alias("named")), least_words, own)


def _id(docs: DataFrame, key: str) -> Column:
    return F.coalesce(F.col(key), F.lit(0).cast(docs.schema[key].dataType))


def _repeated(given: DataFrame, least_words: int, own: Scratch) -> DataFrame:
    lines = line_table(given, least_words)
    lines = lines.groupBy("doc", "text_hash", "at").agg(F.first("line").alias("line"), F.first("begins").alias("begins"), F.first("ends").alias("ends"))
    lines = own.keep(lines)
    here = Window.partitionBy("doc", "text_hash").orderBy("at")
    active = lines.join(_ranked(lines, ["line"], "r0", own).hint("merge"), "line").drop("line")
    longest = active.agg(F.greatest(F.max("begins"), F.max("ends"))).first()[0] or 0
    k, level = 1, 0
    while 2 * k <= longest:
        # the rank k lines on, if all lines between are there and repeated
        shifted = active.select("doc", "text_hash", (F.col("at") - k).alias("at"), F.col(f"r{level}").alias("next"))
        active = own.keep(active.join(shifted, ["doc", "text_hash", "at"], "left"))
        pairs = _ranked(active.where("next is not null"), [f"r{level}", "next"], f"r{level + 1}", own)
        active = active.join(pairs.hint("merge"), [f"r{level}", "next"], "left").drop("next")
        k, level = 2 * k, level + 1
    active = own.keep(active)

    def power(m: str) -> Column:
        return F.floor(F.log2(F.col(m).cast("double") + 0.5)).cast("int")

    # what each run needs: the rank at its first line and at its last 2^level lines
    need = active.select("doc", "text_hash", F.explode(F.array(F.struct(F.col("at").alias("first"), F.col("begins").alias("m")), F.struct((F.col("at") - F.col("ends") + 1).alias("first"), F.col("ends").alias("m")))).alias("run"))
    need = need.select("doc", "text_hash", "run.*").where("m > 0").distinct().withColumn("level", power("m"))
    ranks = active.select("doc", "text_hash", "at", F.array(*[f"r{i}" for i in range(level + 1)]).alias("ranks"))
    at = lambda place, name: ranks.select("doc", "text_hash", F.col("at").alias(place), F.col("ranks").alias(name))
    named = (
        need.withColumn("second", F.expr("first + m - shiftleft(1, level)"))
        .join(at("first", "a"), ["doc", "text_hash", "first"])
        .join(at("second", "z"), ["doc", "text_hash", "second"])
        .select("doc", "text_hash", "first", "m", F.expr("a[level]").alias("a"), F.expr("z[level]").alias("z"))
        .where("a is not null and z is not null")
    )
    named = own.keep(named)
    firsts = named.groupBy("m", "a", "z").agg(F.min(F.struct("doc", "text_hash", "first")).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a run with many copies is met in 16 salted parts
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc", "text_hash", "first"), F.lit(16)).cast("int"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    later = salted.join(firsts, ["m", "a", "z", "salt"]).where(F.struct("doc", "text_hash", "first") != F.col("original"))
    places = later.select("doc", "text_hash", F.explode(F.sequence("first", F.expr("first + m - 1"))).alias("at")).distinct()
    return stored(places.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list("at")).alias("deleted")))


#: What separates words, but for the line feed.
_SPACES = " \t\r\x0b\x0c"


def _without(text: str, gone: list[int]) -> str:
    """A line without a word goes with the last line before it that has one."""
    drop, kept, at, going = set(gone), [], 0, False
    for line in text.split("\n"):
        if line.strip(_SPACES):
            going = at in drop
            at += 1
        if not going:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text, and `deleted_lines` (long).

    A null text stays null, and every row stays: a document that is a later copy as a whole is left with an empty
    text. Repeated rows (same id and text) get the same text. An empty table gives no rows.
    """
    gone = repeated_lines(docs, key=key, text=text, least_words=least_words)
    schema = docs.drop("deleted_lines").schema
    names = schema.names

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("linededup")
        for b in batches:
            own = [_mark(t or "", k) for t, k in zip(b.column(names.index(text)).to_pylist(), b.column(names.index(key)).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*names, "__hash"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("linededup")
        for b in batches:
            columns, drops = [b.column(i) for i in range(len(names))], b.column(len(names)).to_pylist()
            texts = columns[names.index(text)].to_pylist()
            columns[names.index(text)] = pa.array([_without(t, d) if t and d else t for t, d in zip(texts, drops, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(d or ()) for d in drops], pa.int64())], names=[*names, "deleted_lines"])

    spelled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    keyed = docs.drop("deleted_lines").mapInArrow(hashes, spelled + ", __hash bigint")
    gone = gone.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__gone"), F.col("deleted").alias("__deleted"))
    # by a shuffle at every size: the table grows with the corpus
    joined = keyed.join(gone.hint("merge"), (_id(docs, key) == F.col("__doc")) & (F.col("__hash") == F.col("__gone")), "left")
    return joined.select(*names, "__deleted").mapInArrow(apply, spelled + ", deleted_lines bigint")


def dedup_report(docs: DataFrame) -> DataFrame:
    """Each document with its text after line dedup."""
    return dedup_lines(docs.select("doc_id", "text"))
