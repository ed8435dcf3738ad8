"""N-gram Jaccard self-join by T-occurrence search, and the components of its links."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, begin, stored, text_of
from .components import components

_MULTIPLIERS = [np.uint64(int.from_bytes(xxhash.xxh3_64_digest(f"shingle {i}")) | 1) for i in range(64)]
_S32, _S29 = np.uint64(32), np.uint64(29)


@dataclass(frozen=True)
class Overlap:
    """words: in a shingle. percent: texts link when 100 * intersection >= percent * union. block, group: documents searched
    together, at first and for the links left. postings: shingles searched together, which bounds a task's memory where texts are long; a larger set is
    a part of its own. broadcast: so many ids at most are sent to all executors; more are met by a shuffle.
    """

    words: int = 4
    percent: int = 85
    block: int = 128
    group: int = 256
    postings: int = 200_000
    broadcast: int = 1_000_000

    def needed(self, n: int) -> int:
        """What any partner of a set of n shares with it at least."""
        return -(-self.percent * n // 100)

    def pair_needed(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))


@lru_cache(8)
def levels(percent: int, largest: int = 1 << 40) -> list[int]:
    """The smallest size of each level: sets that link are of one level or of two that follow each other."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent), out[-1] * 8 // 5))
    return out


def spare(percent: int, level: int) -> tuple[int, int]:
    """How many hashes sets of a level and their partners differ in at most, and how many equal ranges more than one are asked for."""
    most = (100 - percent) * 2 * (levels(percent)[level + 1] - 1) // (100 + percent)
    return most, most // 4


@lru_cache(1024)
def edges(percent: int, level: int) -> np.ndarray:
    """Edges of the ranges that the hashes are cut into for sets of a level: some more than the largest ones need."""
    count = sum(spare(percent, level)) * 9 // 8 + 3
    return np.array([(i << 64) // count for i in range(1, count)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S32)
    h = h * _MULTIPLIERS[0]
    return h ^ (h >> _S29)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `size` words, A-Z in lower case; of all words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = h[:n] * _MULTIPLIERS[1]
    for i in range(1, size):
        total = total + h[i : i + n] * _MULTIPLIERS[1 + i]
    return np.unique(_mixed(total))


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Hashes of some ranges of the sorted hashes s, cut as for its own level and, if it has larger partners there, the next.

    A set that differs from its partners of a level in `most` hashes at most gives its first most + 1 + more ranges that
    aren't empty, and where there are fewer all ranges. Of two sets that link, take the one whose ranges end first: in
    1 + more of them at least the other is equal, and gives them too. So sets that link have 1 + more signatures of a
    level in common. The last bit of a signature is that of its level; the list has `more` by that bit.
    """
    n, sizes = len(s), levels(percent)
    level, widest = bisect_right(sizes, n) - 1, 100 * n // percent
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s * _MULTIPLIERS[9]), dtype=np.uint64)])
    out, mores = [np.empty(0, np.uint64)], [0, 0]
    for at in (level, level + 1):
        most = (100 - percent) * (n + min(widest, sizes[at + 1] - 1)) // (100 + percent)
        if not most or at > level and widest < sizes[at]:
            continue
        more = mores[at & 1] = spare(percent, at)[1]
        cuts = edges(percent, at)
        bounds = np.concatenate([[0], np.searchsorted(s, cuts), [n]])
        places = np.flatnonzero(bounds[1:] > bounds[:-1])[: most + 1 + more]
        if len(places) <= most + more:
            places = np.arange(len(cuts) + 1)
        sums = total[bounds[places + 1]] - total[bounds[places]]
        own = _mixed(sums * _MULTIPLIERS[10] + (places.astype(np.uint64) + np.uint64(at << 40)) * _MULTIPLIERS[11])
        out.append(own >> np.uint64(1) << np.uint64(1) | np.uint64(at & 1))
    return np.concatenate(out), mores


class DivideSkip:
    """T-occurrence search over the inverted lists of some sets.

    Of a query's lists the longest are set aside, needed - 1 at most; a heap merges the others, and a document
    met there often enough to reach `needed` with all long lists is looked up in those by binary search.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(tokens, kind="stable")
        self.docs = np.repeat(np.arange(len(sets)), self.sizes)[order]
        new = np.concatenate([[True], np.diff(tokens[order]) != 0])[: len(tokens)]
        self.starts = np.append(np.flatnonzero(new), len(tokens))
        self.lengths = np.diff(self.starts)
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.cumsum(new) - 1
        self.ranks = np.split(rank, np.cumsum(self.sizes)[:-1])
        self.lists: dict[int, list[int]] = {}

    def list(self, rank: int) -> list[int]:
        if (found := self.lists.get(rank)) is None:
            found = self.lists[rank] = self.docs[self.starts[rank] : self.starts[rank + 1]].tolist()
        return found

    def search(self, i: int, rules: Overlap, root: list[int], asks: list[bool] | None = None) -> Iterator[int]:
        """The sets that link with set i, but for those that have its root by the time they are met, and later ones that ask."""
        n = self.sizes[i]
        needed = rules.needed(n)
        lengths = self.lengths[self.ranks[i]]
        several = self.ranks[i][lengths > 1]
        if not n or len(several) < needed:
            return
        lists = several[np.argsort(lengths[lengths > 1], kind="stable")].tolist()
        split = len(lists) - (needed - 1)
        short, long = lists[:split], lists[split:]
        at, met = -1, 0
        for j in (*heapq.merge(*map(self.list, short)), -1):
            if j == at:
                met += 1
                continue
            if at >= 0 and root[at] != root[i] and (at < i or asks and not asks[at]) and rules.needed(max(n, self.sizes[at])) <= min(n, self.sizes[at]):
                least = rules.pair_needed(n, self.sizes[at])
                left = len(long)
                for rank in long:
                    if met + left < least or met >= least:
                        break
                    probed = self.list(rank)
                    k = bisect_left(probed, at)
                    met += k < len(probed) and probed[k] == at
                    left -= 1
                if met >= least:
                    yield at
            at, met = j, 1


def forest(sets: list[np.ndarray], rules: Overlap, roots: list | None = None, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets' components: a set in a component with another isn't compared with it again.

    roots: what sets joined before have in common. asks: the sets that search; links between the others aren't looked for.
    """
    index, known = DivideSkip(sets), {}
    root = [known.setdefault(r, i) for i, r in enumerate(roots)] if roots else [*range(len(sets))]
    members: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        members.setdefault(r, []).append(i)
    out = []
    for i in range(len(sets)):
        if asks and not asks[i] or len(members) == 1:
            continue
        for j in index.search(i, rules, root, asks):
            a, b = sorted((root[i], root[j]), key=lambda r: -len(members[r]))
            for x in members[b]:
                root[x] = a
            members[a] += members.pop(b)
            out.append((i, j))
    return out


def profiles(docs: DataFrame, rules: Overlap) -> DataFrame:
    """doc, n (size of its set), a 128-bit mark of the set, and its signatures with more0 and more1 (see signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t, rules.words) for t in part.column(1).to_pylist()]
                marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                found = [signatures(s, rules.percent) if len(s) else (s, [0, 0]) for s in sets]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(x) for x, _ in found], out=offsets[1:])
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for x, _ in found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), *(pa.array([m[k] for _, m in found], pa.int32()) for k in (0, 1)), listed],
                    names=["doc", "n", "mark", "more0", "more1", "signs"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, n bigint, mark binary, more0 int, more1 int, signs array<bigint>")


def shingle_sets(docs: DataFrame, rules: Overlap) -> DataFrame:
    """doc, `hashes` (little-endian unsigned 64-bit, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, rules.words).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["doc", "hashes"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, hashes binary")


def _searched(rows: DataFrame, rules: Overlap) -> DataFrame:
    """a, b: links found in each block; rows: b0, b1, b2 (the block), doc, root, asks, hub, hashes. Hubs are met first."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, roots, asks, hubs, codes = (table.column(c).to_pylist() for c in ("doc", "root", "asks", "hub", "hashes"))
        order = sorted(range(len(ids)), key=lambda i: (not hubs[i], ids[i]))
        pairs = forest([np.frombuffer(codes[i], np.uint64) for i in order], rules, [roots[i] for i in order], [asks[i] for i in order])
        kind = table.schema.field("doc").type
        return pa.table({c: pa.array([ids[order[p[k]]] for p in pairs], kind) for k, c in enumerate("ab")})

    return rows.groupBy("b0", "b1", "b2").applyInArrow(run, f"a {kind}, b {kind}")


def _rarest(rows: DataFrame, twofold: DataFrame) -> DataFrame:
    """sign, doc, n, count, widest: of each document's signatures of a level all but the `more` most common ones.

    Documents that link have 1 + more signatures in common, so in the order from rare to common one of them is left
    to both; a document with no more than `more` that others have links with nobody. Ids of several texts (twofold)
    keep all, as their levels can't be told apart.
    """
    several = rows.groupBy("sign").agg(F.count("*").alias("count")).where("count > 1")
    rows = rows.join(several.hint("merge"), "sign").join(twofold.withColumn("all", F.lit(True)), "doc", "left")
    bit = F.col("sign").bitwiseAND(F.lit(1))
    place = F.row_number().over(Window.partitionBy("doc", bit).orderBy(F.desc("count"), F.desc("sign")))
    rows = rows.withColumn("place", place).where(F.coalesce("all", F.lit(False)) | (F.col("place") > F.when(bit == 0, F.col("more0")).otherwise(F.col("more1"))))
    rows = rows.select("sign", "doc", "n")
    left = rows.groupBy("sign").agg(F.count("*").alias("count"), F.max("n").alias("widest")).where("count > 1")
    return rows.join(left.hint("merge"), "sign")


def _parts(count: Column, widest: Column, block: int, rules: Overlap) -> Column:
    each = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(rules.postings) / widest)))
    return F.ceil(count / each).cast("long")


def _likely(entries: DataFrame, sets: DataFrame, rules: Overlap, own: Scratch, hubs: int = 8) -> DataFrame:
    """Links that most groups of copies hang together by: each document is searched with others of its most common signature.

    Copies of one original may each link with it and not with each other, so every part of a signature also gets
    `hubs` of its documents, those with the largest share of signatures that others have; the best of each of so many
    salts, found by partial aggregation.
    """
    ranked = own.keep(entries.groupBy("doc").agg((F.sum(F.log2("count")) / F.max("n")).alias("score"), F.max(F.struct("count", "sign", "widest")).alias("top")))
    parts = _parts(F.col("top.count"), F.col("top.widest"), rules.block, rules)
    dealt = ranked.select("doc", F.col("top.sign").alias("b0"), F.pmod(F.xxhash64("doc"), parts).alias("b1"), F.lit(False).alias("hub"))
    used = ranked.select(F.col("top.sign").alias("sign"), parts.alias("parts")).distinct()
    salted = entries.join(used, "sign").join(ranked.select("doc", "score"), "doc")
    best = salted.groupBy("sign", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(hubs)).alias("salt")).agg(F.max(F.struct("score", "doc")).alias("h"), F.max("parts").alias("parts"))
    everywhere = best.select(F.col("h.doc").alias("doc"), F.col("sign").alias("b0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("b1"), F.lit(True).alias("hub"))
    rows = dealt.union(everywhere).groupBy("doc", "b0", "b1").agg(F.max("hub").alias("hub"))
    rows = rows.select("doc", "b0", "b1", F.lit(0).cast("long").alias("b2"), F.col("doc").alias("root"), F.lit(True).alias("asks"), "hub")
    return own.keep(_searched(rows.join(sets.hint("merge"), "doc"), rules))


def _sized(rows: DataFrame, rules: Overlap) -> DataFrame:
    """Of each group (rows: group, doc, root, widest) with several roots: main (its most common root), the number of parts
    of all its documents and of those outside main, rows that a search of these against all takes, and x, y, count,
    which tell groups of the same documents."""
    of = rows.groupBy("group", "root").agg(F.count("*").alias("n"), F.max("widest").alias("widest"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    of = of.groupBy("group").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("count"), F.max("widest").alias("widest"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    asked = F.col("count") - F.col("main.n")
    of = of.where("roots > 1").withColumn("p", _parts(F.col("count"), F.col("widest"), rules.group, rules)).withColumn("q", _parts(asked, F.col("widest"), rules.group, rules))
    return of.select("group", F.col("main.root").alias("main"), "p", "q", (F.col("count") * F.col("q") + asked * F.col("p")).alias("cost"), "x", "y", "count")


def _remaining(entries: DataFrame, sets: DataFrame, links: DataFrame, rules: Overlap, own: Scratch) -> DataFrame:
    """The links that are left: wherever documents of different components have a signature in common, they are searched.

    In each group the documents outside its largest component are the queries against all of them, both in parts of
    bounded size. Of signatures with the same documents one is enough. Documents that share several signatures
    with the first of each make a cluster; where that takes fewer rows, it is the group instead of all signatures that
    only it has.
    """
    label = components(links, own.folder).select(F.col("node").alias("doc"), F.col("component").alias("root"))
    placed = entries.select("sign", "doc", "widest").distinct().join(label, "doc", "left").select("sign", "doc", "widest", F.coalesce("root", "doc").alias("root"))
    several = placed.groupBy("sign").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("doc").alias("first")).where("lo <> hi").select("sign", "first")
    placed = own.keep(placed.join(several, "sign"))
    pairs = placed.where("doc <> first").groupBy("doc", "first").agg(F.count("*").alias("n")).where("n > 1")
    home = components(pairs.select(F.col("doc").alias("a"), F.col("first").alias("b")), own.folder).select(F.col("node").alias("doc"), F.xxhash64("component").alias("home"))
    placed = own.keep(placed.join(home, "doc", "left").select(F.col("sign").alias("group"), "doc", "root", "widest", F.coalesce("home", F.xxhash64("doc")).alias("home")))
    clusters = placed.groupBy(F.col("home").alias("group"), "doc", "root").agg(F.max("widest").alias("widest"))
    inner = placed.groupBy("group").agg(F.min("home").alias("home"), F.max("home").alias("other")).withColumn("inner", F.expr("home = other")).drop("other")
    signs = _sized(placed, rules).join(inner, "group")
    signs = signs.groupBy("x", "y", "count").agg(F.min_by(F.struct("group", "main", "p", "q", "cost", "home", "inner"), "group").alias("s")).select("s.*")
    signs = own.keep(signs)
    whole = own.keep(_sized(clusters, rules).join(signs.where("inner").groupBy(F.col("home").alias("group")).agg(F.sum("cost").alias("apart")), "group").where("cost <= apart"))
    rest = signs.join(whole.select(F.col("group").alias("home"), F.lit(True).alias("done")), "home", "left").where("NOT (inner AND coalesce(done, false))")
    facts = ["group", "main", "p", "q"]
    rows = placed.drop("home", "widest").join(rest.select(*facts), "group").unionByName(clusters.drop("widest").join(whole.select(*facts), "group"))
    rows = own.keep(rows)
    deal = lambda parts: F.pmod(F.xxhash64("doc"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    held = rows.select("doc", "root", F.col("group").alias("b0"), deal("p").alias("b1"), each("q").alias("b2"), F.lit(False).alias("asks"))
    asked = rows.where("root <> main").select("doc", "root", F.col("group").alias("b0"), each("p").alias("b1"), deal("q").alias("b2"), F.lit(True).alias("asks"))
    blocks = held.union(asked).groupBy("doc", "root", "b0", "b1", "b2").agg(F.max("asks").alias("asks"))
    return own.keep(_searched(blocks.withColumn("hub", F.lit(False)).join(sets.hint("merge"), "doc"), rules))


def near_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: Overlap | None = None) -> DataFrame:
    """key, n_shingles, component_id of each document: the smallest document reached by links, itself included.

    Null, empty and wordless texts have no shingles and link with nothing. Equal sets link through their smallest
    document, so copies are one search. Documents whose id is null are alone, without a component. Rows with the same
    id count as one document. Extra columns are ignored; an empty table gives no rows.

    Sets that link have a signature in common (see signatures), so the inverted lists are searched in blocks of
    documents with a common signature, every link by DivideSkip. Tables that grow with the corpus are met by shuffles at
    every size (the merge hints), so plans are the same for small inputs and large ones. The result is a table in the
    shared folder.
    """
    rules = rules or Overlap()
    given = docs.select(F.col(key).alias("doc"), text_of(text).alias("text"))
    with Scratch(docs.sparkSession) as own:
        profile = own.keep(profiles(given, rules))
        known = profile.where("mark is not null AND doc is not null")
        # one document stands for each set; a set's many copies are met in 16 salted parts
        several = known.groupBy("mark").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
        salted = several.select("mark", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        copies = known.select("doc", "mark", F.pmod(F.xxhash64("doc"), F.lit(16)).cast("int").alias("salt"))
        same = own.keep(copies.join(salted, ["mark", "salt"]).where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b")))
        # an id with several texts stays for its other sets
        twofold = own.keep(known.groupBy("doc").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("doc"))
        gone = own.keep(same.select(F.col("a").alias("doc")).distinct().join(twofold, "doc", "left_anti"))
        signs = known.select("doc", F.explode("signs").alias("sign"))
        shared = signs.groupBy("sign").count().where("count > 1").select("sign")
        met = own.keep(signs.join(shared.hint("shuffle_hash"), "sign"))
        sizes = own.keep(profile.select("doc", "n", "more0", "more1"))
        own.drop(profile)
        # now that the signatures of one set alone are gone, the copies go, and each signature gets its count
        each = sizes.groupBy("doc").agg(*[F.max(c).alias(c) for c in ("n", "more0", "more1")])
        firsts = own.keep(met.distinct().join(gone.hint("merge"), "doc", "left_anti").join(each.hint("merge"), "doc"))
        own.drop(met)
        entries = own.keep(_rarest(firsts, twofold))
        own.drop(firsts)
        ids = own.keep(entries.select("doc").distinct())
        asked = given.join(F.broadcast(ids) if ids.count() <= rules.broadcast else ids, "doc", "left_semi")
        sets = own.keep(shingle_sets(asked, rules))
        links = _likely(entries, sets, rules, own)
        links = links.union(_remaining(entries, sets, links, rules, own))
        found = components(links.union(same.select("a", "b")), own.folder)
        return stored(
            sizes.select("doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
        )
