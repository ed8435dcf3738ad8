"""Best-two-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import begin, cut, done, text_of

#: Runs kept with their ids in a generation, two of which are held, and the longest run that is kept, in characters:
#: at some 200 bytes a run, a Python worker keeps 480 MB at most, until no task has used it for some seconds.
CACHE, LONGEST = 1_200_000, 64
#: Texts of a batch that are cut into runs together: as many as have this many bytes, or one.
PART = 4 << 20
#: Marks that make a pre-token of their own after a word. Fixed values.
MARKS = ".,!?;:*$%&#|"
#: White space of Unicode, and separators that only some take for white space.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Two white-space characters in a row, or one at either end, or a separator: there a text can't be cut at single spaces.
_UNEVEN = rf"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$|[\x1c-\x1f]"
#: Beyond this character a letter may be newer than the tokenizer's tables.
_SETTLED = "\u0530"


class Encoder:
    """Ids of a byte-level BPE file by the tokenizers library, with the ids of recent space-separated runs kept.

    Where a text has no two white-space characters in a row and none at its ends, its single spaces and line feeds
    are ends of pre-tokens, so what stands between is encoded by itself; other texts are encoded whole. Texts are cut
    and their ids joined in Arrow: a piece is a run after a space, or a line feed and the run after it. New words go
    to the library's model, other new runs to its whole pipeline, many at a time, a line feed between, whose id no run
    holds.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.space = self.letters[0x20]
        self.feed = self.raw(["\n"])[0]
        # ids of pieces; those of a run after a space begin with the space
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, runs: list[str]) -> list[bytes]:
        """Ids of runs without line feeds, none with white space at its end."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == np.frombuffer(self.feed, "<u4")[0])
        if len(self.feed) != 4 or len(ends) != len(runs) - 1:
            return self.raw(runs)
        code, edges = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
        return [code[4 * a + 4 : 4 * z] for a, z in zip(edges[:-1], edges[1:], strict=True)]

    def word(self, word: str) -> bytes:
        """Ids of a piece of letters, one pre-token but for the line feed before it."""
        head = word[0] == "\n"
        letters = word[1:] if head else word
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters if head else self.space + letters)]).tobytes()
        return self.feed + ids if head else ids

    def codes(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        known, older, marks = self.known, self.older, self.marks
        out = [*map(known.get, pieces)]
        rest: list[int] = []
        for i in [i for i, code in enumerate(out) if code is None]:
            piece = pieces[i]
            code = older.get(piece)
            if code is None:
                word = piece.rstrip(MARKS)
                letters = word[1:] if word[:1] == "\n" else word
                if not letters.isalpha() or not (letters.isascii() or max(letters) < _SETTLED):
                    rest.append(i)
                    continue
                code = known.get(word) or older.get(word) or self.word(word)
                if word != piece:
                    if len(word) <= LONGEST:
                        known[word] = code
                    mark = piece[len(word) :]
                    if mark not in marks:
                        if len(marks) >= 10_000:
                            marks.clear()
                        marks[mark] = self.raw([mark])[0]
                    code += marks[mark]
            out[i] = code
            if len(piece) <= LONGEST:
                known[piece] = code
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            heads = [pieces[i][0] == "\n" for i in part]
            for i, head, code in zip(part, heads, self.many([pieces[i][1:] if h else " " + pieces[i] for i, h in zip(part, heads, strict=True)]), strict=True):
                out[i] = self.feed + code if head else code
                if len(pieces[i]) <= LONGEST:
                    known[pieces[i]] = out[i]
        return out

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text, null being empty."""
        given = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        given = pc.fill_null(given, "")
        uneven = pc.match_substring_regex(given, _UNEVEN).to_numpy(zero_copy_only=False)
        filled = pc.binary_length(given).to_numpy(zero_copy_only=False) > 0
        out = [b""] * len(given)
        for i in np.flatnonzero(filled & uneven).tolist():
            out[i] = self.raw([given[i].as_py()])[0]
        rows = np.flatnonzero(filled & ~uneven)
        if len(rows):
            # "a b\nc" becomes "\na", "b", "\nc"
            lines = pc.replace_substring(given.take(pa.array(rows)), "\n", " \n")
            cuts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), lines, pa.scalar("", pa.large_string())), " ")
            pieces = cuts.values.dictionary_encode()
            joined = pa.array(self.codes(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
            ids = memoryview(joined.buffers()[2])
            ends = np.frombuffer(joined.buffers()[1], np.int64)[cuts.offsets.to_numpy()].tolist()
            lead = len(self.feed)
            for i, a, z in zip(rows.tolist(), ends[:-1], ends[1:], strict=True):
                out[i] = bytes(ids[a + lead : z])
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized_pieces(docs: DataFrame, path: str, limit: int = 2048, *, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids (little-endian unsigned 32-bit) of each document's pieces of at most `limit` tokens.

    A document is its ids and then the id `end`, so null and empty texts are one piece of one id. Only longer
    documents are cut; then the first piece is the short one. Repeated rows give their pieces each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing", encoder.cache_clear)
        try:
            yield from encoded(batches)
        finally:
            done()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(size // PART)) + 1).tolist(), b.num_rows]
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(at, to - at)
                rows: list[int] = []
                pieces, starts, lengths, codes = [], [], [], []
                for row, ids in enumerate(own.batch(part.column(1))):
                    ids += last
                    n = len(ids) // 4
                    cuts = [0, *range(n % limit or limit, n + 1, limit)]
                    for piece, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(a)
                        lengths.append(z - a)
                        codes.append(ids[4 * a : 4 * z])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(codes, pa.binary())],
                    names=["key", "piece", "start", "length", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("key", key)


def best_two_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many bins have just these), for so many documents of each length.

    A bin is filled greedily, always by the longest document that fits. Then its smallest document is taken out if two
    unpacked ones fill the gap it leaves more tightly; that repeats while it helps. As bins with the same lengths are
    made at once, as often as the documents allow, the work follows the number of lengths, not of documents.
    """
    left = Counter({k: n for k, n in counts.items() if n > 0})
    sizes, bins = sorted(left), []

    def fitting(gap: int, used: Counter) -> int:
        at = bisect_right(sizes, gap) - 1
        while at >= 0 and left[sizes[at]] <= used[sizes[at]]:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def pair(gap: int, used: Counter, above: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum over `above` and up to gap."""
        best, lo, hi = None, 0, bisect_right(sizes, gap) - 1
        while lo <= hi:
            total = sizes[lo] + sizes[hi]
            if total > gap:
                hi -= 1
                continue
            a, b = sizes[lo], sizes[hi]
            if total > above and left[a] - used[a] >= 1 + (a == b) and left[b] - used[b] >= 1 + (a == b):
                best, above = (a, b), total
                if total == gap:
                    return best
            lo += 1
        return best

    while sizes:
        used, made, gap = Counter(), [], limit
        while gap and (x := fitting(gap, used)):
            insort(made, x)
            used[x] += 1
            gap -= x
        while gap and len(made) > 1:
            x = made[0]
            used[x] -= 1
            found = pair(gap + x, used, x)
            if not found:
                used[x] += 1
                break
            made.pop(0)
            for y in found:
                insort(made, y)
                used[y] += 1
            gap = limit - sum(made)
        times = min(left[x] // n for x, n in used.items() if n)
        bins.append((tuple(reversed(made)), times))
        for x, n in used.items():
            left[x] -= n * times
            if n and not left[x]:
                del sizes[bisect_left(sizes, x)]
    return bins


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of documents, the bin that the first one goes to, and the place there."""
    taken: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = {}
    number = 0
    for lengths, times in bins:
        at = 0
        for x in lengths:
            out.setdefault(x, []).append((taken[x], number, at))
            taken[x] += times
            at += x
        number += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for x, runs in out.items()}


def pack(pieces: DataFrame, limit: int = 2048, *, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), salts: int = 64) -> DataFrame:
    """pieces with sequence_id and offset: where each goes, sequences of at most `limit` being filled by best-two-fit.

    The driver gets one count for each length and salt, at most limit x salts rows whatever the input, and plans the
    bins from them. Documents of a length are ranked within salted groups, so a common length is not one task. Pieces
    longer than limit or shorter than 1 are an error. The rows are read several times: give stored ones.
    """
    salted = pieces.drop("sequence_id", "offset").withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(F.col(length).alias("n"), "__salt").count().collect()
    if wrong := [r["n"] for r in counts if r["n"] is None or not 0 < r["n"] <= limit]:
        raise ValueError(f"lengths outside 1 to {limit}: {wrong[:5]}")
    total: Counter = Counter()
    first: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["n"], r["__salt"])):
        first[r["n"], r["__salt"]] = total[r["n"]]
        total[r["n"]] += r["count"]
    plan = places(best_two_fit(total, limit))
    local = F.row_number().over(Window.partitionBy(length, "__salt").orderBy(*order))
    ranked = salted.withColumn("__rank", local.cast("long") - 1)
    fields = ranked.schema
    names = [f.name for f in fields if f.name not in ("__salt", "__rank")]
    schema = ", ".join(f"`{n}` {fields[n].dataType.simpleString()}" for n in names) + ", sequence_id bigint, offset bigint"

    # all lengths' runs one after another, each length's places beginning where the last one's end, so that one search serves a batch
    ends = np.zeros(limit + 2, np.int64)
    for x, n in total.items():
        ends[x + 1] = n
    begins = np.cumsum(ends)
    runs = [np.concatenate([np.empty(0, np.int64), *(plan[x][i] + (begins[x] if i == 0 else 0) for x in sorted(plan))]) for i in range(3)]
    before = np.zeros((limit + 1, salts), np.int64)
    for (x, s), n in first.items():
        before[x, s] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bins, offsets = runs
        for b in batches:
            n, salt, rank = (b.column(fields.names.index(c)).to_numpy(zero_copy_only=False) for c in (length, "__salt", "__rank"))
            place = begins[n] + before[n, salt] + rank
            k = np.searchsorted(starts, place, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(fields.names.index(c)) for c in names), pa.array(bins[k] + place - starts[k]), pa.array(offsets[k])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def packed_report(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """The contract's digest: each piece with its place and the checksum of its ids."""
    pieces = tokenized_pieces(docs.select("doc_id", text_of().alias("text")), path, limit)
    held = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(held, limit)
