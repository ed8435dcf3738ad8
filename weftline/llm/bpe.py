"""Byte-pair encoding and decoding of whole texts with a public tokenizer file."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, done, text_of

#: White space as the tokenizers' regular expressions have it.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_space_run = re.compile(f"[{SPACES}]+")
#: Separators that str.split() takes for white space and the tokenizer doesn't.
_odd = re.compile("[\x1c-\x1f]")
CACHE, LONGEST = 120_000, 64


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


def merge(symbols: list[int], ranks: list[dict[int, int]], made: list[int]) -> list[int]:
    """The symbols after all merges, lowest rank first and leftmost among equals.

    ranks has, by left symbol, the rank of each right one it merges with; made, by rank, what they become. A priority queue holds
    rank and left position of adjacent pairs of a doubly linked list; an entry is stale when its left symbol is gone or
    its pair has another rank by now.
    """
    n = len(symbols)
    queue = [r << 32 | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := ranks[a].get(b)) is not None]
    if not queue:
        return symbols
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFF
        j = after[i]
        a = symbols[i]
        if a < 0 or j < 0 or ranks[a].get(symbols[j]) != entry >> 32:
            continue
        a = symbols[i] = made[entry >> 32]
        symbols[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks[a].get(symbols[k])) is not None:
                push(queue, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := ranks[symbols[h]].get(a)) is not None:
            push(queue, r << 32 | h)
    return [s for s in symbols if s >= 0]


class Recent:
    """A cache of at least `size` and at most twice as many entries: the older half goes when the newer one is full.

    Keys of over LONGEST characters aren't kept, so the number bounds the bytes.
    """

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def add(self, key: str, value):
        if len(key) > LONGEST:
            return value
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class Codec:
    """Encoder and decoder for a BPE file with NFC, lower case, a word pattern and a word-end suffix.

    White space only separates words here, so each run of other characters is encoded by itself, and the codes
    of the last such runs are kept. A file of another shape is refused. Code points that Unicode has assigned
    since the library's tables were made are letters or symbols as the regex module's tables have them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, steps = file["model"], file["pre_tokenizer"]["pretokenizers"]
        normal = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or file["decoder"]:
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        none: dict[int, int] = {}
        self.ranks = [none] * (max(self.vocab.values()) + 1)
        for i, (a, b) in enumerate(merges):
            if self.ranks[self.vocab[a]] is none:
                self.ranks[self.vocab[a]] = {}
            self.ranks[self.vocab[a]][self.vocab[b]] = i
        self.made = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.inner = [self.vocab.get(x) for x in byte_letters()]
        self.last = [self.vocab.get(x + self.suffix) for x in byte_letters()]
        self.codes = Recent(2 * CACHE)  # of runs and of the words in them: a run of small letters is its own word

    def word(self, word: str) -> bytes:
        if (found := self.codes.new.get(word)) is None:
            if (found := self.codes.old.get(word)) is None:
                code = word.encode("utf-8")
                symbols = [*map(self.inner.__getitem__, code[:-1]), self.last[code[-1]]]
                found = array("I", merge([x for x in symbols if x is not None], self.ranks, self.made)).tobytes()
            self.codes.add(word, found)
        return found

    def run(self, text: str) -> bytes:
        """Little-endian ids of text without white space."""
        if (found := self.codes.old.get(text)) is not None:
            return self.codes.add(text, found)
        if text.isascii() and text.isalpha():
            low = text.lower()
            return self.word(low) if low == text else self.codes.add(text, self.word(low))
        out = []
        for part in self.at_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            # each capital sigma becomes the plain small one, at a word's end too
            part = (part if part.isascii() else unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")).lower()
            out += map(self.word, self.pattern.findall(part))
        return self.codes.add(text, b"".join(out))

    def encode_bytes(self, text: str) -> bytes:
        runs = text.split() if not _odd.search(text) else [r for r in _space_run.split(text) if r]
        new, out = self.codes.new, []
        for r in runs:
            if (found := new.get(r)) is None:
                found = self.run(r)
                new = self.codes.new
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, one space between."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, `ids` (array of int) of each whole text. Null and empty texts have no ids; repeated rows are encoded each.

    path: a tokenizer file that is at the same place on all machines. Nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe", codec.cache_clear)
        try:
            yield from encoded(batches)
        finally:
            done()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                codes = [own.encode_bytes(t or "") for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(codes) + 1, np.int32)
                np.cumsum([len(c) // 4 for c in codes], out=offsets[1:])
                ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(codes))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_documents(coded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """coded with `decoded`: the vocabulary strings of the ids, one space between. Null ids decode to the empty text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.drop("decoded").schema.fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = codec(path).strings
        words = np.array([strings.get(i, "") for i in range(max(strings) + 1)], object)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column(part.schema.get_field_index(ids))
                values = words[lists.values.to_numpy(zero_copy_only=False)]
                ends = lists.offsets.to_numpy()
                texts = [" ".join(values[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return coded.drop("decoded").mapInArrow(decode, schema + ", decoded string")


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digest: count and hash of the ids, and hash of the decoded text."""
    both = decode_documents(encode_documents(docs.select("doc_id", text_of().alias("text")), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
