"""Secret scan: named patterns, and windows of high Shannon entropy inside candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, text_of

#: Fixed patterns of the contract, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_candidate = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,value_start:int,bits:double>>"


@dataclass(frozen=True)
class CharClass:
    """Characters that a secret of this class is made of, its window, and the bits a character that make one.

    A shorter candidate is one window, and needs the same share of the most bits that its length can have.
    """

    kind: str
    pattern: str
    window: int
    bits: float


@dataclass(frozen=True)
class EntropyRules:
    """classes are tried in order, and a string is scanned as the first that holds all its characters.

    allow: patterns of strings that are never secrets (a match of the whole candidate suppresses it).
    """

    classes: tuple[CharClass, ...] = (
        CharClass("entropy_hex", r"[0-9A-Fa-f]+", 24, 3.0),
        CharClass("entropy_alnum", r"[A-Za-z0-9]+", 20, 3.6),
        CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]+", 24, 4.0),
    )
    allow: tuple[str, ...] = (
        r"[0-9+/_=-]+",  # numbers, dates and rules
        r"[A-Za-z]+",  # a word, however long, has no digits
        r"[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[-_/=+]*",  # words joined by dashes or slashes
        r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",  # UUID
        r"(?:.*(?:EXAMPLE|example|sample|placeholder|changeme|xxxx|XXXX).*)",
    )
    compiled: tuple = field(default=(), compare=False)


def windows(text: str, size: int, bits: float) -> list[tuple[int, int, float]]:
    """Maximal runs of windows of that size whose entropy reaches bits: (start, end, highest entropy).

    The counts of characters and the sum of n log2 n change by one character leaving and one entering.
    """
    n = len(text)
    if n < size:
        return []
    log = [0.0] + [k * math.log2(k) for k in range(1, size + 1)]
    counts: dict[str, int] = {}
    for c in text[:size]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(log[k] for k in counts.values())
    top, out = math.log2(size), []
    i = 0
    while True:
        entropy = top - total / size
        if entropy >= bits - 1e-9:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + size, max(out[-1][2], entropy))
            else:
                out.append((i, i + size, entropy))
        if i + size >= n:
            return out
        gone, come = text[i], text[i + size]
        if gone != come:
            k = counts[gone]
            total += log[k - 1] - log[k]
            counts[gone] = k - 1
            k = counts.get(come, 0)
            total += log[k + 1] - log[k]
            counts[come] = k + 1
        i += 1


class Scanner:
    """Finds (kind, start, end, value_start, bits) in a text; offsets count code points, end exclusive."""

    def __init__(self, rules: EntropyRules):
        self.classes = [(c, re.compile(c.pattern)) for c in rules.classes]
        self.allow = [re.compile(p) for p in rules.allow]

    def named(self, text: str) -> list[tuple]:
        out = []
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            out += [("assign", m.start(), m.end(), m.start(2), None) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            out += [("access", m.start(), m.end(), m.start(), None) for m in _access.finditer(text)]
        out += [("hex", m.start(), m.end(), m.start(), None) for m in _hex.finditer(text)]
        return out

    def entropy(self, text: str) -> list[tuple]:
        out = []
        for m in _candidate.finditer(text):
            value = m.group()
            if any(p.fullmatch(value) for p in self.allow):
                continue
            for c, pattern in self.classes:
                if pattern.fullmatch(value):
                    size = min(c.window, len(value))
                    bits = c.bits * math.log2(size) / math.log2(c.window)
                    out += [(c.kind, m.start() + a, m.start() + b, m.start() + a, round(e, 6)) for a, b, e in windows(value, size, bits)]
                    break
        return out

    def scan(self, text: str) -> list[tuple]:
        return sorted(self.named(text) + self.entropy(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _lists(rows: list[list[tuple]]) -> pa.Array:
    offsets, flat = [0], []
    for r in rows:
        flat += r
        offsets.append(len(flat))
    kinds, starts, ends, values, bits = zip(*flat, strict=True) if flat else ((),) * 5
    struct = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.int32()), pa.array(bits, pa.float64())],
        names=["kind", "start", "end", "value_start", "bits"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def _redacted(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, *, text: str = "text", rules: EntropyRules | None = None, mark: str | None = None) -> DataFrame:
    """docs with `spans`: every secret of each whole text, by start and then kind.

    A span holds its kind, start, end, where its value starts, and its bits a character (null for the named
    patterns). With mark, the text column has each value replaced by the mark; a null text stays null.
    Null and empty texts have no spans. Columns that docs already has keep their values, but for `spans` and,
    with mark, the text. Repeated rows are scanned each. Rows stay in their partitions: nothing is shuffled.
    """
    rules = rules or EntropyRules()
    docs = docs.drop("spans")
    keep = [c for c in docs.columns if mark is None or c != text]
    # Only the text travels to Python; the other columns ride along as Arrow arrays.
    given = docs.withColumn("__text", F.col(text).cast("string")) if mark is None else docs.withColumnRenamed(text, "__text")
    given = given.select(*keep, "__text")
    new = ["spans " + SPAN_TYPE] + ([f"`{text}` string"] if mark is not None else [])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields] + new)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secrets")
        scanner = Scanner(rules)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = [scanner.scan(t or "") for t in texts]
            arrays = [*b.columns[:-1], _lists(found)]
            if mark is not None:
                arrays.append(pa.array([t if t is None or not s else _redacted(t, s, mark) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "spans", *([text] if mark is not None else [])])

    out = given.mapInArrow(scan, schema)
    return out.select(*docs.columns, "spans") if mark is not None else out


def span_keys(spans: str, kinds: tuple[str, ...] = KINDS):
    """Comma-joined kind:start:end of the spans of these kinds."""
    wanted = F.filter(F.col(spans), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of find_secrets: counts, hash of the named spans, and all spans."""
    found = find_secrets(docs.select("doc_id", text_of().alias("text"))).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(span_keys("spans", KINDS[:3]), 256).alias("base_sha256"),
        span_keys("spans").alias("spans"),
    )
