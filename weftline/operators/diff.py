"""Differences of texts by lines: hunks (os, oc, ns, nc) of an edit script of least size, their counts and patches.

Hunks run in order and are 1-based. A pure insertion (oc = 0) has as os the old line before it, a pure deletion (nc = 0) as
ns the new line before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

HUNKS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("os", "oc", "ns", "nc")]))
Hunk = tuple[int, int, int, int]
Box = tuple[int, int, int, int]


def _middle(a: Sequence, b: Sequence, box: Box) -> tuple[int, int] | None:
    """A point in the box (a0, a1, b0, b1) on a shortest edit path, met by searches from both corners; None if there's none inside.

    The searches keep the furthest points of one number of edits only, so memory is linear in the lines.
    """
    a0, a1, b0, b1 = box
    n, m = a1 - a0, b1 - b0
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}  # furthest x by diagonal, from the start and from the end
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            while x < n and y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(k - delta) < d and x + back.get(delta - k, -1) >= n:
                return (a0 + x, b0 + y) if (x, y) not in ((0, 0), (n, m)) else None
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(k - delta) <= d and x + ahead.get(delta - k, -1) >= n:
                return (a1 - x, b1 - y) if (x, y) not in ((0, 0), (n, m)) else None
    return None


def _matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending; boxes are halved at a middle point until one side is empty."""
    found: list[tuple[int, int]] = []
    todo: list[Box] = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        tail = 0
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, tail = a1 - 1, b1 - 1, tail + 1
        found += [(a1 + i, b1 + i) for i in range(tail)]
        if a0 < a1 and b0 < b1 and (mid := _middle(a, b, (a0, a1, b0, b1))):
            todo += [(mid[0], a1, mid[1], b1), (a0, mid[0], b0, mid[1])]
    return sorted(found)


def hunks_of(old: Sequence, new: Sequence) -> list[Hunk]:
    """Hunks that turn old lines into new ones with the fewest inserted and deleted lines.

    Lines that only one side has are never matched, so they leave before the search, which keeps unlike texts cheap.
    """
    in_old, in_new = set(old), set(new)
    own = [i for i, line in enumerate(old) if line in in_new]
    other = [j for j, line in enumerate(new) if line in in_old]
    same = [(own[i], other[j]) for i, j in _matches([old[i] for i in own], [new[j] for j in other])]
    found, i, j = [], 0, 0
    for x, y in [*same, (len(old), len(new))]:
        oc, nc = x - i, y - j
        if oc or nc:
            found.append((i + (oc > 0), oc, j + (nc > 0), nc))
        i, j = x + 1, y + 1
    return found


def patch_of(old: list[str], new: list[str], hunks: list[Hunk], context: int = 3) -> str:
    """The hunks as a unified diff without headers of files; hunks whose context meets share a block."""
    spans = [(os - (oc > 0), oc, ns - (nc > 0), nc) for os, oc, ns, nc in hunks]
    blocks: list[list[Hunk]] = []
    for s in spans:
        if blocks and s[0] - (blocks[-1][-1][0] + blocks[-1][-1][1]) <= 2 * context:
            blocks[-1].append(s)
        else:
            blocks.append([s])
    told = []
    for block in blocks:
        first, last = block[0], block[-1]
        lead, trail = min(context, first[0]), min(context, len(old) - last[0] - last[1])
        o0, n0 = first[0] - lead, first[2] - lead
        oc, nc = last[0] + last[1] + trail - o0, last[2] + last[3] + trail - n0
        place = lambda start, n: f"{start + (n > 0)}" if n == 1 else f"{start + (n > 0)},{n}"
        told.append(f"@@ -{place(o0, oc)} +{place(n0, nc)} @@")
        at = o0
        for i, gone, j, come in block:
            told += [f" {line}" for line in old[at:i]] + [f"-{line}" for line in old[i : i + gone]] + [f"+{line}" for line in new[j : j + come]]
            at = i + gone
        told += [f" {line}" for line in old[at : at + trail]]
    return "\n".join(told)


#: Rows whose lines one step of a task holds as Python objects.
AT_ONCE = 64


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows by AT_ONCE; an empty batch gives none."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def with_hunks(pairs: DataFrame, old: str = "old", new: str = "new", *, name: str = "hunks") -> DataFrame:
    """pairs with the hunks between two array columns of lines or of lines' hashes; a null array has no lines.

    A row is compared in its own task; its arrays must fit there, as rows have to anyway.
    """
    schema = T.StructType([f for f in pairs.schema.fields if f.name != name]).add(name, HUNKS)
    kept = [f.name for f in schema.fields[:-1]]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("os", "oc", "ns", "nc")]))
        for batch in _steps(batches):
            each = ([dict(zip(("os", "oc", "ns", "nc"), h, strict=True)) for h in hunks_of(a or [], b or [])] for a, b in zip(batch[old].to_pylist(), batch[new].to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(list(each), kind)], names=[*kept, name])

    return pairs.mapInArrow(compared, schema)


def with_patch(pairs: DataFrame, old: str = "old", new: str = "new", *, context: int = 3) -> DataFrame:
    """pairs (with hunks of with_hunks) and the patch between two arrays of lines."""
    schema = T.StructType([f for f in pairs.schema.fields if f.name != "patch"]).add("patch", "string")
    kept = [f.name for f in schema.fields[:-1]]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            rows = zip(*(batch[c].to_pylist() for c in (old, new, "hunks")), strict=True)
            each = [patch_of(a or [], b or [], [(h["os"], h["oc"], h["ns"], h["nc"]) for h in hs], context) for a, b, hs in rows]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(each, pa.string())], names=[*kept, "patch"])

    return pairs.mapInArrow(told, schema)


def stat(hunks: Column) -> Column:
    """struct(inserted, deleted): lines that hunks insert and delete."""
    total = lambda part: F.aggregate(hunks, F.lit(0).cast("bigint"), lambda n, h: n + h[part])
    return F.struct(total("nc").alias("inserted"), total("oc").alias("deleted"))


def applied(old: Column, new: Column, hunks: Column) -> Column:
    """Old lines with the hunks' new lines in place of their old ones: the new lines, if the hunks are right."""
    kept_from = lambda h: h["os"] + F.greatest(h["oc"], F.lit(1))
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.slice(old, 1, 0).alias("out"))

    def step(r: Column, h: Column) -> Column:
        before = F.slice(old, r["at"].cast("int"), (h["os"] - r["at"] + F.when(h["oc"] == 0, 1).otherwise(0)).cast("int"))
        put = F.slice(new, F.greatest(h["ns"], F.lit(1)).cast("int"), h["nc"].cast("int"))
        return F.struct(kept_from(h).alias("at"), F.concat(r["out"], before, put).alias("out"))

    return F.aggregate(hunks, start, step, lambda r: F.concat(r["out"], F.slice(old, r["at"].cast("int"), F.greatest(F.size(old) - r["at"] + 1, F.lit(0)).cast("int"))))


def text_lines(c: str) -> Column:
    """Lines of a text column for a difference; a null text has none."""
    return F.coalesce(text.lines_trimmed(F.col(c)), F.array().cast("array<string>"))
