"""Line ranges as column expressions: 1-based, inclusive, BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The range that stands for a whole file where one is needed. Fixed values.
WHOLE_START, WHOLE_END = 1, 4294967295


def overlaps(start: Column, end: Column, whole: Column, q_start: Column, q_end: Column) -> Column:
    """Inclusive overlap; a whole file meets every range, and a query without a range meets everything."""
    return F.coalesce(q_start.isNull() | whole | ((start <= q_end) & (end >= q_start)), F.lit(False))


def overlaps_listed(start: Column, end: Column, q_start: Column, q_end: Column) -> Column:
    """The file index's variant: a whole file is (0, 0) there and so meets no range."""
    return (start <= q_end) & (end >= q_start)


def read_meets(start: Column, end: Column, whole: Column, r_start: Column, r_end: Column) -> Column:
    """A read meets an anchor of its own kind: ranges that overlap, or whole file and whole file."""
    return F.when(r_start.isNull(), whole).otherwise(~whole & (start <= r_end) & (end >= r_start))


def edit_meets(start: Column, end: Column, whole: Column, e_start: Column, e_end: Column) -> Column:
    """An edit of a whole file meets every anchor of the path; an edited range doesn't meet a whole-file anchor."""
    return F.when(e_start.isNull(), F.lit(True)).otherwise(~whole & (start <= e_end) & (end >= e_start))


def extents_meet(start: Column, end: Column, whole: Column, start2: Column, end2: Column, whole2: Column) -> Column:
    return whole | whole2 | ((start <= end2) & (end >= start2))


def iou(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Intersection over union of two inclusive ranges."""
    both = F.greatest(F.lit(0), F.least(end, end2) - F.greatest(start, start2) + 1)
    return both / F.nullif((end - start + 1) + (end2 - start2 + 1) - both, F.lit(0))


def moved_by(start: str, end: str, hunks: str) -> str:
    """SQL of struct(s, e): a range carried through hunks array<struct<os,oc,ns,nc>>, in their order.

    A hunk is compared, by its old lines, with the range as already shifted. A pure insertion (oc = 0) after line os
    shifts both ends if os < s, does nothing from e on, and else widens. A replacement wholly before shifts, wholly
    after does nothing, and one that overlaps takes in its new lines.
    """
    delta = "(h.nc - h.oc)"
    last = "(CASE WHEN h.nc = 0 THEN h.os ELSE h.os + h.nc - 1 END)"
    step = f"""CASE
        WHEN h.oc = 0 AND h.os < r.s THEN named_struct('s', r.s + {delta}, 'e', r.e + {delta})
        WHEN h.oc = 0 AND h.os >= r.e THEN r
        WHEN h.oc = 0 THEN named_struct('s', r.s, 'e', r.e + {delta})
        WHEN h.os + h.oc - 1 < r.s THEN named_struct('s', r.s + {delta}, 'e', r.e + {delta})
        WHEN h.os > r.e THEN r
        ELSE named_struct('s', greatest(least(r.s, h.os), 1L), 'e', greatest({last}, r.e + {delta})) END"""
    done = "named_struct('s', greatest(r.s, 1L), 'e', greatest(r.e, greatest(r.s, 1L)))"
    return f"aggregate({hunks}, named_struct('s', CAST({start} AS bigint), 'e', CAST({end} AS bigint)), (r, h) -> {step}, r -> {done})"


def merge_near(rows: DataFrame, by: list[str], *, start: str = "start", end: str = "end", tolerance: int = 5, order: list[str] | None = None) -> DataFrame:
    """rows with m_start, m_end: the hull of the run of ranges each at most `tolerance` past the furthest end so far."""
    w = Window.partitionBy(*by).orderBy(start, end, *(order or []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", (reach.isNull() | (F.col(start) > reach + tolerance)).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "__run")
    return marked.withColumn("m_start", F.min(start).over(run)).withColumn("m_end", F.max(end).over(run)).drop("__new", "__run")
