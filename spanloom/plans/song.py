"""Pipelines from detected instants to a two-level segment table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.intervals import point_in_interval
from spanloom.operators.ordered import DAY, WHOLE, as_list, by_size, scan
from spanloom.operators.points import (allocate_slots, composite_score, enforce_spacing, fill_long_gaps, min_interval_best,
                                       normalize_by_type, percentile_filter, topk_per_section, topk_per_type)
from spanloom.operators.segments import merge_short_back, segments_from_points, split_at_strongest, split_near_midpoints
from spanloom.session import materialize


def filter_significant(points: DataFrame, min_interval: float = 0.0, top_k: int = 0, percentile: float = 0.0,
                       normalize: bool = True, *, by="timeline_id", cell: float = DAY) -> DataFrame:
    """Normalise by type, keep the upper percentile, keep the best per interval, keep the best k per type."""
    if normalize:
        out, score = normalize_by_type(points, by=by), "normalized_intensity"
    else:
        out, score = points.withColumn("normalized_intensity", F.col("intensity")), "intensity"
    if percentile > 0:
        out = percentile_filter(out, percentile, by=by, value=score)
    if min_interval > 0:
        out = min_interval_best(out, min_interval, by=by, score=score, cell=cell)
    if top_k > 0:
        out = topk_per_type(out, top_k, by=by, score=score)
    return out


def filter_by_sections(points: DataFrame, sections: DataFrame, *, by="timeline_id", min_interval: float = 0.0, normalize: bool = True,
                       min_segment: float = 3.0, max_segment: float = 15.0, total: int = 20, duration: str | float | None = None,
                       weights: Mapping[str, float] | None = None, cell: float = DAY) -> DataFrame:
    """Slots shared out over sections by density, the best instants taken, spacing enforced across sections, long
    gaps filled from the unused instants, and short segments removed. Timelines without sections pass unchanged.

    ``duration`` names a column of ``sections`` or is a constant.
    """
    keys = as_list(by)
    if normalize:
        scored = normalize_by_type(points, by=by)
    elif "normalized_intensity" in points.columns:
        scored = points.withColumn("normalized_intensity", F.coalesce("normalized_intensity", "intensity"))
    else:
        scored = points.withColumn("normalized_intensity", F.col("intensity"))
    scored, sections = materialize(composite_score(scored, weights)), materialize(sections)
    out = points.join(sections.select(*keys).distinct(), keys, "left_anti")
    sizes = scored.select(*keys, F.lit(1).alias("rows")).unionAll(sections.select(*keys, F.lit(1).alias("rows")))
    for length, (own, bounds) in by_size(sizes, [scored, sections], by=keys, cell=cell):
        # the steps below store the rows they read more than once
        slots = materialize(allocate_slots(own, bounds, total, by=by, cell=length))
        kept = topk_per_section(own, slots, by=by, cell=length).drop("ord")
        if min_interval > 0:
            kept = min_interval_best(kept, min_interval, by=by, score="composite_score", cell=length)
        if max_segment > 0:     # only timelines with sections have gaps to fill
            kept = fill_long_gaps(kept, own, max_segment, by=by, cell=length)
        if min_segment > 0:
            if isinstance(duration, str):
                kept = kept.join(bounds.groupBy(*keys).agg(F.max(duration).alias("_duration")), keys)
            if length != WHOLE:
                kept = materialize(kept)
            edge = "_duration" if isinstance(duration, str) else duration
            kept = enforce_spacing(kept, min_segment, edge, by=by, cell=length).drop("_duration")
        out = kept.unionByName(out, allowMissingColumns=True)
    return out


def two_level_segments(sections: DataFrame, kept: DataFrame, raw: DataFrame, *, by="timeline_id", mode: str = "cut_at_sections",
                       min_len: float = 3.0, max_len: float = 15.0, duration="duration", cell: float = DAY) -> DataFrame:
    """Sections into sub-segments with times relative to the section.

    ``cut_at_sections`` builds segments inside each section, merges short ones, cuts over-long ones at the strongest
    instants of ``raw`` (then near even times) and merges again; a section left without any is one segment.
    ``by_start`` builds segments over the whole timeline and assigns each to the section its start lies in.
    """
    keys, S, E = as_list(by), "start_time", "end_time"
    if mode == "by_start":
        bounds = sections.groupBy(*keys).agg(F.max(duration).cast("double").alias(E)).withColumn(S, F.lit(0.0))
        seg = merge_short_back(segments_from_points(kept, bounds, by=by, cell=cell), min_len, by=by, cell=cell)
        placed = point_in_interval(seg, sections.select(*keys, F.col("ord").alias("section_ord"), F.col(S).alias("_s"), F.col(E).alias("_e")),
                                   by=by, t=S, cols=("_s", "_e")).drop("_e")
    else:
        ok = sections.withColumn(E, F.when(F.col(E) > F.col(S), F.col(E)).when(F.col(duration) > 0, F.col(duration)).otherwise(F.col(S) + 30.0))
        own = [*keys, "section_ord"]
        sec = materialize(ok.select(*keys, F.col("ord").alias("section_ord"), S, E))
        marks = materialize(point_in_interval(kept.select(*keys, "t"), sec, by=by, t="t", cols=(S, E)).drop(S, E))
        tables, rows = [sec, marks], [sec.withColumn("rows", F.lit(1.0)), marks.withColumn("rows", F.lit(1.0))]
        if max_len > 0:     # a section has as many pieces as marks and parts of the largest length, at most
            inside = materialize(point_in_interval(raw.select(*keys, "t", "id", "normalized_intensity"), sec, by=by, t="t", cols=(S, E)).drop(S, E))
            tables.append(inside)
            rows += [inside.withColumn("rows", F.lit(1.0)), sec.withColumn("rows", (F.col(E) - F.col(S)) / max_len)]
        sizes = reduce(DataFrame.unionAll, [x.select(*own, "rows") for x in rows])
        parts = [_cut_sections(x, own, min_len, max_len, length) for length, x in by_size(sizes, tables, by=own, cell=cell)]
        return reduce(DataFrame.unionAll, parts)
    return _numbered(placed, keys, cell)


def _cut_sections(tables: list[DataFrame], own: list[str], min_len: float, max_len: float, cell: float) -> DataFrame:
    sec, marks, *raw = tables
    S, E = "start_time", "end_time"
    seg = merge_short_back(segments_from_points(marks, sec, by=own, cell=cell), min_len, by=own, cell=cell)
    if max_len > 0:
        # both store what they branch on themselves; segments between instants are disjoint, and so are their pieces
        seg = split_at_strongest(seg, raw[0], min_len, max_len, by=own, cell=cell, disjoint=True)
        seg = split_near_midpoints(seg, raw[0], max_len, by=own, min_len=min_len, cell=cell, disjoint=True)
    seg = materialize(merge_short_back(seg, min_len, by=own, cell=cell))
    bare = sec.join(seg.select(*own).distinct(), own, "left_anti").withColumn("duration", F.col(E) - F.col(S))
    placed = seg.unionByName(bare.select(*seg.columns)).join(sec.select(*own, F.col(S).alias("_s")), own)
    return _numbered(placed, own[:-1], cell)


def _numbered(placed: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Times relative to the section, and the ordinal in it."""
    S, E = "start_time", "end_time"
    out = placed.withColumn("relative_start", F.col(S) - F.col("_s")).withColumn("relative_end", F.col(E) - F.col("_s")).drop("_s")
    numbered = scan(out, by=[*keys, "section_ord"], t=S, cell=cell, run={"_n": ("sum", F.lit(1))})
    return (numbered.withColumn("sub_ord", (F.col("_n") - 1).cast("bigint"))
            .select(*keys, "section_ord", "sub_ord", S, E, "duration", "relative_start", "relative_end"))
