"""Operators that build, merge and cut segments.

Merging is a running sum over a flag each row knows itself or from its neighbour, so it needs no fold.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.intervals import point_in_disjoint, point_in_interval
from spanloom.operators.ordered import DAY, as_list, grouped_stream, scan, top_rows
from spanloom.operators.points import nms_time, reachable
from spanloom.session import materialize


# ---------------------------------------------------------------- from instants


def segments_from_points(points: DataFrame, bounds: DataFrame, *, by="timeline_id", t="t",
                         cols=("start_time", "end_time"), min_len: float = 1.0, cell: float = DAY) -> DataFrame:
    """Consecutive pairs of the distinct instants plus the two bounds of each timeline; shorter than ``min_len``
    is dropped. Instants outside the bounds take part, as they do without bounds."""
    keys, (S, E) = as_list(by), cols
    edges = bounds.select(*keys, F.explode(F.array(F.col(S).cast("double"), F.col(E).cast("double"))).alias(t))
    marks = points.select(*keys, F.col(t).cast("double").alias(t)).unionByName(edges).distinct()
    pairs = scan(marks, by=keys, t=t, cell=cell, next={E: t}).withColumnRenamed(t, S)
    return (pairs.withColumn("duration", F.col(E) - F.col(S)).filter(F.col("duration") >= min_len))


def merge_short_back(segments: DataFrame, min_len: float, *, by="timeline_id", cols=("start_time", "end_time"),
                     cell: float = DAY) -> DataFrame:
    """A segment shorter than ``min_len`` joins its predecessor; the first always stands."""
    keys, (S, E) = as_list(by), cols
    stands = F.when(F.col(E) - F.col(S) >= min_len, 1).otherwise(0)
    # rows ahead of the first long one: the first stands, the others join it; all share group 0
    grouped = scan(segments, by=keys, t=S, cell=cell, run={"_g": ("sum", stands)})
    return (grouped.groupBy(*keys, "_g").agg(F.min(S).alias(S), F.max_by(E, S).alias(E))
            .withColumn("duration", F.col(E) - F.col(S)).drop("_g"))


def preview_segments(points: DataFrame, durations: DataFrame, min_len: float = 3.0, max_len: float = 15.0, *,
                     by="timeline_id", t="t", duration="duration", cell: float = DAY) -> DataFrame:
    """Segments of whole timelines with a status: ``original``, ``merged`` or ``split``.

    A short segment joins its predecessor. Without one, the very first joins the second; further leading
    segments that are still short are dropped. Over-long ones are cut into equal parts.
    """
    keys = as_list(by)
    bounds = durations.select(*keys, F.lit(0.0).alias("start"), F.col(duration).cast("double").alias("end"))
    seg = materialize(segments_from_points(points, bounds, by=keys, t=t, cols=("start", "end"), cell=cell))
    n = seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    seg = scan(seg.join(n, keys), by=keys, t="start", cell=cell, prev={"_ps": "start", "_pe": "end"},
               run={"_i": ("sum", F.lit(1))})
    absorbs = (F.col("_i") == 2) & (F.col("_pe") - F.col("_ps") < min_len)
    seg = (seg.withColumn("start", F.when(absorbs, F.col("_ps")).otherwise(F.col("start")))
           .withColumn("_status", F.when(absorbs, "merged").otherwise("original"))
           .withColumn("_host", ((F.col("end") - F.col("start") >= min_len) | (F.col("_n") == 1)).cast("int")))
    grouped = scan(seg, by=keys, t="end", cell=cell, run={"_g": ("sum", "_host")}).filter("_g > 0")
    merged = (grouped.groupBy(*keys, "_g")
              .agg(F.min("start").alias("start"), F.max_by("end", "end").alias("end"),
                   F.when(F.count(F.lit(1)) > 1, "merged").otherwise(F.min_by("_status", "end")).alias("status")))
    length = F.col("end") - F.col("start")
    k = F.when(length > max_len, F.ceil(length / max_len)).otherwise(1).cast("bigint")
    cut = (merged.withColumn("_k", k).withColumn("_part", length / F.col("_k"))
           .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))))
    last = F.col("_j") == F.col("_k") - 1
    return cut.select(*keys,
                      F.when(F.col("_k") > 1, F.col("start") + F.col("_j") * F.col("_part")).otherwise(F.col("start")).alias("start"),
                      F.when(last, F.col("end")).otherwise(F.col("start") + (F.col("_j") + 1) * F.col("_part")).alias("end"),
                      F.when(F.col("_k") > 1, F.lit("split")).otherwise(F.col("status")).alias("status")) \
        .withColumn("duration", F.col("end") - F.col("start"))


def _cut_at(segments: DataFrame, picks: DataFrame, keys: list[str], cols, min_len: float, x: str) -> DataFrame:
    """Segments cut at the picked times; pieces below ``min_len`` are dropped. Picks per segment are few."""
    S, E = cols
    inner = picks.groupBy(*keys, S).agg(F.array_sort(F.collect_set(x)).alias("_x"))
    j = segments.join(inner, [*keys, S], "left")
    marks = F.concat(F.array(F.col(S)), F.coalesce("_x", F.array().cast("array<double>")), F.array(F.col(E)))
    piece = F.zip_with(F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks) - 1),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return (j.withColumn("_m", F.explode(piece)).filter(F.col("_m.b") - F.col("_m.a") >= min_len)
            .withColumn(S, F.col("_m.a")).withColumn(E, F.col("_m.b")).withColumn("duration", F.col(E) - F.col(S))
            .drop("_m", "_x"))


def _held(points: DataFrame, spans: DataFrame, keys: list[str], t: str, cols, disjoint: bool, cell: float) -> DataFrame:
    if disjoint:
        return point_in_disjoint(points, spans, by=keys, t=t, cols=cols, mode="open", cell=cell)
    return point_in_interval(points, spans, by=keys, t=t, cols=cols, mode="open")


def split_at_strongest(segments: DataFrame, points: DataFrame, min_len: float, max_len: float, *, by="timeline_id",
                       cols=("start_time", "end_time"), t="t", score="normalized_intensity",
                       tie: Sequence[str] = ("id",), cell: float = DAY,
                       fallback: bool = True, disjoint: bool = False) -> DataFrame:
    """Over-long segments cut at their strongest interior instants, at least ``min_len`` from the ends and from
    each other, as many as needed for pieces of ``max_len``. Pieces below ``min_len`` are dropped. Over-long
    segments with no interior instant go to :func:`split_near_midpoints` unless ``fallback`` is off. ``disjoint`` says
    that no segments of a timeline overlap, which spares the interval join."""
    keys, (S, E) = as_list(by), cols
    length = F.col(E) - F.col(S)
    segments = materialize(segments)        # several branches below read the segments and the instants inside
    fine = segments.filter(length <= max_len)
    long = segments.filter(length > max_len)
    need = (F.ceil(length / max_len) - 1).cast("bigint")
    spans = long.select(*keys, S, E, need.alias("_need"))
    inside = materialize(_held(points.select(*keys, t, score, *tie), spans, keys, t, cols, disjoint, cell))
    able = inside.filter((F.col(t) - F.col(S) >= min_len) & (F.col(E) - F.col(t) >= min_len))
    kept = nms_time(able, min_len, by=[*keys, S], t=t, value=score, tie=tie, cell=cell)
    picks = top_rows(kept, by=[*keys, S], order=[F.col(score).desc(), F.col(t)], k=F.col("_need"), t=t,
                     cell=cell).select(*keys, S, F.col(t).alias("_x0"))
    if not fallback:
        done = _cut_at(long, picks, keys, cols, min_len, "_x0")
        return fine.unionByName(done)
    has = inside.select(*keys, S).distinct()
    done = _cut_at(long.join(has, [*keys, S], "left_semi"), picks, keys, cols, min_len, "_x0")
    none = long.join(has, [*keys, S], "left_anti")
    # no instant lies in these, so none is searched
    rest = split_near_midpoints(none, points.filter(F.lit(False)), max_len, by=keys, cols=cols, t=t, score=score, tie=tie, min_len=min_len, cell=cell)
    return fine.unionByName(done).unionByName(rest)


def split_near_midpoints(segments: DataFrame, points: DataFrame, max_len: float, radius: float = 3.0, *,
                         by="timeline_id", cols=("start_time", "end_time"), t="t", score="normalized_intensity",
                         tie: Sequence[str] = ("id",), min_len: float = 0.0,
                         cell: float = DAY, disjoint: bool = False) -> DataFrame:
    """Over-long segments cut near the equal-part times: the strongest unused instant within ``radius``, else the
    nearest unused one, else the time itself. Pieces below ``min_len`` are dropped. ``disjoint`` as in :func:`split_at_strongest`."""
    keys, (S, E) = as_list(by), cols
    length = F.col(E) - F.col(S)
    segments = materialize(segments)        # several branches below read the segments and the instants inside
    fine = segments.filter(length <= max_len)
    long = segments.filter(length > max_len)
    spans = long.select(*keys, S, E, (F.ceil(length / max_len) - 1).cast("bigint").alias("_k"))
    part = (F.col(E) - F.col(S)) / (F.col("_k") + 1)
    inside = materialize(_held(points.select(*keys, t, score, *tie), spans, keys, t, cols, disjoint, cell))
    pos = (F.col(t) - F.col(S)) / part

    def clamp(j):
        return F.least(F.greatest(j, F.lit(1)), F.col("_k")).cast("bigint")

    near = inside.withColumn("_j", clamp(F.round(pos))).withColumn("_d", F.col(t) - (F.col(S) + part * F.col("_j")))
    # a radius within half a part keeps each ideal time in its own zone, as the bound on candidates requires
    fits = F.lit(float(radius)) <= part / 2
    reach = reachable(near, [*keys, S], F.col("_k"), t, "_j", cell, tie, fits)
    need = reach.groupBy(*keys, S).agg(F.max("_need").alias("_need"))
    # strongest within the radius of any ideal time; one instant may lie within reach of several
    lo, hi = F.ceil((F.col(t) - radius - F.col(S)) / part - 1e-9), F.floor((F.col(t) + radius - F.col(S)) / part + 1e-9)
    around = (inside.withColumn("_lo", F.greatest(lo, F.lit(1))).withColumn("_hi", F.least(hi, F.col("_k")))
              .filter("_lo <= _hi").withColumn("_j", F.explode(F.sequence("_lo", "_hi"))).join(need, [*keys, S]))
    strong = top_rows(around, by=[*keys, S, "_j"], k=F.col("_need"), t=t, cell=cell,
                      order=[F.col(score).desc(), F.col(t), *[F.col(c) for c in tie]])
    use = [*keys, S, E, "_k", t, score, *tie]
    pool = reach.select(*use).unionByName(strong.select(*use)).distinct()
    # a span without candidates still yields its plain midpoints
    empty = spans.join(pool.select(*keys, S).distinct(), [*keys, S], "left_anti")
    pool = pool.unionByName(empty, allowMissingColumns=True)
    dt = dict(segments.dtypes)
    schema = ", ".join(f"`{c}` {dt[c]}" for c in (*keys, S)) + ", _x0 double"

    def match(pdf: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        rows = []
        ks = [pdf[c].to_numpy() for c in (*keys, S)]
        T, V, A, Z, K = (pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in (t, score, S, E, "_k"))
        for a, z in zip(b[:-1], b[1:]):
            s, k = A[a], int(K[a])
            step = (Z[a] - s) / (k + 1)
            free = [i for i in range(a, z) if not np.isnan(T[i])]
            times = [T[i] for i in free]
            key = [c[a] for c in ks]
            for i in range(1, k + 1):
                mid = s + i * step
                if not free:
                    rows.append((*key, mid))
                    continue
                lo, hi = bisect.bisect_left(times, mid - radius), bisect.bisect_right(times, mid + radius)
                if lo < hi:
                    best = max(range(lo, hi), key=lambda q: (V[free[q]], -q))
                else:
                    q = bisect.bisect_left(times, mid)
                    best = q if q < len(times) else None
                    if q > 0:
                        left = bisect.bisect_left(times, times[q - 1])
                        if best is None or abs(times[left] - mid) <= abs(times[best] - mid):
                            best = left
                rows.append((*key, times[best]))
                free.pop(best)
                times.pop(best)
        return pd.DataFrame(rows, columns=[*keys, S, "_x0"])

    picks = grouped_stream(pool, [*keys, S], [t, *tie], match, schema)
    return fine.unionByName(_cut_at(long, picks, keys, cols, min_len, "_x0"))


def snap_sections(sections: DataFrame, points: DataFrame, *, by="timeline_id", ord="ord",
                  cols=("start_time", "end_time"), duration="duration", t="t", min_len: float = 1.0) -> DataFrame:
    """Each section end moves to the nearest instant (or 0, or the duration) more than ``min_len`` after its
    start; a section starts where the one before ends; the first starts at 0, the last ends at the duration.

    ``points`` are the instants left after slot allocation: at most the slots of the timeline, which bounds the rows
    of one fold. The fold itself needs few of them but which ones depends on every section before.
    """
    keys, (S, E) = as_list(by), cols
    dt = dict(sections.dtypes)
    schema = ", ".join(f"`{k}` {dt[k]}" for k in (*keys, ord)) + ", _s double, _e double"
    rows = (sections.select(*keys, ord, F.col(E).cast("double").alias("_e0"), F.col(duration).cast("double").alias("_dur"))
            .withColumn("_p", F.lit(None).cast("double")))
    marks = (points.select(*keys, F.col(t).cast("double").alias("_p")).distinct()
             .join(sections.select(*keys).distinct(), keys, "left_semi"))
    both = rows.unionByName(marks, allowMissingColumns=True)

    def snap(pdf: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        out = []
        ks = [pdf[k].to_numpy() for k in keys]
        P, O, E0, D = (pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("_p", ord, "_e0", "_dur"))
        for a, z in zip(b[:-1], b[1:]):
            sec = [i for i in range(a, z) if np.isnan(P[i])]
            sec.sort(key=lambda i: O[i])
            dur = D[sec[0]]
            known = not np.isnan(dur) and dur != 0
            marks = sorted({0.0, *P[a:z][~np.isnan(P[a:z])].tolist(), *([dur] if known else [])})
            start = 0.0
            for n, i in enumerate(sec):
                if n == len(sec) - 1 and known:
                    end = dur
                else:
                    lo = bisect.bisect_right(marks, start + min_len)
                    q = max(bisect.bisect_left(marks, E0[i]), lo)
                    near = [marks[j] for j in (q - 1, q) if lo <= j < len(marks)]
                    end = min(near, key=lambda m: (abs(m - E0[i]), m)) if near else E0[i]
                out.append((*[k[a] for k in ks], int(O[i]), start, end))
                start = end
        return pd.DataFrame(out, columns=[*keys, ord, "_s", "_e"])

    moved = grouped_stream(both, keys, ["_p"], snap, schema)
    return (sections.join(moved, [*keys, ord]).withColumn(S, F.col("_s")).withColumn(E, F.col("_e")).drop("_s", "_e"))


# ---------------------------------------------------------------- runs and islands


def merge_turns(turns: DataFrame, gap: float = 1.0, *, by="timeline_id", cols=("start", "end"), label="speaker",
                text="text", order="ord", cell: float = DAY) -> DataFrame:
    """Consecutive turns of one label with a gap of at most ``gap``: text joined by a space, the last end counts."""
    keys, (S, E) = as_list(by), cols
    g = scan(turns, by=keys, t=S, tie=[order], cell=cell, island_name="_g", island_on={"e": E, "s": S, "l": label},
             island=lambda p, c: ~(p("l").eqNullSafe(c("l"))) | (c("s") - p("e") > gap))
    parts = F.array_sort(F.collect_list(F.struct(F.col(S).alias("s"), F.col(order).alias("o"), F.col(text).alias("x"))))
    place = F.struct(F.col(S), F.col(order))
    return (g.groupBy(*keys, "_g")
            .agg(F.min_by(S, place).alias(S), F.max_by(E, place).alias(E), F.first(label).alias(label),
                 F.array_join(F.transform(parts, lambda p: p["x"]), " ").alias(text),
                 F.count(F.lit(1)).alias("turns")).drop("_g"))


def merge_intervals(spans: DataFrame, gap: float = 0.5, min_len: float = 0.0, pad: float = 0.0, *, by="timeline_id",
                    cols=("start", "end"), cell: float = DAY) -> DataFrame:
    """Join intervals at most ``gap`` apart (largest end counts), drop short ones, pad, floor at 0."""
    keys, (S, E) = as_list(by), cols
    src = spans.select(*keys, S, E)
    reach = scan(src, by=keys, t=S, tie=[E], cell=cell, run={"_far": ("max", E)})
    # the furthest end so far already includes the row itself; the neighbour's is what the row is judged by
    g = scan(reach, by=keys, t=S, tie=[E], cell=cell, island_name="_g", island_on={"f": "_far", "s": S},
             island=lambda p, c: c("s") - p("f") > gap)
    out = g.groupBy(*keys, "_g").agg(F.min(S).alias(S), F.max(E).alias(E)).drop("_g")
    return (out.filter(F.col(E) - F.col(S) >= min_len)
            .withColumn(S, F.greatest(F.lit(0.0), F.col(S) - pad)).withColumn(E, F.col(E) + pad))


def flags_to_intervals(flags: DataFrame, frame: float | str, *, by="timeline_id", t="t", flag="flag",
                       cell: float = DAY) -> DataFrame:
    """Runs of true -> intervals; the end is the first false time (or the last time) plus the frame length."""
    keys = as_list(by)
    length = F.col(frame) if isinstance(frame, str) else F.lit(float(frame))
    src = flags.select(*keys, t, flag, length.alias("_len"))
    g = scan(src, by=keys, t=t, cell=cell, next={"_nt": t}, island_name="_g", island_on={"f": flag},
             island=lambda p, c: p("f") != c("f"))
    return (g.filter(F.col(flag)).groupBy(*keys, "_g")
            .agg(F.min(t).alias("start"), F.max(F.coalesce("_nt", t) + F.col("_len")).alias("end")).drop("_g"))


def compress_runs(labels: DataFrame, *, by="timeline_id", cols=("start", "end"), label="label", score="score",
                  cell: float = DAY) -> DataFrame:
    """Consecutive equal labels -> one run with the largest score."""
    keys, (S, E) = as_list(by), cols
    g = scan(labels.select(*keys, S, E, label, score), by=keys, t=S, tie=[E], cell=cell, island_name="_g",
             island_on={"l": label}, island=lambda p, c: ~p("l").eqNullSafe(c("l")))
    return (g.groupBy(*keys, "_g").agg(F.min(S).alias(S), F.max_by(E, F.struct(S, E)).alias(E),
                                       F.first(label).alias(label), F.max(score).alias(score)).drop("_g"))


def longest_run(runs: DataFrame, *, by="timeline_id", cols=("start", "end"), label="label") -> DataFrame:
    """Label of the longest run per timeline, the earliest on a tie."""
    S, E = cols
    return runs.groupBy(*as_list(by)).agg(F.max_by(label, F.struct(F.col(E) - F.col(S), -F.col(S))).alias(label))


def boundary_deoverlap(scenes: DataFrame, *, by="timeline_id", cols=("start_frame", "end_frame"), order="ord",
                       cell: float = 4096) -> DataFrame:
    """Every range but the first starts right after the end of the one before."""
    S, E = cols
    out = scan(scenes, by=by, t=order, cell=cell, prev={"_pe": E})
    return out.withColumn(S, F.coalesce(F.col("_pe") + 1, F.col(S))).drop("_pe")


def split_fixed(scenes: DataFrame, fps: float, max_sec: float = 300.0, *, cols=("start_frame", "end_frame")) -> DataFrame:
    """Over-long frame ranges (both ends included) cut into pieces of the largest length."""
    S, E = cols
    n = int(max_sec * fps)
    starts = F.when(F.col(E) - F.col(S) + 1 <= n, F.array(F.col(S))).otherwise(F.sequence(F.col(S), F.col(E), F.lit(n).cast("bigint")))
    return (scenes.withColumn("_a", F.explode(starts))
            .withColumn(E, F.when(F.col(E) - F.col(S) + 1 <= n, F.col(E)).otherwise(F.least(F.col("_a") + n - 1, F.col(E))))
            .withColumn(S, F.col("_a")).drop("_a"))


def fixed_windows(frames: DataFrame, size: int, *, by="timeline_id", t="t", frame="frame_idx", start: int = 0,
                  source_fps: float | None = None, target_fps: float | None = None,
                  until: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows ``[k, k + size - 1]`` in whole seconds up to the last frame, and the frames they use.

    With both rates only every ``source // target``-th frame (by ordinal ``frame``) is used.
    """
    keys = as_list(by)
    used = frames
    if source_fps and target_fps:
        step = max(1, int(source_fps / target_fps))
        used = used.filter(F.col(frame) % step == 0)
    used = used.filter(F.col(t) >= start)
    if until is not None:
        used = used.filter(F.col(t) <= until)
    last = used.groupBy(*keys).agg(F.max(t).cast("bigint").alias("_last"))
    windows = (last.withColumn("window_start", F.explode(F.sequence(F.lit(int(start)).cast("bigint"), F.greatest("_last", F.lit(int(start)).cast("bigint")), F.lit(int(size)).cast("bigint"))))
               .filter(F.col("window_start") <= F.col("_last"))
               .withColumn("window_end", F.least(F.col("window_start") + size - 1, F.col("_last"))).drop("_last"))
    return windows, used


def subclips(shots: DataFrame, secs: float, fps: float = 2.0, *, cols=("start_frame", "end_frame"),
             shot="shot_id") -> DataFrame:
    """Shots longer than ``secs`` in pieces with shot id and index; short ones whole. Adds times, the frame range
    (both ends included) and the clip key."""
    S, E = cols
    a, b = F.col(S) / F.lit(float(fps)), F.col(E) / F.lit(float(fps))
    base = shots.withColumn("_a", a).withColumn("_b", b)
    is_sub = F.col("_b") - F.col("_a") > secs
    n = F.when(is_sub, F.ceil((F.col("_b") - F.col("_a")) / F.lit(float(secs)))).otherwise(1).cast("int")
    rows = (base.withColumn("is_sub_clip", is_sub)
            .withColumn("sub_idx", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("clip_start", F.when(F.col("is_sub_clip"), F.col("_a") + F.col("sub_idx") * F.lit(float(secs))).otherwise(F.col("_a")))
            .withColumn("clip_end", F.when(F.col("is_sub_clip"), F.least(F.col("_a") + (F.col("sub_idx") + 1) * F.lit(float(secs)), F.col("_b"))).otherwise(F.col("_b"))))
    whole_key = F.concat_ws("_", F.col("clip_start").cast("bigint"), F.col("clip_end").cast("bigint"))
    sub_key = F.concat(whole_key, F.lit("_shot"), F.col(shot), F.lit("_sub"), F.col("sub_idx"))
    first = F.when(F.col("is_sub_clip"), (F.col("clip_start") * F.lit(float(fps))).cast("bigint")).otherwise(F.col(S))
    last = F.when(F.col("is_sub_clip"), (F.col("clip_end") * F.lit(float(fps))).cast("bigint")).otherwise(F.col(E)) - 1
    return (rows.withColumn("first_frame", first).withColumn("last_frame", last)
            .withColumn("clip_key", F.when(F.col("is_sub_clip"), sub_key).otherwise(whole_key))
            .withColumn("sub_idx", F.when(F.col("is_sub_clip"), F.col("sub_idx"))).drop("_a", "_b"))


def stitch_windows(segments: DataFrame, eps: float = 0.1, fps: float = 2.0, *, by="timeline_id", cols=("start", "end"),
                   kind="visual_type", order="ord", cell: float = DAY) -> DataFrame:
    """Join touching segments across windows unless the next begins with a transition; result in frames, empty
    ranges dropped."""
    keys, (S, E) = as_list(by), cols
    change = F.lower(F.coalesce(kind, F.lit(""))).rlike("cut|dissolve|fade|wipe")
    src = segments.select(*keys, S, E, order, change.alias("_cut"))
    g = scan(src, by=keys, t=S, tie=[order], cell=cell, island_name="_g", island_on={"e": E, "s": S, "cut": "_cut"},
             island=lambda p, c: (F.abs(c("s") - p("e")) >= eps) | c("cut"))
    place = F.struct(F.col(S), F.col(order))
    out = g.groupBy(*keys, "_g").agg(F.min_by(S, place).alias(S), F.max_by(E, place).alias(E))
    return (out.withColumn("start_frame", (F.col(S) * fps).cast("bigint"))
            .withColumn("end_frame", (F.col(E) * fps).cast("bigint"))
            .filter("end_frame > start_frame").drop("_g"))


def segments_to_cuts(windows: DataFrame, *, by="timeline_id", segments="segments", boundaries: str | None = None,
                     start="start_sec") -> DataFrame:
    """Starts of all window segments but the first as absolute boundaries; windows without segments fall back to
    ``boundaries`` (relative timestamps of the older form)."""
    keys = as_list(by)
    new = F.transform(F.filter(segments, lambda s: F.coalesce(s["id"], F.lit(1)) > 1),
                      lambda s: F.struct((F.col(start) + F.coalesce(s["start_time"], F.lit(0.0))).alias("timestamp"),
                                         F.coalesce(s["visual_type"], F.lit("Cut")).alias("type")))
    if boundaries:
        old = F.transform(boundaries, lambda b: F.struct((F.col(start) + b["timestamp"]).alias("timestamp"), b["type"].alias("type")))
        new = F.when(F.col(segments).isNotNull(), new).otherwise(old)
    return windows.select(*keys, start, F.explode(new).alias("_b")).select(*keys, start, "_b.*")


def cuts_to_segments(windows: DataFrame, *, by="timeline_id", boundaries="boundaries", start="start_sec", end="end_sec") -> DataFrame:
    """Segments between the absolute boundaries of a window; each takes the type of the boundary that ends it, the
    last one is of type ``End``. Boundaries at or before the segment start are skipped."""
    later = F.filter(boundaries, lambda b: b["timestamp"] > F.col(start))
    placed = F.array_sort(F.transform(later, lambda b, i: F.struct(b["timestamp"].alias("x"), i.alias("i"), b["type"].alias("type"))))
    w = windows.withColumn("_b", placed)
    first = F.filter("_b", lambda b, i: (i == 0) | (b["x"] > F.get("_b", i - 1)["x"]))
    w = w.withColumn("_b", first)
    heads = F.concat(F.array(F.col(start)), F.transform("_b", lambda b: b["x"]))
    tails = F.concat(F.transform("_b", lambda b: F.struct(b["x"].alias("x"), b["type"].alias("type"))), F.array(F.struct(F.col(end).alias("x"), F.lit("End").alias("type"))))
    seg = F.zip_with(heads, tails, lambda a, z: F.struct(a.alias("a"), z["x"].alias("z"), z["type"].alias("type")))
    return (w.select(*as_list(by), F.explode(seg).alias("_s")).filter(F.col("_s.z") > F.col("_s.a"))
            .select(*as_list(by), F.col("_s.a").alias("start"), F.col("_s.z").alias("end"), F.col("_s.type").alias("visual_type")))


def sample_frames(scenes: DataFrame, min_frames: int = 6, max_frames: int = 128, *,
                  cols=("start_frame", "end_frame")) -> DataFrame:
    """Evenly spaced frame numbers of a scene."""
    S, E = cols
    n = F.col(E) - F.col(S) + 1
    k = F.greatest(F.lit(min_frames), F.least(F.least(n, F.lit(max_frames)), n))
    step = n / k
    return scenes.withColumn("samples", F.when(k >= n, F.sequence(F.col(S), F.col(E))).otherwise(
        F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: (F.col(S) + i * step).cast("bigint"))))


def sample_times(clips: DataFrame, sample_fps: float = 1.0, frames_fps: float = 2.0, *, cols=("start", "end")) -> DataFrame:
    """Sampling times from the start in steps of ``1/sample_fps``, the end included when hit, rounded half to even
    to a frame; one row per distinct frame."""
    S, E = cols
    step = 1.0 / (sample_fps if sample_fps > 0 else 1.0)
    n = F.greatest(F.lit(1), F.ceil((F.col(E) - F.col(S)) / F.lit(step))).cast("int")
    times = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col(S) + i * F.lit(step)), lambda x: x <= F.col(E))
    frames = F.transform(times, lambda x: F.struct(F.bround(x * F.lit(float(frames_fps))).cast("bigint").alias("frame"), x.alias("t")))
    # times ascend, so equal frames are adjacent; the first time of each frame counts
    flat = clips.withColumn("_f", F.explode(frames))
    rest = clips.columns
    return flat.groupBy(*rest, F.col("_f.frame").alias("frame_idx")).agg(F.min("_f.t").alias("t"))


def merge_sections(sections: DataFrame, wanted: DataFrame, children: DataFrame, *, by="timeline_id", ord="ord",
                   name="name", cols=("start_time", "end_time"), child=("start", "end")) -> tuple[DataFrame, DataFrame]:
    """Sections named by ``wanted`` (ord) joined into one, and their children re-based to its start."""
    keys, (S, E) = as_list(by), cols
    chosen = sections.join(wanted.select(*keys, ord).distinct(), [*keys, ord], "left_semi")
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(name).alias("n")))), lambda x: x["n"])
    merged = chosen.groupBy(*keys).agg(F.array_join(names, " + ").alias(name), F.min_by(S, ord).alias(S),
                                       F.max_by(E, ord).alias(E), F.array_sort(F.collect_list(ord)).alias("merged_ords"))
    kids = (children.join(chosen.select(*keys, ord, F.col(S).alias("_sec")), [*keys, ord])
            .join(merged.select(*keys, F.col(S).alias("_all")), keys))
    shift = F.col("_sec") - F.col("_all")
    return merged, kids.withColumn(child[0], F.col(child[0]) + shift).withColumn(child[1], F.col(child[1]) + shift).drop("_sec", "_all")


def climax_section(sections: DataFrame, min_len: float = 20.0, *, by="timeline_id", ord="ord",
                   length="duration", density="avg_intensity") -> DataFrame:
    """Section of highest density per timeline. If it is too short, right and left neighbours are added in turn
    while the total stays within 1.5 times the minimum. Returns ``first_ord, last_ord, total`` per timeline.

    The neighbours that can be added are found from running lengths: only sections within 1.5 times the minimum of
    the best one matter, so a timeline of any number of sections sends few rows to the fold.
    """
    keys = as_list(by)
    best = sections.groupBy(*keys).agg(F.max_by(F.struct(F.col(ord).alias("o")), F.struct(F.col(density), -F.col(ord))).alias("_b"))
    run = scan(sections.select(*keys, ord, length), by=keys, t=ord, cell=4096, run={"_cum": ("sum", length)})
    centre = run.join(best, keys).filter(F.col(ord) == F.col("_b.o")).select(
        *keys, F.col(ord).alias("_o"), F.col("_cum").alias("_c1"), (F.col("_cum") - F.col(length)).alias("_c0"))
    # the first neighbour beyond reach on each side is kept too: it is what stops the growth
    lim = 1.5 * min_len
    near = run.join(centre, keys).filter((F.col("_cum") - F.col(length) <= F.col("_c1") + lim) & (F.col("_cum") >= F.col("_c0") - lim))
    dt = dict(sections.dtypes)
    schema = ", ".join(f"`{k}` {dt[k]}" for k in keys) + ", first_ord bigint, last_ord bigint, total double"

    def grow(pdf: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        out = []
        ks = [pdf[k].to_numpy() for k in keys]
        O, L, C = (pdf[c].to_numpy() for c in (ord, length, "_o"))
        for a, z in zip(b[:-1], b[1:]):
            mid = a + int(np.flatnonzero(O[a:z] == C[a])[0])
            lo = hi = mid
            total = float(L[mid])
            while total < min_len:
                before = total
                for side in (1, -1):
                    q = hi + 1 if side > 0 else lo - 1
                    if a <= q < z and total < min_len and total + L[q] <= lim:
                        total += float(L[q])
                        lo, hi = min(lo, q), max(hi, q)
                if total == before:
                    break
            out.append((*[k[a] for k in ks], int(O[lo]), int(O[hi]), total))
        return pd.DataFrame(out, columns=[*keys, "first_ord", "last_ord", "total"])

    return grouped_stream(near, keys, [ord], grow, schema)
