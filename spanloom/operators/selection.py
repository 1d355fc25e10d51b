"""Checks on proposed clip selections: format, duration, overlap, presence, look, distribution."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import json_lenient
from spanloom.functions.timecode import seconds_to_timecode, shot_ranges
from spanloom.operators.intervals import conflicts, overlap_join, point_in_interval
from spanloom.operators.ordered import DAY, as_list, grouped_stream, scan, top_rows
from spanloom.session import materialize

# Limits of a selection.
MAX_CLIPS, MAX_GAP, MIN_CLIP, TRIM_LIMIT = 3, 2.0, 2.0, 1.0


def resume_pending(todo: DataFrame, done: DataFrame, *, on=("section_idx", "shot_idx"), status: str | None = "status") -> DataFrame:
    """Work whose key is not already completed with status ``success``."""
    ok = done.filter(F.col(status) == "success") if status else done
    return todo.join(ok.select(*on).dropna(), list(on), "left_anti")


def selection_check(df: DataFrame, *, answer="answer", target="target", tol: float = 1.0, max_clips: int = MAX_CLIPS,
                    max_gap: float = MAX_GAP, min_clip: float = MIN_CLIP, fps: float = 2.0) -> DataFrame:
    """Check the clip ranges written in ``answer`` against a target length.

    ``status`` is the first failure in this order, else ``ok`` or ``auto_trim``: ``no_range``, ``too_many``,
    ``bad_time``, ``bad_duration``, ``overlap``, ``gap``, ``mismatch``. A total up to one second above the target is
    trimmed from the last clip. A selection holds a handful of clips, so everything is one row's expression.
    """
    r = F.col("_r")
    n = F.size(r)
    gaps = F.zip_with(F.slice(r, 1, n - 1), F.slice(r, 2, n - 1), lambda a, b: b["start"] - a["end"])
    length = F.transform(r, lambda x: x["end"] - x["start"])
    # gaps are judged in order, so the first failing pair names the error
    bad_gap = F.get(F.filter(gaps, lambda g: (g < 0) | (g > max_gap)), F.lit(0))
    # clips are judged in order too: an unreadable time or an empty clip, whichever comes first
    out = df.withColumn("_r", shot_ranges(answer, fps)).withColumn("n_clips", n).withColumn("_len", length)
    length = F.col("_len")
    total = F.aggregate(length, F.lit(0.0), lambda a, x: a + x)
    bad = F.get(F.filter(length, lambda x: x.isNull() | (x <= 0)), F.lit(0))
    n_bad = F.size(F.filter(length, lambda x: x.isNull() | (x <= 0)))
    out = out.withColumn("_total", F.when((n > 0) & (n_bad == 0), total)).withColumn("_bad_gap", F.when(n > 1, bad_gap))
    diff = F.col("_total") - F.col(target)
    status = (F.when(n == 0, "no_range").when(n > max_clips, "too_many")
              .when((n_bad > 0) & bad.isNull(), "bad_time").when(n_bad > 0, "bad_duration")
              .when(F.col("_bad_gap") < 0, "overlap").when(F.col("_bad_gap") > max_gap, "gap")
              .when(F.abs(diff) > tol, "mismatch").when((diff > 0) & (diff <= TRIM_LIMIT), "auto_trim").otherwise("ok"))
    trims = F.col("status") == "auto_trim"
    last_end = F.when(n > 0, F.get(r, n - 1)["end"])
    out = (out.withColumn("total_duration", F.col("_total")).withColumn("difference", diff).withColumn("status", status)
           .withColumn("short_clips", F.when(F.col("_total").isNotNull(), F.size(F.filter(length, lambda x: x < min_clip))))
           .withColumn("new_end", F.when(trims, last_end - F.col("difference")))
           .withColumn("new_end_time", seconds_to_timecode("new_end", "hms1"))
           .withColumn("final_duration", F.when(trims, F.col(target)).otherwise(F.col("_total")))
           .withColumn("is_stitched", n > 1)
           .withColumn("first_start", F.get(r, F.lit(0))["start"]).withColumn("first_end", F.get(r, F.lit(0))["end"]))
    return out.drop("_r", "_len", "_total", "_bad_gap")


def review_selections(proposals: DataFrame, used: DataFrame, *, by="timeline_id", id="proposal_id", answer="answer",
                      target="target", taken=("used_start", "used_end")) -> DataFrame:
    """Selection check plus overlap of the first range with used ranges: approved, issues and suggestions."""
    keys = as_list(by)
    # stored, so that every text is parsed once; the overlap reads its first range from there
    checked = materialize(selection_check(proposals, answer=answer, target=target))
    first = checked.filter(F.col("first_start").isNotNull() & F.col("first_end").isNotNull())
    hits = (conflicts(first.select(*keys, id, "first_start", "first_end"), used.select(*keys, *taken), by=by,
                      proposal=("first_start", "first_end"), taken=taken)
            .groupBy(*keys, id).agg(F.count(F.lit(1)).alias("overlaps")))
    out = checked.join(hits, [*keys, id], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    failed = ~F.col("status").isin("ok", "auto_trim")
    issues = F.array_compact(F.array(F.when(failed, F.col("status")), F.when(F.col("overlaps") > 0, F.lit("used_overlap"))))
    advice = F.array_compact(F.array(
        F.when(F.size("issues") > 0, F.lit("adjust_selection")),
        F.when(F.col("status") == "mismatch", F.lit("adjust_range_to_target")),
        F.when(F.col("overlaps") > 0, F.lit("choose_free_range"))))
    return (out.withColumn("issues", issues).withColumn("suggestions", advice).withColumn("approved", F.size("issues") == 0))


def admit_clips(proposals: DataFrame, *, by="timeline_id", cols=("start", "end"), order="slot", id="id",
                cell: float = DAY, max_component: int = 1_000_000) -> DataFrame:
    """Accept proposals in slot order unless they overlap an accepted one; adds ``accepted``.

    Proposals are cut into components of mutually reachable overlaps, each folded on its own. Components above
    ``max_component`` rows are decided in rounds of interval joins instead.
    """
    keys, (S, E) = as_list(by), cols
    slim = proposals.select(*keys, S, E, order, id)
    reach = scan(slim, by=keys, t=S, tie=[E, id], cell=cell, run={"_far": ("max", E)})
    comp = materialize(scan(reach, by=keys, t=S, tie=[E, id], cell=cell, island_name="_comp", island_on={"f": "_far", "s": S},
                            island=lambda p, c: c("s") >= p("f")).drop("_far"))
    sizes = comp.groupBy(*keys, "_comp").count().filter(F.col("count") > max_component)
    none_big = sizes.isEmpty()
    small = comp if none_big else comp.join(sizes, [*keys, "_comp"], "left_anti")
    dt = dict(proposals.dtypes)
    schema = ", ".join(f"`{c}` {dt[c]}" for c in (*keys, id))

    def fold(pdf: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        ok = np.zeros(len(pdf), dtype=bool)
        A, Z = pdf[S].to_numpy(), pdf[E].to_numpy()
        rank = np.lexsort((pdf[id].to_numpy(), pdf[order].to_numpy()))
        group = np.repeat(np.arange(len(b) - 1), np.diff(b))
        starts: list[list[float]] = [[] for _ in range(len(b) - 1)]
        ends: list[list[float]] = [[] for _ in range(len(b) - 1)]
        for i in rank:
            s, e = starts[group[i]], ends[group[i]]
            k = bisect.bisect_left(s, Z[i])         # accepted ranges starting before this one ends
            # accepted ranges are disjoint, so their ends ascend with their starts
            if k and e[k - 1] > A[i]:
                continue
            ok[i] = True
            p = bisect.bisect_left(s, A[i])
            s.insert(p, A[i])
            e.insert(p, Z[i])
        return pdf.loc[ok, [*keys, id]]

    yes = grouped_stream(small, [*keys, "_comp"], [S], fold, schema)
    if not none_big:
        big = comp.join(sizes, [*keys, "_comp"], "left_semi").drop("_comp")
        yes = yes.unionByName(_admit_rounds(big, keys, cols, order, id))
    return (proposals.join(yes.withColumn("_ok", F.lit(True)), [*keys, id], "left")
            .withColumn("accepted", F.coalesce("_ok", F.lit(False))).drop("_ok"))


def _admit_rounds(df: DataFrame, keys: list[str], cols, order: str, id: str) -> DataFrame:
    """Admission for huge components. Overlaps with earlier proposals are joined once; every round reads what is left of them.

    A proposal without an open earlier overlap is accepted, one across an accepted proposal rejected. A proposal with exactly one
    is the opposite of that one, so such proposals form trees of opposites; pointer doubling leads each to the root of its tree, and
    a decided root decides the tree. A chain of n overlaps is thus decided in one round of log n doublings. The
    earliest open proposal is always decided, so the rounds end.
    """
    S, E = cols
    named = df.select(*keys, S, E, order, F.col(id).alias("_id"))
    other = named.select(*keys, F.col(S).alias("_os"), F.col(E).alias("_oe"), F.col(order).alias("_o"), F.col("_id").alias("_on"))
    pairs = overlap_join(named, other, by=keys, a_cols=cols, b_cols=("_os", "_oe"))
    edges = materialize(pairs.filter(F.struct("_o", "_on") < F.struct(order, "_id")).select(*keys, "_id", "_on"))
    open_, yes = materialize(named.select(*keys, "_id")), None
    node, on = [*keys, "_id"], [*keys, "_on"]
    while not open_.isEmpty():
        waiting = materialize(edges.groupBy(*node).agg(F.count(F.lit(1)).alias("_n"), F.min("_on").alias("_on")))
        free = materialize(open_.join(waiting, node, "left_anti"))
        links = _roots(waiting.filter("_n = 1").select(*node, "_on", F.lit(True).alias("_flip")), keys)
        told = links.join(free.withColumnRenamed("_id", "_on"), on, "left_semi")
        taken = materialize(free.unionByName(told.filter("not _flip").select(*node)))
        across = edges.join(taken.withColumnRenamed("_id", "_on"), on, "left_semi").select(*node)
        done = materialize(taken.unionByName(told.select(*node)).unionByName(across).distinct())
        yes = taken if yes is None else yes.unionByName(taken)
        open_ = materialize(open_.join(done, node, "left_anti"))
        edges = materialize(edges.join(done, node, "left_anti").join(done.withColumnRenamed("_id", "_on"), on, "left_anti"))
    return (yes if yes is not None else open_).withColumnRenamed("_id", id)


def _roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """Each node linked to the root of its tree by pointer doubling; ``_flip``: whether the node is the opposite of the root."""
    links = materialize(links)
    while True:
        up = links.select(*keys, F.col("_id").alias("_on"), F.col("_on").alias("_to"), F.col("_flip").alias("_turn"))
        ahead = materialize(links.join(up, [*keys, "_on"], "left"))
        links = ahead.select(*keys, "_id", F.coalesce("_to", "_on").alias("_on"), F.coalesce(F.col("_flip") != F.col("_turn"), F.col("_flip")).alias("_flip"))
        if ahead.filter("_to is not null").isEmpty():
            return links


# ---------------------------------------------------------------- frame detections


def classify_detection(df: DataFrame, min_box: int = 50, *, minor="is_minor_character", present="protagonist_detected",
                       box="bounding_box") -> DataFrame:
    """Ordered rules per frame: minor character, nobody, no box, box too small, ok; adds ``reason``, ``is_break``."""
    size = F.least(F.coalesce(F.col(box)["width"], F.lit(0)), F.coalesce(F.col(box)["height"], F.lit(0)))
    reason = (F.when(F.coalesce(F.col(minor), F.lit(False)), "minor_character").when(~F.coalesce(F.col(present), F.lit(False)), "no_protagonist")
              .when(F.col(box).isNull(), "no_bounding_box").when(size < max(30, min_box // 2), "protagonist_too_small")
              .otherwise("protagonist_ok"))
    return df.withColumn("reason", reason).withColumn("is_break", F.col("reason") != "protagonist_ok")


def break_ratio(frames: DataFrame, min_size: float = 50, max_ratio: float = 0.3, *, by=("timeline_id", "clip_id"),
                frame="frame_idx", t="t", size="face_size", duration="duration", examples: int = 5) -> DataFrame:
    """Per clip: frames without a face or with too small a one; ratio, break seconds, pass, first examples.

    ``size`` is the largest face of the frame, null without one.
    """
    keys = as_list(by)
    reason = F.when(F.col(size).isNull(), "no_face").when(F.col(size) < min_size, "face_too_small")
    f = frames.withColumn("_reason", reason)
    # only the lowest frame numbers can be examples; keeping them partial avoids collecting every break
    few = top_rows(f.filter(F.col("_reason").isNotNull()), by=keys, order=[F.col(frame)], k=examples, t=t)
    shown = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("frame"), F.col(t).alias("time"),
                                                                       F.col("_reason").alias("reason")))).alias("examples"))
    counts = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count("_reason").alias("break_frames"), F.max(duration).alias(duration))
    ratio = F.col("break_frames") / F.col("frames")
    return (counts.withColumn("break_ratio", ratio).withColumn("break_seconds", ratio * F.col(duration))
            .withColumn("passed", F.col("break_ratio") <= max_ratio).join(shown, keys, "left"))


def presence_by_segment(segments: DataFrame, frames: DataFrame, threshold: float = 0.7, *, by="timeline_id", seg_id="seg_id",
                        cols=("start", "end"), t="t", present="protagonist_detected", box="bounding_box") -> DataFrame:
    """Share of frames with the protagonist per segment, mean box size and a recommendation tier."""
    keys = [*as_list(by), seg_id]
    hit = F.coalesce(F.col(present), F.lit(False))
    size = F.least(F.coalesce(F.col(box)["width"], F.lit(0)), F.coalesce(F.col(box)["height"], F.lit(0)))
    f = frames.select(*as_list(by), t, hit.alias("_hit"), F.when(hit & (size > 0), size).alias("_size"))
    j = point_in_interval(f, segments.select(*keys, *cols), by=by, t=t, cols=cols)
    got = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("frame_count"), F.sum(F.col("_hit").cast("int")).alias("hits"), F.avg("_size").alias("_avg"))
    ratio = F.col("hits") / F.col("frame_count")
    tier = F.when(ratio >= F.greatest(F.lit(0.9), F.lit(threshold)), "highly_recommended").when(ratio >= threshold, "recommended").otherwise("low_presence")
    return (got.withColumn("detected", ratio > 0.5).withColumn("ratio", F.bround(ratio, 2))
            .withColumn("avg_box_size", F.bround("_avg", 1)).withColumn("tier", tier).drop("_avg"))


def presence_summary(detections: DataFrame, *, by=("section_idx", "shot_idx"), present="protagonist_detected") -> DataFrame:
    """Frames, hits and ratio (3 decimals) per selection."""
    return (detections.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.coalesce(F.col(present), F.lit(False)).cast("int")).alias("hits"))
            .withColumn("ratio", F.bround(F.col("hits") / F.col("frames"), 3)))


def aesthetic_gate(df: DataFrame, minimum: float = 3.0, *, response="response") -> DataFrame:
    """Pass unless the parsed overall score is below the minimum; an unreadable response passes with a warning."""
    parsed = json_lenient(response, "overall_aesthetic_score double, recommendation string")
    score = F.when(F.col("_p").isNotNull(), F.coalesce("_p.overall_aesthetic_score", F.lit(0.0)))
    return (df.withColumn("_p", parsed).withColumn("aesthetic_score", score)
            .withColumn("readable", F.col("_p").isNotNull())
            .withColumn("passed", F.coalesce(F.col("aesthetic_score") >= minimum, F.lit(True))).drop("_p"))


def weighted_center(detections: DataFrame, *, by=("section_idx", "shot_idx"), present="protagonist_detected",
                    box="bounding_box", scale_x: Column | float = 1.0, scale_y: Column | float = 1.0) -> DataFrame:
    """Area-weighted box centre per selection, scaled to video pixels; null without any box area."""
    b = F.col(box)
    ok = detections.filter(F.coalesce(F.col(present), F.lit(False)) & b.isNotNull())
    w = b["width"] * b["height"]
    agg = ok.groupBy(*as_list(by)).agg(F.sum((b["x"] + b["width"] / 2) * w).alias("_x"), F.sum((b["y"] + b["height"] / 2) * w).alias("_y"),
                                       F.sum(w).alias("_w"))
    def scaled(c, s):
        return F.try_divide(F.col(c), F.col("_w")) * (s if isinstance(s, Column) else F.lit(float(s)))
    return agg.select(*as_list(by), scaled("_x", scale_x).alias("center_x"), scaled("_y", scale_y).alias("center_y"))


def crop_window(df: DataFrame, ratio_w: int, ratio_h: int, *, width="video_width", height="video_height",
                center="center_x") -> DataFrame:
    """Crop of full height and given ratio, centred on ``center`` (or the middle) and kept inside the picture."""
    cw = (F.col(height) * ratio_w / ratio_h).cast("int")
    x = F.when(F.col(center).isNull(), ((F.col(width) - F.col("crop_width")) / 2).cast("int")).otherwise(
        F.greatest(F.lit(0), F.least((F.col(center) - F.col("crop_width") / 2).cast("int"), F.col(width) - F.col("crop_width"))))
    return df.withColumn("crop_width", cw).withColumn("crop_x", x)


# ---------------------------------------------------------------- plans and summaries


def scene_distribution(ids: DataFrame, threshold: float = 0.7, *, by="timeline_id", section="section_idx", scene="scene_id",
                       total="total_scenes") -> DataFrame:
    """Flags per plan: a scene used twice, too narrow a span, nothing or too little in the second half, and too
    large a share of the scenes inside one window of ``min(30, total // 2)``."""
    keys = as_list(by)
    per = ids.groupBy(*keys, scene).agg(F.count(F.lit(1)).alias("_n"), F.max(total).alias("_t"))
    half = F.floor(F.col("_t") / 2)
    base = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scenes"), F.sum((F.col("_n") > 1).cast("int")).alias("duplicated"),
        (F.max(scene) - F.min(scene)).alias("span"), F.max("_t").alias("total_scenes"),
        F.sum((F.col(scene) < half).cast("int")).alias("first_half"), F.sum((F.col(scene) >= half).cast("int")).alias("second_half"))
    w = F.least(F.lit(30), half)
    first, last = F.greatest(F.lit(0), F.col(scene) - w + 1), F.least(F.col(scene), F.col("_t") - w)
    starts = (per.filter(w > 0).withColumn("_a", first.cast("bigint")).withColumn("_b", last.cast("bigint")).filter("_a <= _b")
              .withColumn("_start", F.explode(F.sequence("_a", "_b"))).groupBy(*keys, "_start").agg(F.count(F.lit(1)).alias("_in"))
              .groupBy(*keys).agg(F.max("_in").alias("_most")))
    out = base.join(starts, keys, "left").withColumn("concentration", F.coalesce("_most", F.lit(0)) / F.col("scenes")).drop("_most")
    issues = F.array_compact(F.array(
        F.when(F.col("duplicated") > 0, F.lit("overlap")), F.when(F.col("span") < F.col("total_scenes") * 0.5, F.lit("coverage")),
        F.when(F.col("second_half") == 0, F.lit("second_half_unused")).when(F.col("first_half") > F.col("second_half") * 2, F.lit("unbalanced")),
        F.when(F.col("concentration") > threshold, F.lit("concentrated"))))
    return out.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def flat_selection_check(ids: DataFrame, min_count: int = 8, *, by="timeline_id", scene="scene_id", total="total_scenes") -> DataFrame:
    """Count at least ``min_count`` and every id (given as text) a whole number in ``[0, total)``."""
    x = F.when(F.col(scene).rlike(r"^-?\d+$"), F.col(scene).try_cast("bigint"))
    agg = ids.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("scenes"), F.sum(x.isNull().cast("int")).alias("not_integer"),
        F.sum(F.coalesce(x < 0, F.lit(False)).cast("int")).alias("negative"),
        F.sum(F.coalesce(x >= F.col(total), F.lit(False)).cast("int")).alias("past_end"))
    return agg.withColumn("passed", (F.col("scenes") >= min_count) & (F.col("not_integer") + F.col("negative") + F.col("past_end") == 0))


def coverage_ratio(parts: DataFrame, *, by=("timeline_id", "request_id"), length="duration", requested="requested",
                   minimum: float = 0.5) -> DataFrame:
    """Covered seconds over requested seconds; below ``minimum`` is flagged."""
    agg = parts.groupBy(*as_list(by)).agg(F.sum(F.coalesce(F.col(length), F.lit(0.0))).alias("covered"), F.max(requested).alias(requested))
    ratio = F.when(F.col(requested) > 0, F.col("covered") / F.col(requested)).otherwise(0.0)
    return agg.withColumn("coverage", ratio).withColumn("low_coverage", F.col("coverage") < minimum)


def clip_summary(clips: DataFrame, *, by="timeline_id", section="section_idx", duration="duration", adjusted="adjusted",
                 center="center_x") -> DataFrame:
    """Clips, seconds, adjusted and cropped counts per section, and a total row (null section) per timeline."""
    keys = as_list(by)
    aggs = [F.sum("clips").alias("clips"), F.sum("seconds").alias("seconds"), F.sum("adjusted").alias("adjusted"), F.sum("cropped").alias("cropped")]
    per = clips.groupBy(*keys, section).agg(F.count(F.lit(1)).alias("clips"), F.sum(duration).alias("seconds"),
                                            F.sum(F.col(adjusted).cast("int")).alias("adjusted"), F.count(center).alias("cropped"))
    total = per.groupBy(*keys).agg(*aggs).withColumn(section, F.lit(None).cast(dict(clips.dtypes)[section]))
    return per.unionByName(total)


def section_intensity(segments: DataFrame, sections: DataFrame, *, by="timeline_id", ord="ord", intensity="intensity",
                      cols=("start_time", "end_time")) -> DataFrame:
    """Sum and count of the first numbers of a section's segment texts, and the average per second (2/2/3 decimals)."""
    from spanloom.functions.text import first_number
    keys = [*as_list(by), ord]
    s = segments.filter(F.length(intensity) > 0).groupBy(*keys).agg(F.sum(first_number(intensity)).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    length = F.col(cols[1]) - F.col(cols[0])
    total = F.coalesce("_sum", F.lit(0.0))
    return (sections.join(s, keys, "left").withColumn("total_intensity", F.bround(total, 2)).withColumn("duration", F.bround(length, 2))
            .withColumn("avg_intensity", F.when(length > 0, F.bround(total / length, 3)).otherwise(0.0))
            .withColumn("num_segments", F.coalesce("_n", F.lit(0))).drop("_sum", "_n"))


def dialogue_by_speaker(cues: DataFrame, max_n: int | None = None, *, by="timeline_id", order="index", speaker="speaker",
                        text="text", max_tokens: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(lines per speaker, one formatted text per timeline). The formatted form leaves ``UNKNOWN`` out and comes with
    a token estimate and a flag when it exceeds the limit."""
    from spanloom.functions.text import est_tokens
    keys = as_list(by)
    said = cues.filter(F.length(text) > 0)
    lines = said.groupBy(*keys, speaker).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))),
                                                         lambda p: p["x"]).alias("lines"))
    shown = lines
    if max_n is not None:
        # only the first lines are shown, so only they are gathered
        few = top_rows(said, by=[*keys, speaker], order=[F.col(order)], k=max_n, t=order, cell=4096)
        shown = few.groupBy(*keys, speaker).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))),
                                                            lambda p: p["x"]).alias("lines"))
    block = F.concat(F.lit("["), F.col(speaker), F.lit("]: "), F.array_join("lines", " | "))
    text_ = (shown.filter(F.col(speaker) != "UNKNOWN").groupBy(*keys)
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(speaker).alias("s"), block.alias("b")))), lambda p: p["b"]), "\n\n").alias("formatted")))
    return lines, text_.withColumn("tokens", est_tokens("formatted")).withColumn("over_limit", F.col("tokens") > max_tokens)
