"""Plan documents and selection documents: nested JSON to flat tables, and back.

A plan holds sections with nested slots, a selection document a list of chosen clips with their frame detections. Both come as one JSON text
per key (``timeline_id, body``); unreadable texts, and what a text lacks, yield no rows. Ordinals count from 0 in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.timecode import seconds_to_timecode, timecode_to_seconds
from spanloom.operators.ordered import as_list

# Field names of the documents.
_SLOT = "struct<id string, time_duration double, content string, story_beat string, emotion string, visuals string, related_scene string>"
_PLAN = ("overall_theme string, narrative_logic string, video_structure array<struct<content string, audio_section string, emotion string, "
         f"start_time string, end_time string, related_scenes array<int>, shot_plan struct<shots array<{_SLOT}>>>>")
_BOX = "struct<x int, y int, width int, height int>"
_DETECTION = f"struct<frame_idx bigint, time_sec double, protagonist_detected boolean, is_minor_character boolean, bounding_box {_BOX}, confidence double, reason string>"
_SELECTION = ("struct<status string, section_idx int, shot_idx int, total_duration double, target_duration double, num_clips int, is_stitched boolean, "
              "clips array<struct<shot int, start string, end string, duration double>>, protagonist_detection struct<method string, total_frames_analyzed int, "
              f"frames_with_protagonist int, protagonist_ratio double, frame_detections array<{_DETECTION}>>>")


def scene_list(value: Column | str) -> Column:
    """Scene ids from JSON text that is a number or a list; anything else is no scene."""
    v = F.trim(F.col(value) if isinstance(value, str) else value)
    one = F.when(v.rlike(r"^-?\d+$"), F.array(v.try_cast("int")))
    return F.coalesce(one, F.filter(F.when(v.startswith("["), F.from_json(v, "array<int>")), lambda x: x.isNotNull()), F.array().cast("array<int>"))


def plan_sections(docs: DataFrame, *, by=("timeline_id",), body="body") -> DataFrame:
    """One row per section of a plan: ordinal, texts, times (seconds or timecodes, null where absent), recommended scenes."""
    keys = as_list(by)
    rows = docs.select(*keys, F.posexplode(F.from_json(body, _PLAN)["video_structure"]).alias("section_idx", "_s"))
    return rows.select(*keys, "section_idx", "_s.content", "_s.audio_section", "_s.emotion", timecode_to_seconds(F.col("_s.start_time")).alias("start_time"),
                       timecode_to_seconds(F.col("_s.end_time")).alias("end_time"), F.coalesce("_s.related_scenes", F.array().cast("array<int>")).alias("scenes"))


def plan_slots(docs: DataFrame, *, by=("timeline_id",), body="body") -> DataFrame:
    """One row per slot of a plan, in the form ``scene_shots`` and ``align_slots`` read: section and slot ordinal, id, duration, texts, ``scenes``.

    ``related_scene`` may be a number or a list. Sections without slots, flat ones included, give none.
    """
    keys = as_list(by)
    sections = docs.select(*keys, F.posexplode(F.from_json(body, _PLAN)["video_structure"]).alias("section_idx", "_s"))
    slots = sections.select(*keys, "section_idx", F.col("_s.audio_section").alias("audio_section"), F.posexplode("_s.shot_plan.shots").alias("shot_idx", "_x"))
    return slots.select(*keys, "section_idx", "shot_idx", "audio_section", *[F.col(f"_x.{c}").alias(c) for c in ("id", "time_duration", "content", "story_beat", "emotion", "visuals")],
                        scene_list("_x.related_scene").alias("scenes"))


def _selections(docs: DataFrame, keys: list[str], body: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(F.from_json(body, f"array<{_SELECTION}>")).alias("selection", "_s")).filter(F.col("_s").isNotNull())


def load_selections(docs: DataFrame, *, by=("timeline_id",), body="body") -> DataFrame:
    """One row per selection of a document: ordinal, status, section and slot, durations, clip count, detection figures."""
    keys = as_list(by)
    d = F.col("_s.protagonist_detection")
    return _selections(docs, keys, body).select(*keys, "selection", *[F.col(f"_s.{c}").alias(c) for c in ("status", "section_idx", "shot_idx", "total_duration", "target_duration", "num_clips", "is_stitched")],
                                                d["method"].alias("method"), d["total_frames_analyzed"].alias("frames"), d["frames_with_protagonist"].alias("frames_with_protagonist"), d["protagonist_ratio"].alias("ratio"))


def selection_clips(docs: DataFrame, *, by=("timeline_id",), body="body") -> DataFrame:
    """One row per clip of a selection, times in seconds."""
    keys = as_list(by)
    rows = _selections(docs, keys, body).select(*keys, "selection", F.col("_s.section_idx").alias("section_idx"), F.col("_s.shot_idx").alias("shot_idx"), F.posexplode("_s.clips").alias("clip", "_c"))
    return rows.select(*keys, "selection", "section_idx", "shot_idx", "clip", F.col("_c.shot").alias("shot"), timecode_to_seconds(F.col("_c.start")).alias("start"),
                       timecode_to_seconds(F.col("_c.end")).alias("end"), F.col("_c.duration").alias("duration"))


def selection_detections(docs: DataFrame, *, by=("timeline_id",), body="body") -> DataFrame:
    """One row per frame detection of a selection, in the form the detection operators read."""
    keys = as_list(by)
    rows = _selections(docs, keys, body).select(*keys, "selection", F.col("_s.section_idx").alias("section_idx"), F.col("_s.shot_idx").alias("shot_idx"),
                                                F.explode("_s.protagonist_detection.frame_detections").alias("_f"))
    return rows.select(*keys, "selection", "section_idx", "shot_idx", "_f.*")


def selection_docs(selections: DataFrame, clips: DataFrame, detections: DataFrame | None = None, *, by=("timeline_id",)) -> DataFrame:
    """Selection documents as JSON text from the three tables: selections in ``selection`` order, their clips (``clip`` order, times as timecodes of
    milliseconds) and frame detections (``frame_idx`` order). A document is one text, as large as its key's selections."""
    keys = as_list(by)
    own = [*keys, "selection"]
    clip = F.struct(F.col("clip").alias("o"), F.struct("shot", seconds_to_timecode("start", "hms3").alias("start"), seconds_to_timecode("end", "hms3").alias("end"), "duration").alias("x"))
    nested = clips.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(clip)), lambda p: p["x"]).alias("clips"))
    fields = ["status", "section_idx", "shot_idx", "total_duration", "target_duration", "num_clips", "is_stitched"]
    out = selections.select(*own, *fields).join(nested, own, "left")
    fields.append("clips")
    if detections is not None:
        cols = [c for c in ("frame_idx", "time_sec", "protagonist_detected", "is_minor_character", "bounding_box", "confidence", "reason") if c in detections.columns]
        frames = detections.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("frame_detections"), F.count(F.lit(1)).alias("total_frames_analyzed"),
                                              F.sum(F.col("protagonist_detected").cast("int")).alias("frames_with_protagonist"))
        ratio = F.bround(F.col("frames_with_protagonist") / F.col("total_frames_analyzed"), 3)
        found = F.struct(F.lit("frames").alias("method"), "total_frames_analyzed", "frames_with_protagonist", ratio.alias("protagonist_ratio"), "frame_detections")
        out = out.join(frames, own, "left").withColumn("protagonist_detection", F.when(F.col("total_frames_analyzed").isNotNull(), found))
        fields.append("protagonist_detection")
    entry = F.struct(F.col("selection").alias("o"), F.struct(*fields).alias("x"))
    return out.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda p: p["x"])).alias("body"))
