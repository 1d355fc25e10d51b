"""Pipeline from stored selections to an ordered edit list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.media import detection_size, scale_box
from spanloom.functions.timecode import seconds_to_timecode, timecode_to_seconds
from spanloom.operators.intervals import snap_clip_to_cut
from spanloom.operators.selection import weighted_center
from spanloom.session import materialize


def edit_list(selections: DataFrame, clips: DataFrame, detections: DataFrame, cuts: DataFrame, *, by="timeline_id", tol: float = 0.5,
              width="video_width", height="video_height", short_side: int = 360) -> tuple[DataFrame, DataFrame]:
    """Clips of successful selections, snapped to cuts, with crop centre; and the scaled boxes of their frames.

    ``selections``: timeline, section_idx, shot_idx, status, video size. ``clips``: the same key, ``pos``, ``start``, ``end``
    as timecodes. ``detections``: the same key, time_sec, protagonist_detected, bounding_box. ``position`` in the result
    is the order (section_idx, shot_idx, pos).
    """
    keys = [by, "section_idx", "shot_idx"]
    good = selections.filter(F.col("status") == "success").select(*keys, width, height)
    rows = (clips.join(good, keys).withColumn("start", timecode_to_seconds("start")).withColumn("end", timecode_to_seconds("end"))
            .withColumn("clip_id", F.struct("section_idx", "shot_idx", "pos")))
    # stored once parsed: the join with the cuts reads the times in several places
    rows = materialize(rows)
    snapped = snap_clip_to_cut(rows, cuts, by=by, tol=tol)
    found = detections.filter(F.coalesce("protagonist_detected", F.lit(False)) & F.col("bounding_box").isNotNull()).join(good, keys)
    dw, dh = detection_size(width, height, short_side)
    centre = weighted_center(found, by=[*keys, width, height])
    centre = centre.select(*keys, (F.col("center_x") * (F.col(width) / dw)).alias("center_x"), (F.col("center_y") * (F.col(height) / dh)).alias("center_y"))
    out = (snapped.join(centre, keys, "left").withColumn("duration", F.col("end") - F.col("start"))
           .withColumn("start_str", seconds_to_timecode("start", "hms3")).withColumn("end_str", seconds_to_timecode("end", "hms3"))
           .withColumn("position", F.col("clip_id")).drop("clip_id"))
    boxes = found.select(*keys, "time_sec", scale_box("bounding_box", width, height, short_side).alias("bounding_box"))
    return out, boxes
