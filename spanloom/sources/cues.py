"""Timed text: SRT files and frame boundary files.

A subtitle file is one media item's text and is read as one row per file; many files spread over tasks. Texts in great numbers
are stored packed: many to a Parquet file, one row each with its key. A file of its own costs a text a listing, an open and a
rename, which for small texts is far more than the work on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.timecode import seconds_to_timecode, srt_to_seconds, whole

_STAMP = r"^\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"


def file_stem(path: Column | str = "_metadata.file_path") -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")


def write_texts(texts: DataFrame, path: str, *, key="timeline_id", body="body") -> None:
    """Texts stored packed; keys keep their type, and a null key stays one."""
    texts.select(key, body).write.mode("overwrite").parquet(path)


def read_texts(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``timeline_id`` (file name without suffix) and the whole text of each file, or of each packed row."""
    if packed:
        return spark.read.parquet(path).select("timeline_id", "body")
    return spark.read.text(path, wholetext=True).select(file_stem().alias("timeline_id"), F.col("value").alias("body"))


def cue_rows(texts: DataFrame, mode: str = "float", *, by: tuple[str, ...] = ("timeline_id",), body: str = "body") -> DataFrame:
    """SRT text to cue rows. Modes:

    * ``float``: seconds as double, lines joined by a blank, ``[Speaker]`` prefix split off (null without)
    * ``blocks``: the timestamp line kept as text, lines joined by a line break, speaker ``UNKNOWN`` without prefix
    * ``merge_int``: whole seconds, texts of equal (start, end) joined in file order, no speaker
    """
    keys = list(by)
    flat = F.regexp_replace(F.col(body), "\r\n", "\n")
    sep = r"\n\n+" if mode == "blocks" else r"\n\s*\n"
    blocks = texts.select(*keys, F.posexplode(F.split(F.trim(flat, F.lit(" \t\n")), sep)).alias("pos", "block"))
    lines = F.split(F.trim("block", F.lit(" \t\n")), "\n")
    b = blocks.withColumn("_l", lines)
    if mode == "merge_int":
        # the number line is optional here; a text may be empty
        at = F.when(F.get("_l", F.lit(0)).contains("-->"), 0).otherwise(1)
        stamp, rest = F.get("_l", at), F.slice("_l", at + 2, F.greatest(F.size("_l") - at - 1, F.lit(0)))
        c = (b.withColumn("_st", stamp).filter(F.col("_st").contains("-->"))
             .select(*keys, "pos", srt_to_seconds(F.get(F.split("_st", "-->"), F.lit(0))).cast("bigint").alias("start_sec"),
                     srt_to_seconds(F.get(F.split("_st", "-->"), F.lit(1))).cast("bigint").alias("end_sec"),
                     F.array_join(F.transform(rest, lambda x: F.trim(x)), " ").alias("text")))
        parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
        return (c.groupBy(*keys, "start_sec", "end_sec")
                .agg(F.min("pos").cast("bigint").alias("index"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")))
    b = (b.filter(F.size("_l") >= 3).withColumn("index", whole(F.get("_l", F.lit(0)))).filter(F.col("index").isNotNull())
         .withColumn("_st", F.get("_l", F.lit(1))))
    glue = "\n" if mode == "blocks" else " "
    raw = F.trim(F.array_join(F.slice("_l", 3, F.size("_l") - 2), glue), F.lit(" \t\n"))
    b = b.withColumn("_raw", raw)
    who = F.regexp_extract("_raw", r"(?s)^\[([^\]]+)\]\s*(.*)", 1)
    said = F.trim(F.regexp_extract("_raw", r"(?s)^\[([^\]]+)\]\s*(.*)", 2), F.lit(" \t\n"))
    has = who != ""
    if mode == "blocks":
        return b.select(*keys, "index", F.col("_st").alias("timestamp"), F.when(has, who).otherwise(F.lit("UNKNOWN")).alias("speaker"),
                        F.when(has, said).otherwise(F.col("_raw")).alias("text"))
    a, z = F.regexp_extract("_st", _STAMP, 1), F.regexp_extract("_st", _STAMP, 2)
    return (b.withColumn("_a", a).withColumn("_z", z).filter("_a <> ''")
            .select(*keys, "index", srt_to_seconds("_a").alias("start_sec"), srt_to_seconds("_z").alias("end_sec"),
                    F.when(has, who).alias("speaker"), F.when(has, said).otherwise(F.col("_raw")).alias("text")))


def read_cues(spark: SparkSession, path: str, mode: str = "float", packed: bool = False) -> DataFrame:
    return cue_rows(read_texts(spark, path, packed), mode)


def cue_text(sentences: DataFrame, *, by: tuple[str, ...] = ("timeline_id",), order="ord", start_ms="start_ms", end_ms="end_ms",
             text="text", speaker: str | None = "speaker") -> DataFrame:
    """One SRT text per timeline. Sentences without times are skipped but keep their number."""
    keys = list(by)
    line = F.col(text) if speaker is None else F.when(F.length(speaker) > 0, F.concat(F.lit("["), F.col(speaker), F.lit("] "), F.col(text))).otherwise(F.col(text))
    entry = F.concat(F.col(order).cast("string"), F.lit("\n"), seconds_to_timecode(start_ms, "srt"), F.lit(" --> "), seconds_to_timecode(end_ms, "srt"),
                     F.lit("\n"), line, F.lit("\n\n"))
    timed = sentences.filter(F.col(start_ms).isNotNull() & F.col(end_ms).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("x"))))
    return timed.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["x"]), "").alias("body"))


def write_cues(sentences: DataFrame, path: str, *, packed: bool = False, **kw) -> None:
    """Write SRT text, one folder per timeline or packed."""
    if packed:
        return write_texts(cue_text(sentences, **kw), path)
    cue_text(sentences, **kw).select("timeline_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("timeline_id").text(path)


def boundary_rows(lines: DataFrame, *, by: tuple[str, ...] = ("timeline_id",), line="value") -> DataFrame:
    """Lines of two integers to shot frames; shorter lines are skipped."""
    p = F.split(F.trim(F.col(line), F.lit(" \t")), r"\s+")
    return (lines.filter(F.size(p) >= 2).select(*by, whole(F.get(p, F.lit(0))).alias("start_frame"), whole(F.get(p, F.lit(1))).alias("end_frame"))
            .dropna(subset=["start_frame", "end_frame"]))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return boundary_rows(spark.read.text(path).select(file_stem().alias("timeline_id"), "value"))


def cut_points(boundaries: DataFrame, fps: float, *, by: tuple[str, ...] = ("timeline_id",)) -> DataFrame:
    """Distinct end times of the boundaries in seconds; sorted by the reader that needs an order."""
    return boundaries.select(*by, (F.col("end_frame") / F.lit(float(fps))).alias("cut")).distinct()
