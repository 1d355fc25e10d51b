"""JSON documents, scene documents, section documents, vectors and the catalogue of stored artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.timecode import seconds_to_timecode, timecode_to_seconds
from spanloom.sources.cues import file_stem, read_texts


def with_corrupt(schema: str) -> str:
    return f"{schema}, _corrupt_record string"


def parse_docs(texts: DataFrame, schema: str, *, body="body", keep=("timeline_id",)) -> DataFrame:
    """Parsed documents, key columns kept, unreadable ones skipped."""
    doc = F.from_json(body, with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return (texts.select(*keep, doc.alias("_d")).filter(F.col("_d").isNotNull() & F.col("_d._corrupt_record").isNull())
            .select(*keep, "_d.*").drop("_corrupt_record"))


def read_json_docs(spark: SparkSession, path: str, schema: str, packed: bool = False) -> DataFrame:
    """One JSON document per file; ``doc_key`` is the file name without suffix; malformed documents are skipped.

    With ``packed``, documents are rows ``doc_key``, ``body`` as ``cues.write_texts`` stores them, one object each."""
    if packed:
        parsed = parse_docs(spark.read.parquet(path), schema, keep=("doc_key",))
        return parsed.select(*[c for c in parsed.columns if c != "doc_key"], "doc_key")
    raw = (spark.read.schema(with_corrupt(schema)).json(path, multiLine=True, mode="PERMISSIVE")
           .withColumn("doc_key", file_stem()))
    return raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def caption_entries(texts: DataFrame, *, by: tuple[str, ...] = ("timeline_id",), body="body") -> DataFrame:
    """One object whose keys are records -> (key, value as JSON text); registry keys dropped."""
    entries = texts.select(*by, F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))
    return entries.filter(~F.col("key").isin("subject_registry", "character_registry"))


def read_caption_map(spark: SparkSession, path: str) -> DataFrame:
    return caption_entries(read_texts(spark, path))


def load_sections(docs: DataFrame, *, by: tuple[str, ...] = ("timeline_id",), body="body") -> DataFrame:
    """Sections of caption documents -> interval rows. Unreadable times and non-positive durations are dropped;
    ``ord`` numbers the kept rows' place in the document."""
    schema = "sections array<struct<name string, Start_Time string, End_Time string>>"
    rows = docs.select(*by, F.posexplode(F.from_json(body, schema)["sections"]).alias("ord", "_s"))
    s = timecode_to_seconds(F.coalesce("_s.Start_Time", F.lit("0")))
    e = timecode_to_seconds(F.coalesce("_s.End_Time", F.lit("0")))
    return (rows.select(*by, F.col("ord").cast("bigint").alias("ord"), F.coalesce("_s.name", F.lit("Unknown")).alias("name"),
                        s.alias("start_time"), e.alias("end_time"))
            .filter("end_time > start_time").withColumn("duration", F.col("end_time") - F.col("start_time")))


def caption_fields(caption: Column | str) -> Column:
    """Caption text -> map of output fields: ``summary`` becomes ``description``, ``emotion`` becomes
    ``Emotional_Tone``, the rest is copied; text that is not JSON becomes the description."""
    c = F.col(caption) if isinstance(caption, str) else caption
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    m = F.from_json(F.when(inner != "", inner), "map<string,string>")
    renamed = F.transform_keys(m, lambda k, v: F.when(k == "summary", F.lit("description")).when(k == "emotion", F.lit("Emotional_Tone")).otherwise(k))
    return F.when(c.isNull(), F.lit(None)).when(m.isNotNull(), renamed).otherwise(F.create_map(F.lit("description"), c))


def section_docs(sections: DataFrame, subsegments: DataFrame, captions: DataFrame, points: DataFrame, *,
                 by: tuple[str, ...] = ("timeline_id",)) -> DataFrame:
    """Nested document per timeline as JSON text: sections with their captioned sub-segments, and the instants used
    (values rounded to 4 decimals)."""
    keys = list(by)
    sub = subsegments.join(captions.select(*keys, "section_ord", "sub_ord", "caption"), [*keys, "section_ord", "sub_ord"], "left")
    base = F.create_map(F.lit("name"), F.concat(F.lit("Section "), (F.col("sub_ord") + 1).cast("string")), F.lit("description"), F.lit(""),
                        F.lit("Start_Time"), seconds_to_timecode("relative_start", "ms1"), F.lit("End_Time"), seconds_to_timecode("relative_end", "ms1"))
    extra = caption_fields("caption")
    merged = F.when(extra.isNull(), base).otherwise(
        F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(extra, k), F.lit(False))), extra))
    subs = (sub.groupBy(*keys, "section_ord")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("sub_ord").alias("o"), F.to_json(merged).alias("m")))), lambda x: x["m"]).alias("subs")))
    sec = sections.join(subs.withColumnRenamed("section_ord", "ord"), [*keys, "ord"], "left")
    entry = F.struct(F.col("ord").alias("o"), F.struct(F.col("name"), seconds_to_timecode("start_time", "ms1").alias("Start_Time"),
                     seconds_to_timecode("end_time", "ms1").alias("End_Time"), F.coalesce("subs", F.array().cast("array<string>")).alias("sections")).alias("x"))
    top = sec.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["x"]).alias("sections"))
    kp = F.struct(F.col("t").alias("time"), seconds_to_timecode("t", "ms1").alias("time_mmss"), F.col("type"),
                  F.bround("intensity", 4).alias("intensity"), F.bround("normalized_intensity", 4).alias("normalized_intensity"), F.col("section"))
    pts = points.groupBy(*keys).agg(F.array_sort(F.collect_list(kp)).alias("keypoints"))
    return top.join(pts, keys, "left").select(*keys, F.to_json(F.struct("sections", "keypoints")).alias("body"))


def write_section_docs(docs: DataFrame, path: str) -> None:
    docs.select("timeline_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("timeline_id").text(path)


def scene_docs(scenes: DataFrame, shots: DataFrame, *, by: tuple[str, ...] = ("timeline_id",), ord="ord", fields: tuple[str, ...] = ()) -> DataFrame:
    """Scene rows with their shots nested in order, ready for ``write.json``."""
    keys = [*by, "scene_id"]
    rows = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("ord"), *[F.col(f) for f in fields])))
    nested = shots.groupBy(*keys).agg(rows.alias("shots_data"))
    return (scenes.join(nested, keys)
            .select(*keys, "shot_count", F.struct("start_seconds", "end_seconds").alias("time_range"),
                    F.array("start_frame", "end_frame").alias("frame_range"), "shot_list", "shots_data"))


def write_scene_docs(docs: DataFrame, path: str) -> None:
    """One JSON line per scene, partitioned by timeline so that named scenes can be read without a full scan."""
    docs.write.mode("overwrite").partitionBy("timeline_id").json(path)


def write_vectors(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Vectors with their metadata as Parquet."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def asset_key(c: Column | str) -> Column:
    """Name reduced to ``[a-z0-9]``, the form assets are matched by."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]+", "")


def catalog_rows(paths: DataFrame, plans: DataFrame | None = None, assets: DataFrame | None = None, *, path="path") -> DataFrame:
    """Selection files by path ``.../{movie}_{audio}/{type}/shot_point_*.json`` -> movie, audio, type; with plan
    metadata (joined by folder) and assets matched by reduced name. An exact name wins over a reduced one."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    out = (paths.filter(F.col(path).rlike(r"/[^/]+/[^/]+/shot_point_[^/]*\.json$"))
           .withColumn("folder", folder).withColumn("pair", F.regexp_extract(path, r"/([^/]+)/[^/]+/shot_point_[^/]*\.json$", 1))
           .withColumn("type", F.regexp_extract(path, r"/([^/]+)/shot_point_[^/]*\.json$", 1))
           .withColumn("movie", F.regexp_extract("pair", r"^(.*?)_", 1)).withColumn("audio", F.regexp_extract("pair", r"^.*?_(.*)$", 1)))
    if plans is not None:
        out = out.join(plans, "folder", "left")
    if assets is not None:
        a = assets.select(asset_key("asset").alias("_k"), "asset")
        best = a.groupBy("_k").agg(F.min("asset").alias("asset"))
        out = out.join(best, asset_key("movie") == F.col("_k"), "left").drop("_k")
    return out


def artifact_catalog(spark: SparkSession, glob: str) -> DataFrame:
    """Catalogue of stored selection files; only the listing is read, not the contents."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    return catalog_rows(files)
