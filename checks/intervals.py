"""Checks of the joins between instants and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.roles import check, cues, detections, keypoints, points, sections, shots, spans, sql, table
from spanloom.functions.text import natural_key
from spanloom.operators import intervals as I


def _two(s, d):
    x = spans(s, d)
    a = x.select("timeline_id", F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = x.select("timeline_id", F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return a, b


AB = """a AS (SELECT timeline_id, id AS a_id, "start" AS a_start, "end" AS a_end FROM spans),
b AS (SELECT timeline_id, id AS b_id, "start" AS b_start, "end" AS b_end FROM spans)"""
PAIR = "SELECT '{0}' AS mode, timeline_id, a_id, b_id FROM a JOIN b USING (timeline_id) WHERE {1}"


@check("overlap_join", sql("spans", AB + " " + " UNION ALL ".join([
    PAIR.format("closed", "a_start <= b_end AND a_end >= b_start"), PAIR.format("half_open", "a_start < b_end AND a_end > b_start"),
    PAIR.format("int_ceil", "floor(a_start) < floor(b_end) AND greatest(ceil(a_end), floor(a_start) + 1) > floor(b_start)")])))
def _(s, d):
    a, b = _two(s, d)
    out = None
    for mode in ("closed", "half_open", "int_ceil"):
        x = I.overlap_join(a, b, mode=mode).select(F.lit(mode).alias("mode"), "timeline_id", "a_id", "b_id")
        out = x if out is None else out.unionByName(x)
    return out


@check("overlap_join_outer", sql("spans", AB + """ SELECT 'left' AS how, a.timeline_id, a_id, b_id FROM a LEFT JOIN b ON a.timeline_id = b.timeline_id AND a_start < b_end AND a_end > b_start
UNION ALL SELECT 'left_semi', timeline_id, a_id, NULL FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.timeline_id = b.timeline_id AND a_start < b_end AND a_end > b_start)"""))
def _(s, d):
    a, b = _two(s, d)
    left = I.overlap_join(a, b, how="left", spread=3).select(F.lit("left").alias("how"), "timeline_id", "a_id", "b_id")
    semi = I.overlap_join(a, b, how="left_semi").select(F.lit("left_semi").alias("how"), "timeline_id", "a_id", F.lit(None).cast("bigint").alias("b_id"))
    return left.unionByName(semi)


@check("point_in_interval", sql("spans", """SELECT kp.timeline_id, kp.id, s.id AS span_id FROM kp JOIN spans s ON kp.timeline_id = s.timeline_id AND t >= s."start" AND t < s."end" """))
def _(s, d):
    x = spans(s, d).select("timeline_id", F.col("id").alias("span_id"), "start", "end")
    return I.point_in_interval(points(s, d).select("timeline_id", "id", "t"), x, cols=("start", "end"), spread=2).select("timeline_id", "id", "span_id")


@check("gate_by_intervals", sql("spans", """sp AS (SELECT * FROM spans WHERE "end" - "start" > 60000)
SELECT timeline_id, id FROM kp WHERE timeline_id NOT IN (SELECT timeline_id FROM sp) OR EXISTS (SELECT 1 FROM sp WHERE sp.timeline_id = kp.timeline_id AND kp.t >= sp."start" AND kp.t <= sp."end")"""))
def _(s, d):
    x = spans(s, d).filter("end - start > 60000").select("timeline_id", "start", "end")
    return I.gate_by_intervals(points(s, d).select("timeline_id", "id", "t"), x, cols=("start", "end")).select("timeline_id", "id")


@check("dominant_label", sql("spans", """seg AS (SELECT * FROM spans), tr AS (SELECT * FROM spans),
o AS (SELECT seg.timeline_id, seg.id, tr.type, round(sum(least(seg."end", tr."end") - greatest(seg."start", tr."start")), 4) AS o, min(tr.id) AS f FROM seg JOIN tr
  ON seg.timeline_id = tr.timeline_id AND seg."start" < tr."end" AND seg."end" > tr."start" GROUP BY ALL),
b AS (SELECT timeline_id, id, type FROM o QUALIFY row_number() OVER (PARTITION BY timeline_id, id ORDER BY o DESC, f) = 1)
SELECT seg.timeline_id, seg.id AS seg_id, coalesce(b.type, 'UNKNOWN') AS speaker FROM seg LEFT JOIN b USING (timeline_id, id)"""))
def _(s, d):
    x = spans(s, d)
    seg = x.select("timeline_id", F.col("id").alias("seg_id"), "start", "end")
    turns = x.select("timeline_id", F.col("start").alias("turn_start"), F.col("end").alias("turn_end"), F.col("type").alias("speaker"), F.col("id").alias("turn_ord"))
    return I.dominant_label(seg, turns).select("timeline_id", "seg_id", "speaker")


CLIPS = """clip AS (SELECT timeline_id, w AS clip_id, w * 40e0 AS clip_start, w * 40e0 + 30 AS clip_end FROM
  (SELECT timeline_id, unnest(generate_series(0, CAST(floor(max(end_sec) / 40) AS INT) + 1)) AS w FROM cues GROUP BY timeline_id))"""


def _clips(s, d):
    c = cues(s, d).groupBy("timeline_id").agg(F.max("end_sec").alias("last"))
    w = c.select("timeline_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 40).cast("int") + 1)).alias("clip_id"))
    return w.select("timeline_id", "clip_id", (F.col("clip_id") * 40.0).alias("clip_start"), (F.col("clip_id") * 40.0 + 30).alias("clip_end"))


@check("attach_text", sql("cues", CLIPS + """ SELECT c.timeline_id, c.clip_id, coalesce(x, 'No transcript.') AS transcript FROM clip c LEFT JOIN
 (SELECT clip.timeline_id, clip_id, nullif(trim(string_agg(text, ' ' ORDER BY "index")), '') AS x FROM clip JOIN cues ON clip.timeline_id = cues.timeline_id AND start_sec <= clip_end AND end_sec >= clip_start GROUP BY ALL) j
 ON j.timeline_id = c.timeline_id AND j.clip_id = c.clip_id"""))
def _(s, d):
    return I.attach_text(_clips(s, d), cues(s, d)).select("timeline_id", "clip_id", "transcript")


@check("attach_text_short", sql("cues", CLIPS + """, j AS (SELECT clip.timeline_id, clip_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY "index"), '\\s+', ' ', 'g')) AS x FROM clip JOIN cues
 ON clip.timeline_id = cues.timeline_id AND floor(clip_start) < floor(end_sec) AND greatest(ceil(clip_end), floor(clip_start) + 1) > floor(start_sec) GROUP BY ALL)
SELECT c.timeline_id, c.clip_id, CASE WHEN x IS NULL THEN '' WHEN length(x) > 200 THEN regexp_replace(substr(x, 1, 200), ' [^ ]*$', '') || '…' ELSE x END AS transcript
FROM clip c LEFT JOIN j ON j.timeline_id = c.timeline_id AND j.clip_id = c.clip_id"""))
def _(s, d):
    return I.attach_text(_clips(s, d), cues(s, d), mode="int_ceil", default="", max_chars=200).select("timeline_id", "clip_id", "transcript")


@check("scene_dialogue", sql("cues", CLIPS + """ SELECT c.timeline_id, c.clip_id AS scene_id, coalesce(x, 'No dialogue.') AS dialogue FROM clip c LEFT JOIN
 (SELECT clip.timeline_id, clip_id, string_agg('[' || speaker || ']: "' || text || '"', chr(10) ORDER BY "index") AS x FROM clip JOIN cues
  ON clip.timeline_id = cues.timeline_id AND start_sec <= clip_end AND end_sec >= clip_start GROUP BY ALL) j ON j.timeline_id = c.timeline_id AND j.clip_id = c.clip_id"""))
def _(s, d):
    sc = _clips(s, d).select("timeline_id", F.col("clip_id").alias("scene_id"), F.col("clip_start").alias("scene_start"), F.col("clip_end").alias("scene_end"))
    return I.scene_dialogue(sc, cues(s, d)).select("timeline_id", "scene_id", "dialogue")


@check("frames_in_clips", sql("det shots", """c AS (SELECT timeline_id, ord AS clip_id, start_frame, end_frame FROM shots), f AS (SELECT DISTINCT 'src' || (timeline_id % 20) AS timeline_id, frame_idx // 20 AS frame_idx FROM det)
SELECT f.timeline_id, clip_id, frame_idx FROM f JOIN c ON f.timeline_id = c.timeline_id AND frame_idx >= start_frame AND frame_idx < end_frame"""))
def _(s, d):
    f = detections(s, d).select(F.concat(F.lit("src"), F.col("timeline_id") % 20).alias("timeline_id"), F.floor(F.col("frame_idx") / 20).alias("frame_idx")).distinct()
    c = shots(s, d).select("timeline_id", F.col("ord").alias("clip_id"), "start_frame", "end_frame")
    return I.frames_in_clips(f, c).select("timeline_id", "clip_id", "frame_idx")


CONFLICT = """p AS (SELECT timeline_id, id AS p_id, "start", "end" FROM spans WHERE type = 'click'), u AS (SELECT timeline_id, id AS u_id, "start" AS used_start, "end" AS used_end FROM spans WHERE type <> 'click')"""


@check("conflicts", sql("spans", CONFLICT + """ SELECT timeline_id, p_id, u_id, greatest("start", used_start) AS overlap_start, least("end", used_end) AS overlap_end
FROM p JOIN u USING (timeline_id) WHERE "start" < used_end AND "end" > used_start"""))
def _(s, d):
    x = spans(s, d)
    p = x.filter("type = 'click'").select("timeline_id", F.col("id").alias("p_id"), "start", "end")
    u = x.filter("type <> 'click'").select("timeline_id", F.col("id").alias("u_id"), F.col("start").alias("used_start"), F.col("end").alias("used_end"))
    return I.conflicts(p, u).select("timeline_id", "p_id", "u_id", "overlap_start", "overlap_end")


@check("clip_intervals", sql("spans", """SELECT timeline_id, id, greatest("start", 500000) - 500000 AS "start", least("end", 1500000) - 500000 AS "end" FROM spans WHERE "start" < 1500000 AND "end" > 500000"""))
def _(s, d):
    return I.clip_intervals(spans(s, d), 500_000.0, 1_500_000.0, cols=("start", "end")).select("timeline_id", "id", "start", "end")


@check("rebase", sql("kp sec", """SELECT kp.timeline_id, id, (t - start_time) + start_time AS start_time, (t - start_time) + 5 + start_time AS end_time FROM kp JOIN sec ON kp.timeline_id = sec.timeline_id AND ord = CAST(floor(t / 259200e0) AS BIGINT)"""))
def _(s, d):
    sec = sections(s, d).select("timeline_id", "ord", F.col("start_time").alias("parent_start"))
    o = F.floor(F.col("t") / 259200.0).cast("bigint")
    kids = points(s, d).select("timeline_id", "id", o.alias("ord"), (F.col("t") - o * 259200.0).alias("start_time"), (F.col("t") - o * 259200.0 + 5).alias("end_time"))
    return I.rebase(kids, sec, on=["timeline_id", "ord"]).select("timeline_id", "id", "start_time", "end_time")


@check("snap_clip_to_cut", sql("spans", """c AS (SELECT * FROM spans),
m AS (SELECT c.id, min(kp.t) AS cut FROM c JOIN kp ON kp.timeline_id = c.timeline_id AND kp.t > c."start" + 100 AND kp.t < c."end" - 100 GROUP BY 1)
SELECT timeline_id, c.id AS clip_id, coalesce(cut, "start") AS "start", CASE WHEN cut IS NULL THEN "end" ELSE cut + ("end" - "start") END AS "end", cut IS NOT NULL AS adjusted FROM c LEFT JOIN m USING (id)"""))
def _(s, d):
    c = spans(s, d).select("timeline_id", F.col("id").alias("clip_id"), "start", "end")
    cuts = keypoints(s, d).select("timeline_id", F.col("t").alias("cut"))
    return I.snap_clip_to_cut(c, cuts, tol=100.0).select("timeline_id", "clip_id", "start", "end", "adjusted")


@check("nearest_boundary", sql("kp", """m AS (SELECT timeline_id, t AS mark FROM kp WHERE type = 'error'), p AS (SELECT timeline_id, id, t FROM kp WHERE type <> 'error'),
l AS (SELECT p.*, mark AS lo FROM p ASOF LEFT JOIN m ON p.timeline_id = m.timeline_id AND p.t >= m.mark),
r AS (SELECT l.*, mark AS hi FROM l ASOF LEFT JOIN m ON l.timeline_id = m.timeline_id AND l.t <= m.mark)
SELECT timeline_id, id, t, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN t - lo <= hi - t THEN lo ELSE hi END AS nearest FROM r"""))
def _(s, d):
    k = keypoints(s, d)
    return I.nearest_boundary(k.filter("type <> 'error'").select("timeline_id", "id", "t"), k.filter("type = 'error'").select("timeline_id", F.col("t").alias("mark")))


MAPPING = """map AS (SELECT timeline_id, speaker, CASE WHEN timeline_id % 3 = 0 THEN 'Unknown' WHEN timeline_id % 3 = 1 THEN 'N' || speaker ELSE NULL END AS name,
 CASE WHEN timeline_id % 2 = 0 THEN 'low' ELSE 'high' END AS confidence FROM (SELECT DISTINCT timeline_id, speaker FROM cues WHERE speaker <> 'UNKNOWN'))"""


@check("map_labels", sql("cues", MAPPING + """ SELECT c.timeline_id, c."index", CASE WHEN name IS NULL OR (name = 'Unknown' AND confidence = 'low') THEN c.speaker ELSE name END AS character
FROM cues c LEFT JOIN map USING (timeline_id, speaker)"""))
def _(s, d):
    c = cues(s, d)
    t = F.col("timeline_id")
    m = (c.filter("speaker <> 'UNKNOWN'").select("timeline_id", "speaker").distinct()
         .withColumn("name", F.when(t % 3 == 0, "Unknown").when(t % 3 == 1, F.concat(F.lit("N"), "speaker")))
         .withColumn("confidence", F.when(t % 2 == 0, "low").otherwise("high")))
    return I.map_labels(c, m, by="timeline_id").select("timeline_id", "index", "character")


@check("resolve_entities", sql("shots", """x AS (SELECT timeline_id, ord, source_filename, pos, tags[pos + 1] AS visual_id FROM shots, (VALUES (0), (1)) v(pos)),
m AS (SELECT DISTINCT timeline_id, source_filename || '_' || visual_id AS key, 'Person ' || visual_id AS name FROM x WHERE ord % 2 = 0)
SELECT x.timeline_id, source_filename, pos, visual_id, coalesce(m.name, visual_id) AS resolved FROM x LEFT JOIN m ON m.timeline_id = x.timeline_id AND m.key = source_filename || '_' || visual_id"""))
def _(s, d):
    x = shots(s, d)
    m = (x.filter("ord % 2 = 0").select("timeline_id", "source_filename", F.explode(F.array_distinct("tags")).alias("v"))
         .select("timeline_id", F.concat_ws("_", "source_filename", "v").alias("key"), F.concat(F.lit("Person "), "v").alias("name")))
    return I.resolve_entities(x, m, characters="tags").select("timeline_id", "source_filename", "pos", "visual_id", "resolved")


@check("allowed_neighbors", sql("kp", """rec AS (SELECT DISTINCT timeline_id, k AS scene_id FROM kp WHERE intensity > 50), req AS (SELECT DISTINCT timeline_id, k AS scene_id FROM kp),
ok AS (SELECT DISTINCT timeline_id, scene_id + o AS scene_id FROM rec, (SELECT unnest(generate_series(-3, 3)) AS o) WHERE scene_id + o BETWEEN 0 AND 95)
SELECT req.timeline_id, req.scene_id, ok.scene_id IS NOT NULL AS allowed FROM req LEFT JOIN ok USING (timeline_id, scene_id)"""))
def _(s, d):
    k = keypoints(s, d).withColumnRenamed("k", "scene_id")
    rec = k.filter("intensity > 50").select("timeline_id", "scene_id").distinct().withColumn("max_scene", F.lit(95))
    return I.allowed_neighbors(rec, k.select("timeline_id", "scene_id").distinct())


@check("scene_shots", sql("shots", """slot AS (SELECT timeline_id, ord AS slot, w.scene_id FROM shots, (VALUES (0), (1)) v(j), LATERAL (SELECT CASE WHEN j = 0 THEN ord // 20 ELSE ord // 20 + 3 END AS scene_id) w),
m AS (SELECT timeline_id, ord AS shot, ord // 20 AS scene_id FROM shots)
SELECT slot.timeline_id, slot, slot.scene_id, shot, shot IS NULL AS missing FROM slot LEFT JOIN m USING (timeline_id, scene_id)"""))
def _(s, d):
    x = shots(s, d)
    sc = F.floor(F.col("ord") / 20)
    slots = x.select("timeline_id", F.col("ord").alias("slot"), F.array(sc, sc + 3).alias("scenes"))
    return I.scene_shots(slots, x.select("timeline_id", F.col("ord").alias("shot"), sc.alias("scene_id")))


@check("align_slots", sql("cues sec kp", """pl AS (SELECT timeline_id, "index" // 4 AS section_idx, row_number() OVER (PARTITION BY timeline_id, "index" // 4 ORDER BY "index") - 1 AS pos, n AS slot FROM cues),
mu AS (SELECT timeline_id, "index" // 4 AS section_idx, row_number() OVER (PARTITION BY timeline_id, "index" // 4 ORDER BY "index") - 1 AS pos, speaker AS caption FROM cues WHERE "index" % 3 <> 1)
SELECT pl.timeline_id, pl.section_idx, pl.pos, slot, caption FROM pl LEFT JOIN mu USING (timeline_id, section_idx, pos)"""))
def _(s, d):
    c = cues(s, d).withColumn("section_idx", F.floor(F.col("index") / 4))

    def arr(col, name):
        return F.transform(F.array_sort(F.collect_list(F.struct("index", F.col(col).alias("v")))), lambda p: p["v"]).alias(name)

    plan = c.groupBy("timeline_id", "section_idx").agg(arr("n", "slots"))
    music = c.filter("`index` % 3 <> 1").groupBy("timeline_id", "section_idx").agg(arr("speaker", "segments"))
    return I.align_slots(plan, music).withColumn("pos", F.col("pos").cast("bigint"))
