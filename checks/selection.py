"""Checks of the selection operators and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.roles import SPAN, answers, check, cues, detections, keypoints, points, sections, shots, spans, sql, table
from spanloom.operators import selection as S
from spanloom.operators import validate as V


@check("resume_pending", sql("kp", """SELECT timeline_id AS section_idx, id AS shot_idx FROM kp WHERE NOT (intensity > 15 AND type <> 'error')"""))
def _(s, d):
    x = keypoints(s, d).select(F.col("timeline_id").alias("section_idx"), F.col("id").alias("shot_idx"), "intensity", F.when(F.col("type") == "error", "failed").otherwise("success").alias("status"))
    return S.resume_pending(x.select("section_idx", "shot_idx"), x.filter("intensity > 15"))


# the text of each proposal is known by construction, so its ranges are computed, not parsed
SELECTED = """r AS (SELECT *, CASE kind WHEN 'none' THEN 0 WHEN 'many' THEN 4 WHEN 'two' THEN 2 ELSE 1 END AS n_clips, n1 + (k % 2) / 2e0 AS d1, (gap - (k % 2) / 2e0) AS g12 FROM ans),
c AS (SELECT *, CASE WHEN kind = 'one' THEN d1 WHEN kind = 'two' THEN d1 + 3 END AS tot FROM r),
o AS (SELECT *, CASE WHEN kind = 'none' THEN 'no_range' WHEN kind = 'many' THEN 'too_many' WHEN kind = 'broken' THEN 'no_range' WHEN d1 <= 0 THEN 'bad_duration'
  WHEN kind = 'two' AND g12 < 0 THEN 'overlap' WHEN kind = 'two' AND g12 > 2 THEN 'gap' WHEN abs(tot - target) > 1 THEN 'mismatch' WHEN tot > target THEN 'auto_trim' ELSE 'ok' END AS status FROM c),
sel AS (SELECT *, CASE WHEN kind = 'broken' THEN 0 ELSE n_clips END AS n, CASE WHEN kind IN ('one', 'two') AND d1 > 0 THEN tot END AS total FROM o)"""


@check("selection_check", sql("ans", SELECTED + """ SELECT proposal_id, n AS n_clips, status, CASE WHEN kind = 'many' THEN CASE WHEN d1 > 0 THEN 4 * d1 END ELSE total END AS total_duration,
 CASE WHEN status = 'auto_trim' THEN CASE WHEN kind = 'two' THEN s + n1 + gap + 3 ELSE s + d1 END - (total - target) END AS new_end, n > 1 AS is_stitched,
 CASE WHEN status = 'auto_trim' THEN target WHEN kind = 'many' THEN CASE WHEN d1 > 0 THEN 4 * d1 END ELSE total END AS final_duration,
 CASE WHEN kind = 'many' AND d1 > 0 THEN CASE WHEN d1 < 2 THEN 4 ELSE 0 END WHEN total IS NOT NULL THEN CASE WHEN d1 < 2 THEN 1 ELSE 0 END WHEN kind IN ('none', 'broken') THEN NULL END AS short_clips FROM sel"""))
def _(s, d):
    return S.selection_check(answers(s, d)).select("proposal_id", "n_clips", "status", "total_duration", "new_end", "is_stitched", "final_duration", "short_clips")


@check("review_selections", sql("ans", SELECTED + """, used AS (SELECT timeline_id, t % 80000 AS us, t % 80000 + 30 AS ue FROM kp WHERE type = 'error'),
h AS (SELECT proposal_id, count(*) AS c FROM sel JOIN used USING (timeline_id) WHERE n > 0 AND s < ue AND s + d1 > us GROUP BY 1)
SELECT proposal_id, status IN ('ok', 'auto_trim') AND c IS NULL AS approved, coalesce(c, 0) AS overlaps,
 concat_ws(',', CASE WHEN status NOT IN ('ok', 'auto_trim') THEN status END, CASE WHEN c > 0 THEN 'used_overlap' END) AS issues,
 concat_ws(',', CASE WHEN status NOT IN ('ok', 'auto_trim') OR c > 0 THEN 'adjust_selection' END, CASE WHEN status = 'mismatch' THEN 'adjust_range_to_target' END, CASE WHEN c > 0 THEN 'choose_free_range' END) AS suggestions
FROM sel LEFT JOIN h USING (proposal_id)"""))
def _(s, d):
    used = points(s, d).filter("type = 'error'").select("timeline_id", (F.col("t") % 80000).alias("used_start"), (F.col("t") % 80000 + 30).alias("used_end"))
    r = S.review_selections(answers(s, d), used)
    return r.select("proposal_id", "approved", "overlaps", F.array_join("issues", ",").alias("issues"), F.array_join("suggestions", ",").alias("suggestions"))


ADMIT = """recursive: l AS (SELECT timeline_id, list({'s': "start", 'e': "end", 'id': id} ORDER BY k, id) AS r FROM spans GROUP BY 1),
w AS (SELECT timeline_id, r, 0 AS i, [] :: STRUCT(s DOUBLE, e DOUBLE, id BIGINT)[] AS ok FROM l
  UNION ALL SELECT timeline_id, r, i + 1, CASE WHEN len(list_filter(ok, lambda x: x.s < r[i + 1].e AND x.e > r[i + 1].s)) = 0 THEN list_append(ok, r[i + 1]) ELSE ok END FROM w WHERE i < len(r)),
yes AS (SELECT timeline_id, unnest(list_transform(ok, lambda x: x.id)) AS id FROM w WHERE i = len(r))
SELECT spans.timeline_id, spans.id, yes.id IS NOT NULL AS accepted FROM spans LEFT JOIN yes USING (timeline_id, id)"""


@check("admit_clips", sql("spans", ADMIT))
def _(s, d):
    return S.admit_clips(spans(s, d).withColumnRenamed("k", "slot")).select("timeline_id", "id", "accepted")


@check("classify_detection", sql("det", """SELECT id, r AS reason, r <> 'protagonist_ok' AS is_break FROM (SELECT id, CASE WHEN minor THEN 'minor_character' WHEN NOT hit THEN 'no_protagonist' WHEN NOT boxed THEN 'no_bounding_box' WHEN least(bw, bh) < 45 THEN 'protagonist_too_small' ELSE 'protagonist_ok' END AS r FROM det)"""))
def _(s, d):
    return S.classify_detection(detections(s, d), 90).select("id", "reason", "is_break")


@check("break_ratio", sql("det", """f AS (SELECT timeline_id, clip_id, frame_idx, t, CASE WHEN hit THEN bw END AS size FROM det), b AS (SELECT *, CASE WHEN size IS NULL THEN 'no_face' WHEN size < 50 THEN 'face_too_small' END AS reason FROM f),
x AS (SELECT timeline_id, clip_id, string_agg(frame_idx || ':' || reason, ',' ORDER BY frame_idx) AS ex FROM (SELECT * FROM b WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY timeline_id, clip_id ORDER BY frame_idx) <= 5) GROUP BY ALL)
SELECT b.timeline_id, b.clip_id, count(*) AS frames, count(reason) AS break_frames, count(reason) / count(*) AS break_ratio, count(reason) / count(*) * 86400 AS break_seconds, count(reason) / count(*) <= 0.5 AS passed, any_value(ex) AS examples
FROM b LEFT JOIN x ON x.timeline_id = b.timeline_id AND x.clip_id = b.clip_id GROUP BY b.timeline_id, b.clip_id"""))
def _(s, d):
    f = detections(s, d).select("timeline_id", "clip_id", "frame_idx", "t", F.when(F.col("protagonist_detected"), F.col("bounding_box.width")).alias("w"), "protagonist_detected", "k")
    f = f.select("timeline_id", "clip_id", "frame_idx", "t", F.when(F.col("protagonist_detected"), F.col("k") + 10).alias("face_size"), F.lit(86400.0).alias("duration"))
    r = S.break_ratio(f, 50, 0.5)
    return r.withColumn("examples", F.array_join(F.transform("examples", lambda x: F.concat(x["frame"], F.lit(":"), x["reason"])), ",")).drop("duration")


@check("presence_by_segment", sql("det sec", """j AS (SELECT sec.timeline_id, ord, hit, CASE WHEN hit AND boxed AND least(bw, bh) > 0 THEN least(bw, bh) END AS z FROM sec JOIN det ON det.timeline_id = sec.timeline_id AND t >= start_time AND t < end_time)
SELECT timeline_id, ord, count(*) AS frame_count, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / count(*) > 0.5 AS detected, round_even(count(*) FILTER (hit) / count(*), 2) AS ratio, round_even(avg(z), 1) AS avg_box_size,
 CASE WHEN count(*) FILTER (hit) / count(*) >= 0.9 THEN 'highly_recommended' WHEN count(*) FILTER (hit) / count(*) >= 0.6 THEN 'recommended' ELSE 'low_presence' END AS tier FROM j GROUP BY ALL"""))
def _(s, d):
    return S.presence_by_segment(sections(s, d), detections(s, d), 0.6, seg_id="ord", cols=("start_time", "end_time"))


@check("presence_summary", sql("det", """SELECT timeline_id, clip_id, count(*) AS frames, count(*) FILTER (hit) AS hits, round_even(count(*) FILTER (hit) / count(*), 3) AS ratio FROM det GROUP BY ALL"""))
def _(s, d):
    return S.presence_summary(detections(s, d), by=["timeline_id", "clip_id"])


@check("aesthetic_gate", sql("kp", """SELECT id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0e0 ELSE k / 20e0 END AS aesthetic_score, k % 5 <> 0 AS readable, CASE WHEN k % 5 = 0 THEN true WHEN k % 5 = 1 THEN false ELSE k / 20e0 >= 3 END AS passed FROM kp"""))
def _(s, d):
    k = F.col("k")
    good = F.concat(F.lit('{"overall_aesthetic_score": '), k / 20.0, F.lit(', "recommendation": "USE"}'))
    text = F.when(k % 5 == 0, F.lit("I cannot tell {")).when(k % 5 == 1, F.lit('{"recommendation": "SKIP"}')).when(k % 5 == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    return S.aesthetic_gate(keypoints(s, d).select("id", text.alias("response"))).drop("response")


@check("weighted_center", sql("det", """SELECT timeline_id, clip_id, sum((bx + bw / 2) * bw * bh) / sum(bw * bh) * 2 AS center_x, sum((by_ + bh / 2) * bw * bh) / sum(bw * bh) * 2 AS center_y FROM det WHERE hit AND boxed GROUP BY ALL"""))
def _(s, d):
    return S.weighted_center(detections(s, d), by=["timeline_id", "clip_id"], scale_x=2.0, scale_y=2.0)


@check("crop_window", sql("kp", """c AS (SELECT id, 1280 + k AS w, 720 AS h, CASE WHEN k % 4 <> 0 THEN k * 15.5e0 END AS cx FROM kp), y AS (SELECT *, CAST(trunc(h * 9 / 16) AS INT) AS cw FROM c)
SELECT id, cw AS crop_width, CASE WHEN cx IS NULL THEN CAST(trunc((w - cw) / 2) AS INT) ELSE greatest(0, least(CAST(trunc(cx - cw / 2) AS INT), w - cw)) END AS crop_x FROM y"""))
def _(s, d):
    k = F.col("k")
    x = keypoints(s, d).select("id", (F.lit(1280) + k).alias("video_width"), F.lit(720).alias("video_height"), F.when(k % 4 != 0, k * 15.5).alias("center_x"))
    return S.crop_window(x, 9, 16).select("id", "crop_width", "crop_x")


PLAN = """pl AS (SELECT timeline_id, CAST(floor(t / 259200) AS INT) AS section_idx, k * (timeline_id % 5 + 1) // 5 AS scene_id FROM kp WHERE intensity > 15),
per AS (SELECT timeline_id, scene_id, count(*) AS n FROM pl GROUP BY ALL),
base AS (SELECT timeline_id, count(*) AS scenes, count(*) FILTER (n > 1) AS duplicated, max(scene_id) - min(scene_id) AS span, 100 AS total_scenes, count(*) FILTER (scene_id < 50) AS first_half, count(*) FILTER (scene_id >= 50) AS second_half FROM per GROUP BY 1),
win AS (SELECT timeline_id, max(c) AS most FROM (SELECT timeline_id, a, count(*) AS c FROM per, (SELECT unnest(generate_series(0, 70)) AS a) WHERE scene_id >= a AND scene_id < a + 30 GROUP BY ALL) GROUP BY 1)"""


@check("scene_distribution", sql("kp", PLAN + """ SELECT timeline_id, scenes, duplicated, span, total_scenes, first_half, second_half, most / scenes AS concentration,
 concat_ws(',', CASE WHEN duplicated > 0 THEN 'overlap' END, CASE WHEN span < 50 THEN 'coverage' END, CASE WHEN second_half = 0 THEN 'second_half_unused' WHEN first_half > 2 * second_half THEN 'unbalanced' END, CASE WHEN most / scenes > 0.7 THEN 'concentrated' END) AS issues FROM base JOIN win USING (timeline_id)"""))
def _(s, d):
    x = keypoints(s, d).filter("intensity > 15").select("timeline_id", F.floor(F.col("t") / 259200).cast("int").alias("section_idx"), F.floor(F.col("k") * (F.col("timeline_id") % 5 + 1) / 5).alias("scene_id"), F.lit(100).alias("total_scenes"))
    return S.scene_distribution(x).withColumn("issues", F.array_join("issues", ",")).drop("passed")


@check("flat_selection_check", sql("kp", """x AS (SELECT timeline_id, k = 50 AND timeline_id % 4 = 0 AS odd, k - timeline_id % 3 AS v FROM kp)
SELECT timeline_id, count(*) AS scenes, count(*) FILTER (odd) AS not_integer, count(*) FILTER (NOT odd AND v < 0) AS negative, count(*) FILTER (NOT odd AND v >= 98) AS past_end,
 count(*) >= 8 AND count(*) FILTER (odd OR v < 0 OR v >= 98) = 0 AS passed FROM x GROUP BY 1"""))
def _(s, d):
    k, tl = F.col("k"), F.col("timeline_id")
    x = keypoints(s, d).select("timeline_id", F.when((k == 50) & (tl % 4 == 0), "x").otherwise((k - tl % 3).cast("string")).alias("scene_id"), F.lit(98).alias("total_scenes"))
    return S.flat_selection_check(x)


@check("coverage_ratio", sql("kp", """SELECT timeline_id, CAST(floor(t / 86400) AS BIGINT) AS request_id, round(sum(CASE WHEN k % 4 <> 0 THEN intensity ELSE 0 END), 6) AS covered, 60e0 AS requested, round(sum(CASE WHEN k % 4 <> 0 THEN intensity ELSE 0 END) / 60, 6) AS coverage,
 sum(CASE WHEN k % 4 <> 0 THEN intensity ELSE 0 END) / 60 < 0.5 AS low_coverage FROM kp GROUP BY ALL"""))
def _(s, d):
    x = keypoints(s, d).select("timeline_id", F.floor(F.col("t") / 86400).alias("request_id"), F.when(F.col("k") % 4 != 0, F.col("intensity")).alias("duration"), F.lit(60.0).alias("requested"))
    return S.coverage_ratio(x).withColumn("covered", F.round("covered", 6)).withColumn("coverage", F.round("coverage", 6))


@check("clip_summary", sql("kp", """x AS (SELECT timeline_id, CAST(floor(t / 259200) AS BIGINT) AS section_idx, k, k % 3 = 0 AS adj, k % 4 = 0 AS crop FROM kp)
SELECT timeline_id, section_idx, count(*) AS clips, sum(k * 0.5e0) AS seconds, count(*) FILTER (adj) AS adjusted, count(*) FILTER (crop) AS cropped FROM x GROUP BY GROUPING SETS ((timeline_id, section_idx), (timeline_id))"""))
def _(s, d):
    k = F.col("k")
    x = keypoints(s, d).select("timeline_id", F.floor(F.col("t") / 259200).alias("section_idx"), (k * 0.5).alias("duration"), (k % 3 == 0).alias("adjusted"), F.when(k % 4 == 0, 1.0).alias("center_x"))
    return S.clip_summary(x)


@check("section_intensity", sql("kp sec", """x AS (SELECT timeline_id, CAST(floor(t / 259200) AS BIGINT) AS ord, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0 ELSE k + 0.5e0 END AS v FROM kp),
a AS (SELECT timeline_id, ord, sum(v) AS s, count(v) AS n FROM x GROUP BY ALL)
SELECT timeline_id, ord, round_even(coalesce(s, 0), 2) AS total_intensity, round_even(end_time - start_time, 2) AS duration, round_even(coalesce(s, 0) / 259200, 3) AS avg_intensity, coalesce(n, 0) AS num_segments FROM sec LEFT JOIN a USING (timeline_id, ord)"""))
def _(s, d):
    k = F.col("k")
    text = F.when(k % 5 == 0, F.when(k % 2 == 0, F.lit(""))).when(k % 5 == 1, F.lit("strong")).otherwise(F.concat(F.lit("level "), k, F.lit(".5, of 100")))
    seg = keypoints(s, d).select("timeline_id", F.floor(F.col("t") / 259200).alias("ord"), text.alias("intensity"))
    return S.section_intensity(seg, sections(s, d)).drop("name", "start_time", "end_time")


@check("dialogue_by_speaker", sql("cues", """l AS (SELECT timeline_id, speaker, string_agg(text, ' | ' ORDER BY "index") FILTER (rn <= 2) AS x FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id, speaker ORDER BY "index") AS rn FROM cues) WHERE speaker <> 'UNKNOWN' GROUP BY ALL),
f AS (SELECT timeline_id, string_agg('[' || speaker || ']: ' || x, chr(10) || chr(10) ORDER BY speaker) AS formatted FROM l GROUP BY 1)
SELECT timeline_id, formatted, length(formatted) // 3 AS tokens, length(formatted) // 3 > 400 AS over_limit FROM f"""))
def _(s, d):
    return S.dialogue_by_speaker(cues(s, d), 2, max_tokens=400)[1]


@check("dialogue_lines", sql("cues", """SELECT timeline_id, speaker, count(*) AS n, string_agg(text, chr(1) ORDER BY "index") AS lines FROM cues GROUP BY ALL"""))
def _(s, d):
    x = S.dialogue_by_speaker(cues(s, d))[0]
    return x.select("timeline_id", "speaker", F.size("lines").cast("bigint").alias("n"), F.array_join("lines", "\u0001").alias("lines"))


# ---------------------------------------------------------------- validators


@check("validate_docs", sql("kp", """SELECT id, CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'missing sections' WHEN 2 THEN 'sections is not a list' WHEN 3 THEN 'sections is empty' WHEN 4 THEN 'section without description' WHEN 5 THEN 'section without end time' WHEN 6 THEN 'missing summary' ELSE 'not an object' END AS violations FROM kp"""))
def _(s, d):
    k = F.col("k") % 8
    sec = '{"name": "A", "description": "B", "Start_Time": "00:00", "end_time": "00:10"}'

    def doc(inner):
        return F.concat(F.lit('{"summary": "x", "n": '), F.col("k"), F.lit(f', "sections": {inner}}}'))

    body = (F.when(k == 0, doc(f"[{sec}]")).when(k == 1, F.concat(F.lit('{"summary": "'), F.col("k"), F.lit('"}'))).when(k == 2, doc('{"a": 1}')).when(k == 3, doc("[]"))
            .when(k == 4, doc(f'[{sec}, {{"name": "C", "start_time": 1, "End_Time": 2}}]')).when(k == 5, doc('[{"name": "C", "description": "", "start_time": 1}]'))
            .when(k == 6, F.lit(f'{{"sections": [{sec}]}}')).otherwise(F.lit("no json")))
    v = V.validate_docs(keypoints(s, d).select("id", body.alias("body")), check_times=True)
    return v.select("id", F.array_join("violations", ",").alias("violations"))


def _bad_sections(s, d):
    o = F.col("ord")
    return sections(s, d).withColumn("end_time", F.when(o % 4 == 1, F.col("start_time") + 3).when(o % 4 == 2, F.lit(None)).otherwise(F.col("end_time"))).withColumn("duration", F.lit(1_500_000.0))


BADSEC = "bs AS (SELECT timeline_id, ord, start_time, CASE ord % 4 WHEN 1 THEN start_time + 3 WHEN 2 THEN NULL ELSE end_time END AS end_time, 1500000e0 AS duration FROM sec)"


@check("validate_section_bounds", sql("kp sec", BADSEC + " SELECT timeline_id, ord, CASE WHEN start_time > 1500001 THEN 'start_past_end' ELSE 'end_past_end' END AS issue FROM bs WHERE start_time > 1500001 OR end_time > 1500001"))
def _(s, d):
    return V.validate_section_bounds(_bad_sections(s, d)).select("timeline_id", "ord", "issue")


@check("validate_section_lengths", sql("kp sec", BADSEC + " SELECT timeline_id, ord, CASE WHEN end_time IS NULL THEN 'parse_error' WHEN end_time - start_time < 5 THEN 'too_short' ELSE 'too_long' END AS issue FROM bs WHERE end_time IS NULL OR end_time - start_time < 5 OR end_time - start_time > 90"))
def _(s, d):
    return V.validate_section_lengths(_bad_sections(s, d)).select("timeline_id", "ord", "issue")


@check("validate_coverage", sql("kp sec", BADSEC + ", l AS (SELECT timeline_id, end_time AS last_end FROM bs QUALIFY row_number() OVER (PARTITION BY timeline_id ORDER BY ord DESC) = 1) SELECT timeline_id, last_end, abs(1500000 - last_end) AS missing, coalesce(abs(1500000 - last_end) <= 900000, false) AS covered FROM l"))
def _(s, d):
    return V.validate_coverage(_bad_sections(s, d), 900_000.0).select("timeline_id", "last_end", "missing", "covered")


@check("repair_sections", sql("kp sec", "SELECT timeline_id, ord, start_time, least(end_time, 1500000) AS end_time FROM sec WHERE start_time < 1500000"))
def _(s, d):
    return V.repair_sections(sections(s, d).withColumn("duration", F.lit(1_500_000.0))).select("timeline_id", "ord", "start_time", "end_time")


@check("default_sections", sql("kp sec", """has AS (SELECT timeline_id, name, ord, start_time, end_time FROM sec WHERE timeline_id IN (SELECT timeline_id FROM kp WHERE intensity > 80)), tl AS (SELECT timeline_id, max(t) AS d FROM kp GROUP BY 1)
SELECT * FROM has UNION ALL SELECT timeline_id, 'Section ' || (i + 1), i, i * 100000e0, least((i + 1) * 100000e0, d) FROM tl, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(d / 100000) AS BIGINT) - 1)) AS i) WHERE timeline_id NOT IN (SELECT timeline_id FROM has)"""))
def _(s, d):
    tl = points(s, d).groupBy("timeline_id").agg(F.max("t").alias("duration"))
    loud = points(s, d).filter("intensity > 80").select("timeline_id").distinct()
    return V.default_sections(tl, sections(s, d).join(loud, "timeline_id", "left_semi"), 100_000.0)
