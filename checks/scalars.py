"""Checks of the expressions on single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.roles import check, cues, detections, keypoints, points, shots, sql, table
from spanloom.functions import media as M
from spanloom.functions import text as X
from spanloom.functions import timecode as C

# timecodes of several shapes made from event times; every seventh is broken
TC = """x0 AS (SELECT id, t, k, CAST(floor(t % 86400) AS BIGINT) AS s FROM kp),
x AS (SELECT *, s // 3600 AS h, (s // 60) % 60 AS m, s % 60 AS sec, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hms FROM x0)"""


def _tc(s, d):
    sec = F.floor(F.col("t") % 86400).cast("bigint")
    x = keypoints(s, d).select("id", "t", "k", sec.alias("s"))
    return x.withColumn("hms", F.format_string("%02d:%02d:%02d", F.floor(F.col("s") / 3600), F.floor(F.col("s") / 60) % 60, F.col("s") % 60)) \
        .withColumn("h", F.floor(F.col("s") / 3600)).withColumn("m", F.floor(F.col("s") / 60) % 60).withColumn("sec", F.col("s") % 60)


@check("timecode_to_seconds", sql("kp", TC + """ SELECT id, CASE k % 7 WHEN 0 THEN s + (k % 2) / 2e0 WHEN 1 THEN s + 0.25e0 WHEN 2 THEN m * 60 + sec WHEN 3 THEN s + 0.5e0 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE s END::DOUBLE AS seconds FROM x"""))
def _(s, d):
    k = F.col("k") % 7
    text = (F.when(k == 0, F.concat("hms", F.lit(":0"), F.col("k") % 2)).when(k == 1, F.concat("hms", F.lit(".25")))
            .when(k == 2, F.substring("hms", 4, 5)).when(k == 3, F.concat("s", F.lit(".5"))).when(k == 4, F.concat("hms", F.lit("x")))
            .when(k == 5, F.concat("hms", F.lit(":00:00"))).otherwise(F.concat(F.lit(" "), "hms", F.lit(" "))))
    return _tc(s, d).select("id", C.timecode_to_seconds(text).alias("seconds"))


@check("srt_to_seconds", sql("kp", TC + " SELECT id, CASE WHEN k % 3 = 2 THEN 0e0 ELSE h * 3600 + m * 60 + (sec || '.' || lpad(CAST(k * 7 AS VARCHAR), 3, '0'))::DOUBLE END AS seconds FROM x"))
def _(s, d):
    ms = F.lpad((F.col("k") * 7).cast("string"), 3, "0")
    text = F.when(F.col("k") % 3 == 0, F.concat("hms", F.lit(","), ms)).when(F.col("k") % 3 == 1, F.concat("hms", F.lit("."), ms)).otherwise(F.concat(F.substring("hms", 4, 5), F.lit(","), ms))
    return _tc(s, d).select("id", C.srt_to_seconds(text).alias("seconds"))


@check("mmss_to_seconds", sql("kp", TC + " SELECT id, CASE k % 4 WHEN 0 THEN m * 60 + (sec || '.5')::DOUBLE WHEN 1 THEN s::DOUBLE WHEN 2 THEN 0e0 ELSE 0e0 END AS seconds FROM x"))
def _(s, d):
    k = F.col("k") % 4
    text = F.when(k == 0, F.concat(F.substring("hms", 4, 5), F.lit(".5"))).when(k == 1, F.col("s").cast("string")).when(k == 2, F.col("hms")).otherwise(F.lit("n/a"))
    return _tc(s, d).select("id", C.mmss_to_seconds(text).alias("seconds"))


@check("seconds_to_timecode", sql("kp", """x AS (SELECT id, t % 86400 AS u, k FROM kp), y AS (SELECT *, CAST(floor(u / 3600) AS INT) AS h, CAST(floor((u % 3600) / 60) AS INT) AS m, u % 60 AS s, CAST(floor(u * 1000) AS BIGINT) AS ms FROM x)
SELECT id, printf('%02d:%02d:%02d', h, m, CAST(floor(s) AS INT)) AS hms, printf('%02d:%02d:%04.1f', h, m, s) AS hms1, printf('%02d:%02d:%06.3f', h, m, s) AS hms3,
 printf('%02d:%04.1f', CAST(floor(u / 60) AS INT), s) AS ms1, printf('%02d:%05.2f', CAST(floor(u / 60) AS INT), s) AS ms2,
 printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS srt FROM y"""))
def _(s, d):
    u = F.col("t") % 86400
    return points(s, d).select("id", *[C.seconds_to_timecode(u, x).alias(x) for x in ("hms", "hms1", "hms3", "ms1", "ms2")],
                               C.seconds_to_timecode(F.floor(u * 1000), "srt").alias("srt"))


@check("clip_key_times", sql("kp", """SELECT id, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS "start", CASE WHEN k % 5 = 0 THEN NULL ELSE k + 7.5e0 END AS "end" FROM kp"""))
def _(s, d):
    k = F.col("k")
    key = F.when(k % 5 == 0, F.concat(F.lit("x"), k)).when(k % 2 == 0, F.concat(k, F.lit("_"), k + 7.5)).otherwise(F.concat(k, F.lit("_"), k + 7.5, F.lit("_shot3_sub1")))
    return keypoints(s, d).select("id", C.clip_key_times(key).alias("p")).select("id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@check("timeline_end", sql("kp", """SELECT timeline_id, max(k + 7.5e0) FILTER (k % 5 <> 0) AS timeline_end FROM kp GROUP BY 1"""))
def _(s, d):
    from spanloom.operators.vectors import timeline_end
    k = F.col("k")
    key = F.when(k % 5 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat(k, F.lit("_"), k + 7.5, F.lit("_shot3")))
    return timeline_end(keypoints(s, d), key=key)


@check("time_range", sql("kp", TC + """ SELECT id, CASE WHEN k % 4 = 3 THEN NULL ELSE s::DOUBLE END AS "start", CASE WHEN k % 4 = 3 THEN NULL ELSE s + k + 0.5e0 END AS "end" FROM x"""))
def _(s, d):
    text = F.when(F.col("k") % 4 == 3, F.concat(F.lit("from "), "hms")).otherwise(F.concat(F.lit("use "), "hms", F.lit(" TO "), F.col("s") + F.col("k"), F.lit(".5 and 00:01 to 00:02")))
    return _tc(s, d).select("id", C.time_range(text).alias("p")).select("id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@check("shot_ranges", sql("kp", TC + """ SELECT id, j AS pos, s + j * 10e0 AS "start", s + j * 10e0 + 5 AS "end" FROM x, LATERAL (SELECT unnest(generate_series(0, k % 4 - 1)) AS j)"""))
def _(s, d):
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < F.col("k") % 4),
                        lambda j: F.concat(F.lit("[Shot "), j, F.lit(": "), F.col("s") + j * 10, F.lit(".0 to "), F.col("s") + j * 10 + 5, F.lit("]")))
    x = _tc(s, d).withColumn("text", F.concat(F.lit("pick "), F.array_join(parts, ", ")))
    return x.select("id", F.posexplode(C.shot_ranges("text")).alias("pos", "r")).select("id", F.col("pos").cast("bigint").alias("pos"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))


@check("natural_key", """WITH c AS (SELECT doc_id, 'Clip_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '_Sub' || (doc_id % 17) || '.json' END AS name FROM documents)
SELECT doc_id, name, 'clip_' || lpad(CAST(doc_id AS VARCHAR), 20, '0') || CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '_sub' || lpad(CAST(doc_id % 17 AS VARCHAR), 20, '0') || '.json' END AS key FROM c""")
def _(s, d):
    i = F.col("doc_id")
    name = F.concat(F.lit("Clip_"), i, F.when(i % 2 == 0, F.lit(".json")).otherwise(F.concat(F.lit("_Sub"), i % 17, F.lit(".json"))))
    return table(s, d, "documents").select("doc_id", name.alias("name")).withColumn("key", X.natural_key("name"))


@check("json_lenient", """WITH e AS (SELECT event_id AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
SELECT id, CASE WHEN k % 5 = 4 THEN NULL ELSE k END AS k FROM e""")
def _(s, d):
    p, i = F.col("props"), F.col("event_id")
    k = F.regexp_extract(p, r"(\d+)", 1).cast("int")
    text = (F.when(k % 5 == 0, p).when(k % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k % 5 == 2, F.concat(F.lit("Here you are: "), p, F.lit(" Done.")))
            .when(k % 5 == 3, F.concat(F.lit("  ```\n"), p, F.lit("\n```  "))).otherwise(F.substring(p, 1, 6)))
    return table(s, d, "events").select(i.alias("id"), X.json_lenient(text, "k int")["k"].alias("k"))


@check("first_number", "SELECT doc_id, coalesce(TRY_CAST(regexp_extract(text, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE), 0e0) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.first_number("text").alias("n"))


@check("est_tokens", "SELECT doc_id, length(text) // 3 AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.est_tokens("text").alias("tokens"))


@check("squash_truncate", """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 300 THEN regexp_replace(substr(x, 1, 300), ' [^ ]*$', '') || '…' ELSE x END AS short FROM f""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.squash_truncate("text", 300).alias("short"))


@check("asset_slug", """WITH f AS (SELECT page_id, url, regexp_replace(trim(substr(regexp_replace(url, '[^a-zA-Z0-9_\\s-]', '', 'g'), 1, 50)), ' ', '_', 'g') AS x FROM pages)
SELECT page_id, CASE WHEN x = '' THEN 'instruction' ELSE x END || '_' || substr(md5(url), 1, 8) AS slug FROM f""")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.asset_slug("url").alias("slug"))


@check("caption_text", sql("cues", """x AS (SELECT timeline_id, "index", CASE WHEN "index" % 3 = 0 THEN '' ELSE speaker END AS ev, CASE WHEN "index" % 2 = 0 THEN 'P' || n END AS purpose, CASE WHEN "index" % 4 = 0 THEN '' ELSE 'M' END AS mood,
 CASE WHEN timeline_id % 2 = 0 THEN text END AS legacy FROM cues), y AS (SELECT *, nullif(coalesce(nullif(ev, ''), legacy), '') AS e FROM x)
SELECT timeline_id, "index", e AS event, CASE WHEN e IS NOT NULL THEN 'Event: ' || e || CASE WHEN purpose IS NOT NULL THEN ' Purpose: ' || purpose ELSE '' END || CASE WHEN mood <> '' THEN ' Mood: ' || mood ELSE '' END END AS caption FROM y"""))
def _(s, d):
    i = F.col("index")
    x = cues(s, d).select("timeline_id", "index", F.when(i % 3 == 0, "").otherwise(F.col("speaker")).alias("ev"), F.when(i % 2 == 0, F.concat(F.lit("P"), "n")).alias("purpose"),
                          F.when(i % 4 == 0, "").otherwise("M").alias("mood"), F.when(F.col("timeline_id") % 2 == 0, F.col("text")).alias("legacy"))
    ev, text = X.caption_text("ev", "purpose", "mood", "legacy")
    return x.select("timeline_id", "index", ev.alias("event"), text.alias("caption"))


@check("scene_digest", sql("shots", """SELECT ord, '[Scene ' || ord || '] (' || CASE WHEN ord % 3 = 0 THEN 'N/A' ELSE CAST(start_frame AS VARCHAR) END || ' - ' || end_frame || ')' || chr(10) || 'Location: ' || coalesce(place, '') || ', Time: ' || "time" || chr(10)
 || 'Key Event: ' || function || chr(10) || 'Narrative: ' || lang || chr(10) AS digest FROM shots"""))
def _(s, d):
    start = F.when(F.col("ord") % 3 != 0, F.col("start_frame"))
    return shots(s, d).select("ord", X.scene_digest("ord", start, "end_frame", "place", "time", "function", "lang").alias("digest"))


@check("shot_line", sql("shots", """SELECT ord, '[' || source_filename || '] (' || scale || ') Loc: ' || tags[1] || ', ' || tags[2] || ', ' || lang || '. Chars: ' || CASE WHEN ord % 2 = 0 THEN 'Empty' ELSE tags[1] || ', ' || tags[2] END
 || '. Action: ' || CASE WHEN ord % 3 = 0 THEN 'None' ELSE lang END || ' (' || coalesce(place, '') || '). Func: ' || function || '.' AS line FROM shots"""))
def _(s, d):
    x = shots(s, d)
    tags = F.concat("tags", F.array("lang", F.lit("unused")))
    names = F.when(F.col("ord") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("tags"))
    return x.select("ord", X.shot_line("source_filename", "scale", tags, names, F.when(F.col("ord") % 3 != 0, F.col("lang")), "place", "function").alias("line"))


@check("scale_box", sql("det", """z AS (SELECT id, CASE WHEN boxed THEN bx END AS bx, by_, bw, bh, boxed, 1280 + k AS vw, CASE WHEN k % 2 = 0 THEN 720 ELSE 1920 END AS vh FROM det),
y AS (SELECT *, CASE WHEN vw < vh THEN 360 ELSE CAST(trunc(vw * (360e0 / vh)) AS INT) END AS dw, CASE WHEN vw < vh THEN CAST(trunc(vh * (360e0 / vw)) AS INT) ELSE 360 END AS dh FROM z)
SELECT id, CAST(trunc(bx * (vw / dw)) AS INT) AS x, CASE WHEN boxed THEN CAST(trunc(by_ * (vh / dh)) AS INT) END AS y, CASE WHEN boxed THEN CAST(trunc(bw * (vw / dw)) AS INT) END AS width, CASE WHEN boxed THEN CAST(trunc(bh * (vh / dh)) AS INT) END AS height FROM y"""))
def _(s, d):
    x = detections(s, d).select("id", M.scale_box("bounding_box", F.lit(1280) + F.col("k"), F.when(F.col("k") % 2 == 0, 720).otherwise(1920)).alias("b"))
    return x.select("id", "b.*")


@check("soft_match", sql("shots", """p AS (SELECT timeline_id, ord, place, "time", lag(place) OVER w AS pp, lag("time") OVER w AS pt FROM shots WINDOW w AS (PARTITION BY timeline_id ORDER BY ord))
SELECT ord, CASE WHEN place IS NULL OR pp IS NULL THEN 0.5e0 WHEN lower(place) = lower(pp) THEN 1 WHEN list_sort([lower(place), lower(pp)]) IN (['hybrid', 'interior'], ['exterior', 'hybrid']) THEN 0.6e0
  WHEN list_sort([lower(place), lower(pp)]) = ['exterior', 'space/abstract'] THEN 0.1e0 WHEN list_sort([lower(place), lower(pp)]) = ['exterior', 'interior'] THEN 0.05e0 ELSE 0 END AS place_score,
 CASE WHEN pt IS NULL THEN 0.5e0 WHEN "time" = pt THEN 1 WHEN "time" = 'dawn/dusk' AND pt IN ('day', 'night') OR pt = 'dawn/dusk' AND "time" IN ('day', 'night') THEN 0.6e0
  WHEN "time" IN ('day', 'night') AND pt IN ('day', 'night') THEN 0.1e0 WHEN "time" IN ('day', 'night') AND pt = 'unclear' OR pt IN ('day', 'night') AND "time" = 'unclear' THEN 0.5e0 ELSE 0 END AS time_score FROM p"""))
def _(s, d):
    from spanloom.operators.ordered import scan
    p = scan(shots(s, d).select("timeline_id", "ord", "place", "time"), t="ord", cell=4096, prev={"pp": "place", "pt": "time"})
    return p.select("ord", M.soft_match("place", "pp", M.PLACE_SIMILARITY).alias("place_score"), M.soft_match("time", "pt", M.TIME_SIMILARITY).alias("time_score"))


@check("frame_budget", sql("shots", """x AS (SELECT ord, n_chars AS n, 24e0 + ord % 7 AS fps FROM shots),
y AS (SELECT *, CAST(floor(least(least(greatest(n / fps * 2, 4), floor(least(768, n) / 2) * 2), n) / 2) * 2 AS BIGINT) AS f FROM x)
SELECT ord, CASE WHEN f >= 2 AND f <= n THEN f END AS frames FROM y"""))
def _(s, d):
    return shots(s, d).select("ord", M.frame_budget("n_chars", F.lit(24.0) + F.col("ord") % 7).alias("frames"))


@check("frame_span", sql("shots", """x AS (SELECT ord, n_chars AS n, 24e0 + ord % 7 AS fps, CASE WHEN ord % 3 <> 0 THEN (ord % 50) - 3.5e0 END AS a, CASE WHEN ord % 4 <> 0 THEN (ord % 90) * 1.25e0 END AS z FROM shots),
y AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE CAST(ceil(greatest(0, least(a, n / fps)) * fps) AS BIGINT) END AS f, CASE WHEN z IS NULL THEN n - 1 ELSE least(CAST(floor(greatest(0, least(z, n / fps)) * fps) AS BIGINT), n - 1) END AS l FROM x)
SELECT ord, CASE WHEN ok THEN f END AS start_frame, CASE WHEN ok THEN l END AS end_frame, CASE WHEN ok THEN l - f + 1 END AS frames FROM (SELECT *, (a IS NULL AND z IS NULL) OR f < l AS ok FROM y)"""))
def _(s, d):
    i = F.col("ord")
    x = shots(s, d).select("ord", M.frame_span("n_chars", F.lit(24.0) + i % 7, F.when(i % 3 != 0, (i % 50) - 3.5), F.when(i % 4 != 0, (i % 90) * 1.25)).alias("p"))
    return x.select("ord", "p.*")


@check("fit_resolution", sql("shots", """x AS (SELECT ord, (20 + n_chars % 3000)::DOUBLE AS h, (15 + ord % 5000 * 7)::DOUBLE AS w FROM shots),
y AS (SELECT *, greatest(28, round_even(h / 28, 0) * 28) AS h0, greatest(28, round_even(w / 28, 0) * 28) AS w0, sqrt(h * w / 1000000) AS b, sqrt(3136e0 / (h * w)) AS g FROM x)
SELECT ord, CASE WHEN ok THEN CAST(CASE WHEN h0 * w0 > 1000000 THEN greatest(28, floor(h / b / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(h * g / 28) * 28 ELSE h0 END AS BIGINT) END AS height,
 CASE WHEN ok THEN CAST(CASE WHEN h0 * w0 > 1000000 THEN greatest(28, floor(w / b / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(w * g / 28) * 28 ELSE w0 END AS BIGINT) END AS width FROM (SELECT *, greatest(h, w) / least(h, w) <= 200 AS ok FROM y)"""))
def _(s, d):
    x = shots(s, d).select("ord", M.fit_resolution(F.lit(20) + F.col("n_chars") % 3000, F.lit(15) + F.col("ord") % 5000 * 7, max_pixels=1_000_000).alias("p"))
    return x.select("ord", "p.*")
