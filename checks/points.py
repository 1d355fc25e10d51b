"""Checks of the operators on instants."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.roles import SPAN, check, keypoints, points, sections, sql, table
from spanloom.operators import points as P
from spanloom.plans import song

# the same normalisation in SQL, used by several checks
NORM = """used AS (SELECT * EXCLUDE (intensity), coalesce(activation, intensity, 0.5) AS intensity FROM kp),
norm AS (SELECT *, CASE WHEN max(intensity) OVER w - min(intensity) OVER w > 1e-6
  THEN (intensity - min(intensity) OVER w) / (max(intensity) OVER w - min(intensity) OVER w) ELSE 0.5e0 END AS normalized_intensity
  FROM used WINDOW w AS (PARTITION BY timeline_id, type))"""
SCORED = NORM + """,
scored AS (SELECT *, normalized_intensity * CASE type WHEN 'click' THEN 1.0e0 WHEN 'view' THEN 0.6e0 WHEN 'purchase' THEN 0.8e0 ELSE (1.0e0 + 0.6e0 + 0.8e0) / 3e0 END AS composite_score FROM norm)"""
WEIGHTS = {"click": 1.0, "view": 0.6, "purchase": 0.8}
OUT = ["timeline_id", "id", "t", "type", "normalized_intensity"]


@check("normalize_by_type", sql("kp", NORM + " SELECT timeline_id, id, t, type, intensity, normalized_intensity FROM norm"))
def _(s, d):
    return P.normalize_by_type(points(s, d)).select("timeline_id", "id", "t", "type", "intensity", "normalized_intensity")


@check("composite_score", sql("kp", SCORED + " SELECT timeline_id, id, composite_score FROM scored"))
def _(s, d):
    return P.composite_score(P.normalize_by_type(points(s, d)), WEIGHTS).select("timeline_id", "id", "composite_score")


@check("type_stats", sql("kp", SCORED + " SELECT timeline_id, type, count(*) AS points, round(avg(composite_score), 9) AS mean_score FROM scored GROUP BY ALL"))
def _(s, d):
    x = P.type_stats(P.composite_score(P.normalize_by_type(points(s, d)), WEIGHTS))
    return x.withColumn("mean_score", F.round("mean_score", 9))


@check("filter_types", sql("kp", NORM + """ SELECT 'only' AS mode, timeline_id, id, intensity, normalized_intensity, NULL::BOOLEAN AS type_boosted FROM norm WHERE type ILIKE '%ic%' OR type ILIKE '%view%'
UNION ALL SELECT 'exclude', timeline_id, id, intensity, normalized_intensity, NULL FROM norm WHERE NOT (type ILIKE '%ic%' OR type ILIKE '%view%')
UNION ALL SELECT 'boost', timeline_id, id, CASE WHEN b THEN intensity * 1.5e0 ELSE intensity END, CASE WHEN b THEN least(1, normalized_intensity * 1.5e0) ELSE normalized_intensity END, b
  FROM (SELECT *, type ILIKE '%ic%' OR type ILIKE '%view%' AS b FROM norm)"""))
def _(s, d):
    n = P.normalize_by_type(points(s, d)).select("timeline_id", "id", "type", "intensity", "normalized_intensity")
    out = None
    for mode in ("only", "exclude", "boost"):
        x = P.filter_types(n, mode, ["IC", "View"], 1.5).withColumn("mode", F.lit(mode))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.drop("type")


@check("select_types", sql("kp", "SELECT timeline_id, id, type FROM kp WHERE type IN ('click', 'error')"))
def _(s, d):
    return P.select_types(points(s, d), [" click ", "error"]).select("timeline_id", "id", "type")


@check("percentile_filter", sql("kp", NORM + """, thr AS (SELECT timeline_id, quantile_cont(normalized_intensity, 0.75) AS q FROM norm GROUP BY 1)
SELECT timeline_id, id, normalized_intensity FROM norm JOIN thr USING (timeline_id) WHERE normalized_intensity >= q"""))
def _(s, d):
    return P.percentile_filter(P.normalize_by_type(points(s, d)), 75).select("timeline_id", "id", "normalized_intensity")


@check("time_slice", sql("kp", "SELECT timeline_id, id, t FROM kp WHERE t >= 100000 AND t <= 900000"))
def _(s, d):
    return P.time_slice(points(s, d), 100_000, 900_000).select("timeline_id", "id", "t")


@check("union_detectors", sql("kp", """SELECT timeline_id, t, 'click' AS type, intensity, NULL::INT AS k FROM kp WHERE type = 'click'
UNION ALL SELECT timeline_id, t, 'view', intensity, k FROM kp WHERE type = 'view'"""))
def _(s, d):
    k = keypoints(s, d)
    return P.union_detectors(k.filter("type = 'click'").select("timeline_id", "t", "type", "intensity"),
                             k.filter("type = 'view'").select("timeline_id", "t", "type", "intensity", "k"))


@check("downbeats", sql("kp", """act AS (SELECT timeline_id, CAST(floor(t / 600) AS BIGINT) AS f, max(activation) AS a FROM kp GROUP BY ALL),
lim AS (SELECT timeline_id, max(f) AS last FROM act GROUP BY 1)
SELECT b.timeline_id, b.id, b.t, coalesce(act.a, 0.5e0) AS activation, coalesce(act.a, 0.5e0) AS intensity, 'Downbeat' AS type
FROM kp b JOIN lim USING (timeline_id) LEFT JOIN act ON act.timeline_id = b.timeline_id AND act.f = greatest(0, least(CAST(trunc(b.t * (1e0 / 600)) AS BIGINT), lim.last))
WHERE b.k % 4 = 1"""))
def _(s, d):
    k = keypoints(s, d)
    act = k.groupBy("timeline_id", F.floor(F.col("t") / 600).alias("frame_idx")).agg(F.max("activation").alias("activation"))
    beats = k.select("timeline_id", "id", "t", (F.col("k") % 4).alias("beat"))
    return P.downbeats(beats, act, fps=1.0 / 600).drop("beat")


# ---------------------------------------------------------------- suppression, with the greedy pass as a recursive query

def nms_sql(rows: str, dist: float, value: str = "v") -> str:
    """Greedy pass: of the open rows of a timeline the strongest is kept and clears its neighbourhood."""
    return f"""recursive: src AS ({rows}),
step AS (
  SELECT timeline_id, list({{'v': -{value}, 't': t, 'id': id}} ORDER BY -{value}, t, id) AS open, NULL::DOUBLE AS t, NULL::BIGINT AS id, 0 AS n FROM src GROUP BY timeline_id
  UNION ALL
  SELECT timeline_id, list_filter(open, lambda x: abs(x.t - open[1].t) >= {dist}), open[1].t, open[1].id, n + 1 FROM step WHERE len(open) > 0),
kept AS (SELECT timeline_id, t, id, n FROM step WHERE n > 0)"""


@check("nms_time", sql("kp", nms_sql("SELECT timeline_id, t, id, intensity AS v FROM kp WHERE intensity >= 5", 90_000.0) + " SELECT timeline_id, t, id FROM kept WHERE n <= 12"))
def _(s, d):
    return P.nms_time(points(s, d), 90_000.0, 5.0, 12).select("timeline_id", "t", "id")


@check("nms_adaptive", sql("kp", nms_sql("SELECT timeline_id, t, id, intensity AS v FROM kp QUALIFY intensity >= 0.1e0 * max(intensity) OVER (PARTITION BY timeline_id)", 60_000.0)
                           + " SELECT timeline_id, t, id FROM kept"))
def _(s, d):
    return P.nms_adaptive(points(s, d), 60_000.0, 0.1).select("timeline_id", "t", "id")


@check("nms_window", sql("kp", """w AS (SELECT *, floor((t - min(t) OVER (PARTITION BY timeline_id)) / 100000) AS win FROM kp)
SELECT timeline_id, id, t FROM w QUALIFY row_number() OVER (PARTITION BY timeline_id, win ORDER BY intensity DESC, t, id) <= 2"""))
def _(s, d):
    return P.nms_window(points(s, d), 100_000.0, 2).select("timeline_id", "id", "t")


@check("peaks_mel", sql("kp", nms_sql("SELECT timeline_id, t, id, intensity AS v FROM kp QUALIFY intensity >= 0.05e0 * max(intensity) OVER (PARTITION BY timeline_id)", 40_000.0)
                        + """, top AS (SELECT timeline_id, max(intensity) AS m FROM kp GROUP BY 1)
SELECT timeline_id, t, id, 'MelEnergy' AS type, kp.intensity / m AS intensity, kp.intensity / m * 100 AS relative_intensity FROM kept JOIN kp USING (timeline_id, t, id) JOIN top USING (timeline_id)"""))
def _(s, d):
    f = points(s, d).select("timeline_id", "id", "t", F.col("intensity").alias("energy"))
    return P.peaks_mel(f, 0.05, 40_000.0).select("timeline_id", "t", "id", "type", "intensity", "relative_intensity")


@check("peaks_pitch", sql("kp", nms_sql("SELECT timeline_id, t, id, intensity AS v FROM kp WHERE activation >= 0.4", 40_000.0)
                          + " SELECT timeline_id, t, id, 'Pitch' AS type, activation AS intensity FROM kept JOIN kp USING (timeline_id, t, id)"))
def _(s, d):
    f = points(s, d).select("timeline_id", "id", "t", F.col("intensity").alias("pitch"), F.col("activation").alias("confidence"))
    return P.peaks_pitch(f, 0.4, 40_000.0).select("timeline_id", "t", "id", "type", "intensity")


# ---------------------------------------------------------------- spacing

def interval_sql(rows: str, dist: float) -> str:
    """Anchors by recursion: the next anchor is the first row at least ``dist`` after the current one."""
    return f"""recursive: src AS ({rows}),
anchor AS (SELECT timeline_id, min(t) AS a FROM src GROUP BY 1
  UNION ALL SELECT * FROM (SELECT anchor.timeline_id, (SELECT min(t) FROM src WHERE src.timeline_id = anchor.timeline_id AND src.t - anchor.a >= {dist}) AS a FROM anchor) WHERE a IS NOT NULL),
held AS (SELECT src.*, row_number() OVER (PARTITION BY src.timeline_id, anchor.a ORDER BY v DESC, t, id) AS rn
  FROM src ASOF JOIN anchor ON src.timeline_id = anchor.timeline_id AND src.t >= anchor.a)"""


@check("min_interval_best", sql("kp", interval_sql("SELECT timeline_id, t, id, intensity AS v FROM kp", 50_000.0) + " SELECT timeline_id, t, id, v AS intensity FROM held WHERE rn = 1"))
def _(s, d):
    return P.min_interval_best(points(s, d), 50_000.0, score="intensity").select("timeline_id", "t", "id", "intensity")


def spacing_sql(rows: str, dist: float) -> str:
    """Each timeline as a list, walked row by row: the last kept row is replaced by a stronger one within reach."""
    return f"""recursive: ssrc AS ({rows}),
sl AS (SELECT timeline_id, list({{'t': t, 'v': v, 'id': id}} ORDER BY t, id) AS r FROM ssrc GROUP BY 1),
walk AS (SELECT timeline_id, r, 1 AS i, r[1] AS cur, CAST(NULL AS STRUCT(t DOUBLE, v DOUBLE, id BIGINT)) AS done FROM sl
  UNION ALL SELECT timeline_id, r, i + 1,
    CASE WHEN r[i + 1].t - cur.t >= {dist} THEN r[i + 1] WHEN r[i + 1].v > cur.v THEN r[i + 1] ELSE cur END,
    CASE WHEN r[i + 1].t - cur.t >= {dist} THEN cur END FROM walk WHERE i < len(r)),
spaced AS (SELECT timeline_id, done.t AS t, done.id AS id FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT timeline_id, cur.t, cur.id FROM walk WHERE i = len(r))"""


@check("enforce_spacing", sql("kp", spacing_sql(f"""SELECT timeline_id, t, id, intensity AS v FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY t, id) AS a,
  row_number() OVER (PARTITION BY timeline_id ORDER BY t DESC, id DESC) AS z FROM kp)
  WHERE NOT (a = 1 AND t < 40000) AND NOT (z = 1 AND {SPAN}::DOUBLE - t < 40000)""", 40_000.0) + " SELECT timeline_id, t, id FROM spaced"))
def _(s, d):
    return P.enforce_spacing(points(s, d), 40_000.0, SPAN, score="intensity").select("timeline_id", "t", "id")


@check("topk_per_type", sql("kp", NORM + " SELECT timeline_id, id, t, type, normalized_intensity FROM norm QUALIFY row_number() OVER (PARTITION BY timeline_id, type ORDER BY normalized_intensity DESC, t, id) <= 4"))
def _(s, d):
    return P.topk_per_type(P.normalize_by_type(points(s, d)), 4).select(*OUT)


# ---------------------------------------------------------------- sections

ALLOC = """cnt AS (SELECT sec.timeline_id, ord, name, start_time, end_time, count(id) AS points FROM sec
  LEFT JOIN scored ON scored.timeline_id = sec.timeline_id AND t >= start_time AND t < end_time GROUP BY ALL),
sh AS (SELECT *, greatest(1, CAST(round_even(20 * (points / sum(points) OVER w), 0) AS BIGINT)) AS share,
  row_number() OVER (PARTITION BY timeline_id ORDER BY points DESC, ord) AS big FROM cnt WINDOW w AS (PARTITION BY timeline_id)),
alloc AS (SELECT timeline_id, ord, name, start_time, end_time, points,
  CASE WHEN big = 1 THEN greatest(0, share + 20 - sum(share) OVER (PARTITION BY timeline_id)) ELSE share END::BIGINT AS slots FROM sh),
best AS (SELECT * FROM (SELECT scored.*, name AS section, ord, slots, row_number() OVER (PARTITION BY scored.timeline_id, ord ORDER BY composite_score DESC, t, id) AS rn
  FROM scored JOIN alloc ON scored.timeline_id = alloc.timeline_id AND t >= start_time AND t < end_time) WHERE rn <= slots)"""


def _scored(s, d):
    return P.composite_score(P.normalize_by_type(points(s, d)), WEIGHTS)


@check("allocate_slots", sql("kp sec", SCORED + ", " + ALLOC + " SELECT timeline_id, ord, points, slots FROM alloc"))
def _(s, d):
    return P.allocate_slots(points(s, d), sections(s, d), 20).select("timeline_id", "ord", "points", "slots")


@check("topk_per_section", sql("kp sec", SCORED + ", " + ALLOC + " SELECT timeline_id, ord, section, id, t FROM best"))
def _(s, d):
    x = _scored(s, d)
    return P.topk_per_section(x, P.allocate_slots(x, sections(s, d), 20)).select("timeline_id", "ord", "section", "id", "t")


def fill_sql(kept: str, raw: str, gap: float) -> str:
    """Gaps and their candidates as lists; one recursion step per ideal time takes the nearest candidate left."""
    return f"""recursive: gaps AS (SELECT timeline_id, t AS g0, g1, CAST(ceil((g1 - t) / {gap}) AS INT) - 1 AS k FROM
  (SELECT timeline_id, t, lead(t) OVER (PARTITION BY timeline_id ORDER BY t) AS g1 FROM (SELECT DISTINCT timeline_id, t FROM {kept})) WHERE g1 - t > {gap}),
gc AS (SELECT g.timeline_id, g.g0, g.g1, g.k, list({{'t': r.t, 'id': r.id}} ORDER BY r.t, r.id) AS c FROM gaps g JOIN {raw} r ON r.timeline_id = g.timeline_id AND r.t > g.g0 AND r.t < g.g1 GROUP BY ALL),
pick AS (SELECT timeline_id, g0, g1, k, 0 AS j, c, CAST(NULL AS STRUCT(d DOUBLE, t DOUBLE, id BIGINT)) AS p FROM gc
  UNION ALL SELECT timeline_id, g0, g1, k, j + 1, list_filter(c, lambda x: x.id <> b.id), b FROM
   (SELECT *, list_sort(list_transform(c, lambda x: {{'d': abs(x.t - (g0 + (g1 - g0) * (j + 1) / (k + 1))), 't': x.t, 'id': x.id}}))[1] AS b FROM pick WHERE j < k AND len(c) > 0)),
added AS (SELECT timeline_id, p.t AS t, p.id AS id FROM pick WHERE p IS NOT NULL)"""


@check("fill_long_gaps", sql("kp", fill_sql("(SELECT * FROM kp WHERE type IN ('click', 'error'))", "kp", 30_000.0)
                             + " SELECT timeline_id, t, id FROM added UNION ALL SELECT timeline_id, t, id FROM kp WHERE type IN ('click', 'error')"))
def _(s, d):
    k = keypoints(s, d).select("timeline_id", "t", "id", "type")
    return P.fill_long_gaps(k.filter("type in ('click', 'error')"), k, 30_000.0).select("timeline_id", "t", "id")


SIGNIFICANT = NORM + """, thr AS (SELECT timeline_id, quantile_cont(normalized_intensity, 0.3) AS q FROM norm GROUP BY 1), """


@check("filter_significant", sql("kp", "recursive:" + SIGNIFICANT + interval_sql(
    "SELECT timeline_id, t, id, type, normalized_intensity AS v FROM norm JOIN thr USING (timeline_id) WHERE normalized_intensity >= q", 20_000.0).replace("recursive:", "")
    + """ SELECT timeline_id, id, t, type, v AS normalized_intensity FROM held WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY timeline_id, type ORDER BY v DESC, t, id) <= 10"""))
def _(s, d):
    return song.filter_significant(points(s, d), 20_000.0, 10, 30.0).select(*OUT)


@check("edit_points", sql("kp", """n AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY t, id) - 1 AS pos FROM kp WHERE type = 'error'),
gone AS (SELECT id FROM n WHERE pos % 3 = 1)
SELECT timeline_id, id, t, type, intensity FROM kp WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT timeline_id, -id AS id, t + 1, 'Manual', 1.0e0 FROM kp WHERE k = 50"""))
def _(s, d):
    k = keypoints(s, d).select("timeline_id", "id", "t", "type", "intensity", "k")
    count = k.filter("type = 'error'").groupBy("timeline_id").count()
    gone = count.withColumn("position", F.explode(F.sequence(F.lit(0), F.col("count").cast("int")))).filter("position % 3 = 1")
    added = k.filter("k = 50").select("timeline_id", (-F.col("id")).alias("id"), (F.col("t") + 1).alias("t"), F.lit("Manual").alias("type"))
    return P.edit_points(k.drop("k"), added, gone, types=["error"])
