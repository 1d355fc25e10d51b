"""Checks of the operators that build, merge and cut segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.points import ALLOC, NORM, SCORED, WEIGHTS
from checks.roles import SPAN, check, cues, detections, keypoints, points, sections, shots, spans, sql
from spanloom.operators import points as P
from spanloom.operators import segments as G

KEPT = "type in ('click', 'error')"

# segments of whole timelines from two kinds of events
SEG = f"""mk AS (SELECT DISTINCT timeline_id, t FROM kp WHERE type IN ('click', 'error') UNION SELECT timeline_id, 0e0 FROM kp UNION SELECT timeline_id, {SPAN}::DOUBLE FROM kp),
seg AS (SELECT timeline_id, t AS start_time, lead(t) OVER (PARTITION BY timeline_id ORDER BY t) AS end_time FROM mk),
sg AS (SELECT timeline_id, start_time, end_time, end_time - start_time AS duration FROM seg WHERE end_time - start_time >= 1)"""
MERGED = SEG + """,
sh AS (SELECT *, sum(CASE WHEN duration >= 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY start_time) AS g FROM sg),
mg AS (SELECT timeline_id, min(start_time) AS start_time, max(end_time) AS end_time, max(end_time) - min(start_time) AS duration FROM sh GROUP BY timeline_id, g)"""


def _segments(s, d):
    k = keypoints(s, d)
    bounds = k.select("timeline_id", F.lit(0.0).alias("start_time"), F.lit(SPAN).alias("end_time")).distinct()
    return G.segments_from_points(k.filter(KEPT), bounds)


@check("segments_from_points", sql("kp", SEG + " SELECT * FROM sg"))
def _(s, d):
    return _segments(s, d)


@check("merge_short_back", sql("kp", MERGED + " SELECT * FROM mg"))
def _(s, d):
    return G.merge_short_back(_segments(s, d), 30_000.0)


# the leading short segments: the first joins the second, later ones that stay short are dropped
@check("preview_segments", sql("kp", SEG + """,
n1 AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY timeline_id) AS n, lag(start_time) OVER w AS ps, lag(duration) OVER w AS pd FROM sg WINDOW w AS (PARTITION BY timeline_id ORDER BY start_time)),
n2 AS (SELECT timeline_id, i, n, end_time AS e, CASE WHEN i = 2 AND pd < 30000 THEN ps ELSE start_time END AS st, CASE WHEN i = 2 AND pd < 30000 THEN 'merged' ELSE 'original' END AS status FROM n1),
n3 AS (SELECT *, sum(CASE WHEN e - st >= 30000 OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY i) AS g FROM n2),
n4 AS (SELECT timeline_id, g, min(st) AS st, max(e) AS e, CASE WHEN count(*) > 1 THEN 'merged' ELSE min(status) END AS status FROM n3 WHERE g > 0 GROUP BY ALL),
n5 AS (SELECT *, CASE WHEN e - st > 100000 THEN CAST(ceil((e - st) / 100000) AS INT) ELSE 1 END AS p FROM n4)
SELECT timeline_id, CASE WHEN p = 1 THEN st ELSE st + j * ((e - st) / p) END AS "start", CASE WHEN j = p - 1 THEN e ELSE st + (j + 1) * ((e - st) / p) END AS "end",
 CASE WHEN p > 1 THEN 'split' ELSE status END AS status FROM n5, LATERAL (SELECT unnest(generate_series(0, p - 1)) AS j)"""))
def _(s, d):
    k = keypoints(s, d)
    dur = k.select("timeline_id", F.lit(SPAN).alias("duration")).distinct()
    return G.preview_segments(k.filter(KEPT), dur, 30_000.0, 100_000.0).drop("duration")


# over-long segments and the strongest interior instants, one greedy pick per recursion step
STRONG = """, lg AS (SELECT *, CAST(ceil(duration / 60000) AS INT) - 1 AS need FROM mg WHERE duration > 60000),
cand AS (SELECT lg.timeline_id, start_time, end_time, need, list({{'v': -normalized_intensity, 't': t, 'id': id}} ORDER BY -normalized_intensity, t, id) AS open
  FROM lg JOIN norm ON norm.timeline_id = lg.timeline_id AND t > start_time AND t < end_time GROUP BY ALL),
able AS (SELECT * REPLACE (list_filter(open, lambda x: x.t - start_time >= 20000 AND end_time - x.t >= 20000) AS open) FROM cand),
pk AS (SELECT timeline_id, start_time, end_time, need, open, CAST([] AS DOUBLE[]) AS got FROM able
  UNION ALL SELECT timeline_id, start_time, end_time, need, list_filter(open, lambda x: abs(x.t - open[1].t) >= 20000), list_append(got, open[1].t) FROM pk WHERE len(open) > 0 AND len(got) < need),
fin AS (SELECT timeline_id, start_time, end_time, list_concat(list_concat([start_time], list_sort(got)), [end_time]) AS marks FROM pk QUALIFY row_number() OVER (PARTITION BY timeline_id, start_time ORDER BY len(got) DESC) = 1),
cut AS (SELECT timeline_id, marks[i] AS start_time, marks[i + 1] AS end_time FROM fin, LATERAL (SELECT unnest(generate_series(1, len(marks) - 1)) AS i))""".replace("{{", "{").replace("}}", "}")


@check("split_at_strongest", sql("kp", "recursive:" + NORM + ", " + MERGED + STRONG + """
SELECT timeline_id, start_time, end_time, end_time - start_time AS duration FROM cut WHERE end_time - start_time >= 20000
UNION ALL SELECT timeline_id, start_time, end_time, duration FROM mg WHERE duration <= 60000
UNION ALL SELECT timeline_id, a, b, b - a FROM (SELECT timeline_id, CASE WHEN i = 0 THEN start_time ELSE start_time + i * (duration / (need + 1)) END AS a,
  CASE WHEN i = need THEN end_time ELSE start_time + (i + 1) * (duration / (need + 1)) END AS b
  FROM lg ANTI JOIN cand USING (timeline_id, start_time), LATERAL (SELECT unnest(generate_series(0, need)) AS i)) WHERE b - a >= 20000"""))
def _(s, d):
    seg = G.merge_short_back(_segments(s, d), 30_000.0)
    return G.split_at_strongest(seg, P.normalize_by_type(points(s, d)), 20_000.0, 60_000.0)


NEAR = """, lg AS (SELECT *, CAST(ceil(duration / 60000) AS INT) - 1 AS k FROM mg WHERE duration > 60000),
cand AS (SELECT lg.timeline_id, start_time, end_time, lg.k, list({'t': t, 'v': normalized_intensity, 'id': id} ORDER BY t, id) FILTER (id IS NOT NULL) AS c
  FROM lg LEFT JOIN norm ON norm.timeline_id = lg.timeline_id AND t > start_time AND t < end_time GROUP BY ALL),
st AS (SELECT timeline_id, start_time, end_time, k, 0 AS i, c, CAST([] AS DOUBLE[]) AS got FROM cand
  UNION ALL SELECT timeline_id, start_time, end_time, k, i + 1, CASE WHEN b IS NULL THEN c ELSE list_filter(c, lambda x: x.id <> b.id) END, list_append(got, coalesce(b.t, mid)) FROM (
    SELECT *, CASE WHEN len(n) > 0 THEN list_sort(list_transform(n, lambda x: {'a': -x.v, 't': x.t, 'id': x.id}))[1]
                   ELSE list_sort(list_transform(c, lambda x: {'a': abs(x.t - mid), 't': x.t, 'id': x.id}))[1] END AS b FROM (
      SELECT *, list_filter(c, lambda x: x.t >= mid - 9000 AND x.t <= mid + 9000) AS n FROM (SELECT *, start_time + (i + 1) * ((end_time - start_time) / (k + 1)) AS mid FROM st WHERE i < k)))),
fin AS (SELECT timeline_id, start_time, end_time, list_concat(list_concat([start_time], list_sort(list_distinct(got))), [end_time]) AS marks FROM st WHERE i = k),
cut AS (SELECT timeline_id, marks[i] AS start_time, marks[i + 1] AS end_time FROM fin, LATERAL (SELECT unnest(generate_series(1, len(marks) - 1)) AS i))"""


@check("split_near_midpoints", sql("kp", "recursive:" + NORM + ", " + MERGED + NEAR + """
SELECT timeline_id, start_time, end_time, end_time - start_time AS duration FROM cut WHERE end_time - start_time >= 5000
UNION ALL SELECT timeline_id, start_time, end_time, duration FROM mg WHERE duration <= 60000"""))
def _(s, d):
    seg = G.merge_short_back(_segments(s, d), 30_000.0)
    return G.split_near_midpoints(seg, P.normalize_by_type(points(s, d)), 60_000.0, 9_000.0, min_len=5_000.0)


SNAP = f"""recursive: {SCORED}, {ALLOC}, mk AS (SELECT timeline_id, list_sort(list_distinct(list_concat(list(t), [0e0, {SPAN}::DOUBLE]))) AS m FROM best GROUP BY 1),
s1 AS (SELECT timeline_id, list({{'ord': ord, 'e': end_time}} ORDER BY ord) AS secs FROM sec GROUP BY 1),
base AS (SELECT s1.timeline_id, secs, coalesce(m, [0e0, {SPAN}::DOUBLE]) AS m FROM s1 LEFT JOIN mk USING (timeline_id)),
wk AS (SELECT timeline_id, secs, m, 0 AS i, 0e0 AS s, 0e0 AS e FROM base
  UNION ALL SELECT timeline_id, secs, m, i + 1, e, CASE WHEN i + 1 = len(secs) THEN {SPAN}::DOUBLE ELSE
    coalesce(list_sort(list_transform(list_filter(m, lambda x: x > e + 1), lambda x: {{'d': abs(x - secs[i + 1].e), 'x': x}}))[1].x, secs[i + 1].e) END FROM wk WHERE i < len(secs))
SELECT timeline_id, secs[i].ord AS ord, s AS start_time, e AS end_time FROM wk WHERE i > 0"""


@check("snap_sections", sql("kp sec", SNAP))
def _(s, d):
    scored = P.composite_score(P.normalize_by_type(points(s, d)), WEIGHTS)
    slots = P.allocate_slots(scored, sections(s, d), 20)
    kept = P.topk_per_section(scored, slots)
    return G.snap_sections(sections(s, d), kept).select("timeline_id", "ord", "start_time", "end_time")


TURNS = """f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_sec - lag(end_sec) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM cues WINDOW w AS (PARTITION BY timeline_id ORDER BY start_sec, "index")),
g AS (SELECT *, sum(new) OVER (PARTITION BY timeline_id ORDER BY start_sec, "index") AS g FROM f)"""


@check("merge_turns", sql("cues", TURNS + """ SELECT timeline_id, min(start_sec) AS "start", last(end_sec ORDER BY start_sec) AS "end", any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY start_sec, "index") AS text, count(*) AS turns FROM g GROUP BY timeline_id, g"""))
def _(s, d):
    c = cues(s, d).select("timeline_id", F.col("index").alias("ord"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "speaker", "text")
    return G.merge_turns(c)


@check("merge_intervals", sql("spans", """r AS (SELECT *, max("end") OVER (PARTITION BY timeline_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR "start" - far > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM r),
m AS (SELECT timeline_id, min("start") AS s, max("end") AS e FROM g GROUP BY timeline_id, g)
SELECT timeline_id, greatest(0, s - 500) AS "start", e + 500 AS "end" FROM m WHERE e - s >= 20000"""))
def _(s, d):
    return G.merge_intervals(spans(s, d), 2_000.0, 20_000.0, 500.0)


@check("flags_to_intervals", sql("kp", """n AS (SELECT timeline_id, t, k >= 40 AS flag, lead(t) OVER w AS nt, row_number() OVER w - row_number() OVER (PARTITION BY timeline_id, k >= 40 ORDER BY t) AS g FROM kp WINDOW w AS (PARTITION BY timeline_id ORDER BY t))
SELECT timeline_id, min(t) AS "start", max(coalesce(nt, t)) + 25 AS "end" FROM n WHERE flag GROUP BY timeline_id, g"""))
def _(s, d):
    return G.flags_to_intervals(keypoints(s, d).select("timeline_id", "t", (F.col("k") >= 40).alias("flag")), 25.0)


RUNS = """n AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY t) - row_number() OVER (PARTITION BY timeline_id, type ORDER BY t) AS g FROM kp),
r AS (SELECT timeline_id, type AS label, min(t) AS "start", max(t) + 60 AS "end", max(intensity) AS score FROM n GROUP BY timeline_id, type, g)"""


def _runs(s, d):
    return G.compress_runs(points(s, d).select("timeline_id", F.col("t").alias("start"), (F.col("t") + 60).alias("end"), F.col("type").alias("label"), F.col("intensity").alias("score")))


@check("compress_runs", sql("kp", RUNS + """ SELECT timeline_id, label, "start", "end", score FROM r"""))
def _(s, d):
    return _runs(s, d)


@check("longest_run", sql("kp", RUNS + """ SELECT timeline_id, label FROM r QUALIFY row_number() OVER (PARTITION BY timeline_id ORDER BY "end" - "start" DESC, "start") = 1"""))
def _(s, d):
    return G.longest_run(_runs(s, d))


@check("boundary_deoverlap", sql("shots", """SELECT timeline_id, ord, coalesce(lag(end_frame) OVER (PARTITION BY timeline_id ORDER BY ord) + 1, start_frame) AS start_frame, end_frame FROM shots"""))
def _(s, d):
    return G.boundary_deoverlap(shots(s, d).select("timeline_id", "ord", "start_frame", "end_frame"))


@check("split_fixed", sql("shots", """x AS (SELECT timeline_id, ord, start_frame AS a, end_frame AS z FROM shots)
SELECT timeline_id, ord, a + j * 120 AS start_frame, CASE WHEN z - a + 1 <= 120 THEN z ELSE least(a + j * 120 + 119, z) END AS end_frame FROM x,
LATERAL (SELECT unnest(generate_series(0, CASE WHEN z - a + 1 <= 120 THEN 0 ELSE (z - a) // 120 END)) AS j)"""))
def _(s, d):
    return G.split_fixed(shots(s, d).select("timeline_id", "ord", "start_frame", "end_frame"), 2.0, 60.0)


@check("fixed_windows", sql("kp", """f AS (SELECT timeline_id, t, row_number() OVER (PARTITION BY timeline_id ORDER BY t, id) - 1 AS n FROM kp), u AS (SELECT * FROM f WHERE n % 2 = 0 AND t >= 1000),
l AS (SELECT timeline_id, CAST(trunc(max(t)) AS BIGINT) AS last FROM u GROUP BY 1),
w AS (SELECT timeline_id, ws AS window_start, least(ws + 86400 - 1, last) AS window_end FROM l, LATERAL (SELECT unnest(generate_series(1000, last, 86400)) AS ws))
SELECT w.timeline_id, window_start, window_end, count(u.t) AS frames FROM w LEFT JOIN u ON u.timeline_id = w.timeline_id AND u.t >= window_start AND u.t <= window_end GROUP BY ALL"""))
def _(s, d):
    from spanloom.operators.intervals import frames_in_clips
    from spanloom.operators.ordered import scan
    f = scan(points(s, d).select("timeline_id", "id", "t"), tie=["id"], run={"n": ("sum", F.lit(1))}).select("timeline_id", "t", (F.col("n") - 1).alias("frame_idx"))
    w, used = G.fixed_windows(f, 86_400, start=1000, source_fps=2, target_fps=1)
    hit = frames_in_clips(used.select("timeline_id", "t"), w, frame="t", cols=("window_start", "window_end"), mode="closed")
    n = hit.groupBy("timeline_id", "window_start").agg(F.count(F.lit(1)).alias("frames"))
    return w.join(n, ["timeline_id", "window_start"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


@check("subclips", sql("shots", """x AS (SELECT timeline_id, ord, start_frame, end_frame, start_frame / 2e0 AS a, end_frame / 2e0 AS z FROM shots),
y AS (SELECT *, z - a > 45 AS sub FROM x), w AS (SELECT y.*, j, CASE WHEN sub THEN a + j * 45e0 ELSE a END AS cs, CASE WHEN sub THEN least(a + (j + 1) * 45e0, z) ELSE z END AS ce FROM y,
 LATERAL (SELECT unnest(generate_series(0, CASE WHEN sub THEN CAST(ceil((z - a) / 45e0) AS INT) - 1 ELSE 0 END)) AS j))
SELECT timeline_id, ord, sub AS is_sub_clip, CASE WHEN sub THEN j END AS sub_idx, cs AS clip_start, ce AS clip_end,
 CASE WHEN sub THEN CAST(trunc(cs * 2) AS BIGINT) ELSE start_frame END AS first_frame, CASE WHEN sub THEN CAST(trunc(ce * 2) AS BIGINT) ELSE end_frame END - 1 AS last_frame,
 CAST(trunc(cs) AS BIGINT) || '_' || CAST(trunc(ce) AS BIGINT) || CASE WHEN sub THEN '_shot' || ord || '_sub' || j ELSE '' END AS clip_key FROM w"""))
def _(s, d):
    x = shots(s, d).select("timeline_id", "ord", "start_frame", "end_frame")
    return G.subclips(x, 45.0, shot="ord").drop("start_frame", "end_frame")


@check("stitch_windows", sql("shots", """x AS (SELECT timeline_id, ord, "start", "end", CASE ord % 3 WHEN 0 THEN 'Hard Cut' WHEN 1 THEN 'Motion' END AS visual_type FROM shots),
f AS (SELECT *, CASE WHEN abs("start" - lag("end") OVER w) < 0.1 AND NOT (visual_type IS NOT NULL AND visual_type ILIKE '%cut%') THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY timeline_id ORDER BY "start", ord)),
g AS (SELECT *, sum(new) OVER (PARTITION BY timeline_id ORDER BY "start", ord) AS g FROM f),
m AS (SELECT timeline_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY timeline_id, g)
SELECT timeline_id, "start", "end", CAST(trunc("start" * 2) AS BIGINT) AS start_frame, CAST(trunc("end" * 2) AS BIGINT) AS end_frame FROM m WHERE trunc("end" * 2) > trunc("start" * 2)"""))
def _(s, d):
    x = shots(s, d).withColumn("visual_type", F.when(F.col("ord") % 3 == 0, "Hard Cut").when(F.col("ord") % 3 == 1, "Motion"))
    return G.stitch_windows(x)


@check("segments_to_cuts", sql("kp", """x AS (SELECT timeline_id, CAST(floor(t / 86400) AS BIGINT) AS w, t, type, row_number() OVER (PARTITION BY timeline_id, CAST(floor(t / 86400) AS BIGINT) ORDER BY t) AS n FROM kp)
SELECT timeline_id, w * 86400e0 AS start_sec, w * 86400e0 + (t - w * 86400e0) AS "timestamp", type FROM x WHERE CASE WHEN timeline_id % 2 = 0 THEN n > 1 ELSE TRUE END"""))
def _(s, d):
    w = F.floor(F.col("t") / 86400).cast("bigint")
    x = points(s, d).select("timeline_id", (w * 86400.0).alias("start_sec"), (F.col("t") - w * 86400.0).alias("rel"), "type")
    rows = F.array_sort(F.collect_list(F.struct("rel", "type")))
    g = x.groupBy("timeline_id", "start_sec").agg(rows.alias("r"))
    seg = F.transform("r", lambda p, i: F.struct((i + 1).alias("id"), p["rel"].alias("start_time"), p["type"].alias("visual_type")))
    old = F.transform("r", lambda p: F.struct(p["rel"].alias("timestamp"), p["type"].alias("type")))
    g = g.select("timeline_id", "start_sec", F.when(F.col("timeline_id") % 2 == 0, seg).alias("segments"), old.alias("boundaries"))
    return G.segments_to_cuts(g, boundaries="boundaries")


@check("cuts_to_segments", sql("kp", """x AS (SELECT timeline_id, CAST(floor(t / 86400) AS BIGINT) AS w, CAST(floor(t / 7200) AS BIGINT) * 7200e0 AS b, min_by(type, t) AS type FROM kp GROUP BY ALL),
m AS (SELECT timeline_id, w, b AS z, type FROM x WHERE b > w * 86400 UNION ALL SELECT DISTINCT timeline_id, w, (w + 1) * 86400e0, 'End' FROM x)
SELECT timeline_id, coalesce(lag(z) OVER (PARTITION BY timeline_id, w ORDER BY z), w * 86400e0) AS "start", z AS "end", type AS visual_type FROM m"""))
def _(s, d):
    w = F.floor(F.col("t") / 86400).cast("bigint")
    b = F.struct((F.floor(F.col("t") / 7200) * 7200.0).alias("timestamp"), "type")
    # boundaries in time order, several may fall on one two-hour mark
    rows = F.transform(F.array_sort(F.collect_list(F.struct("t", b.alias("b")))), lambda p: p["b"])
    g = points(s, d).groupBy("timeline_id", w.alias("w")).agg(rows.alias("boundaries"))
    return G.cuts_to_segments(g.select("timeline_id", (F.col("w") * 86400.0).alias("start_sec"), ((F.col("w") + 1) * 86400.0).alias("end_sec"), "boundaries"))


@check("sample_frames", sql("shots", """x AS (SELECT timeline_id, ord, start_frame AS a, end_frame AS z, end_frame - start_frame + 1 AS n FROM shots), y AS (SELECT *, greatest(6, least(n, 128)) AS k FROM x)
SELECT timeline_id, ord, CASE WHEN k >= n THEN a + j ELSE CAST(trunc(a + j * (n / k)) AS BIGINT) END AS sample FROM y, LATERAL (SELECT unnest(generate_series(0, CASE WHEN k >= n THEN n - 1 ELSE k - 1 END)) AS j)"""))
def _(s, d):
    x = G.sample_frames(shots(s, d).select("timeline_id", "ord", "start_frame", "end_frame"))
    return x.select("timeline_id", "ord", F.explode("samples").alias("sample"))


@check("sample_times", sql("cues", """x AS (SELECT timeline_id, "index", floor(start_sec) AS s, floor(start_sec) + n / 40e0 AS e FROM cues),
y AS (SELECT *, s + i * (1 / 3e0) AS t FROM x, LATERAL (SELECT unnest(generate_series(0, greatest(1, CAST(ceil((e - s) / (1 / 3e0)) AS INT)) - 1)) AS i))
SELECT timeline_id, "index", CAST(round_even(t * 2, 0) AS BIGINT) AS frame_idx, min(t) AS t FROM y WHERE t <= e GROUP BY ALL"""))
def _(s, d):
    c = cues(s, d).select("timeline_id", "index", F.floor("start_sec").cast("double").alias("start"), (F.floor("start_sec") + F.col("n") / 40.0).alias("end"))
    return G.sample_times(c, 3.0).select("timeline_id", "index", "frame_idx", "t")


def _music(s, d):
    """Sections of one day with the sum of their event values per second."""
    o = F.floor(F.col("t") / 86400).cast("bigint")
    x = points(s, d).groupBy("timeline_id", o.alias("ord")).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("duration", (F.col("n") * 5 + F.col("ord") % 3).cast("double")).withColumn("avg_intensity", F.col("n") / F.col("duration"))


MUSIC = """mu AS (SELECT timeline_id, CAST(floor(t / 86400) AS BIGINT) AS ord, count(*) AS n FROM kp GROUP BY ALL),
mus AS (SELECT timeline_id, ord, row_number() OVER (PARTITION BY timeline_id ORDER BY ord) AS i, n * 5e0 + ord % 3 AS duration, n / (n * 5e0 + ord % 3) AS avg_intensity FROM mu)"""


@check("climax_section", sql("kp", "recursive:" + MUSIC + """,
l AS (SELECT timeline_id, list({'ord': ord, 'd': duration} ORDER BY i) AS r FROM mus GROUP BY 1),
b AS (SELECT timeline_id, i, duration FROM mus QUALIFY row_number() OVER (PARTITION BY timeline_id ORDER BY avg_intensity DESC, ord) = 1),
g AS (SELECT timeline_id, r, i AS lo, i AS hi, duration AS total, 1 AS side, 0 AS still FROM b JOIN l USING (timeline_id)
  UNION ALL SELECT timeline_id, r, CASE WHEN side = -1 AND ok THEN lo - 1 ELSE lo END, CASE WHEN side = 1 AND ok THEN hi + 1 ELSE hi END, CASE WHEN ok THEN total + x ELSE total END, -side, CASE WHEN ok THEN 0 ELSE still + 1 END
  FROM (SELECT *, coalesce(total + x <= 60, false) AS ok FROM (SELECT *, CASE WHEN side = 1 THEN CASE WHEN hi < len(r) THEN r[hi + 1].d END ELSE CASE WHEN lo > 1 THEN r[lo - 1].d END END AS x FROM g WHERE total < 40 AND still < 3)))
SELECT timeline_id, r[lo].ord AS first_ord, r[hi].ord AS last_ord, total FROM g QUALIFY row_number() OVER (PARTITION BY timeline_id ORDER BY total DESC, still DESC) = 1"""))
def _(s, d):
    return G.climax_section(_music(s, d), 40.0)


MSEC = """w AS (SELECT * FROM sec WHERE ord IN (2, 3, 4)), m AS (SELECT timeline_id, string_agg(name, ' + ' ORDER BY ord) AS name, arg_min(start_time, ord) AS s, arg_max(end_time, ord) AS e FROM w GROUP BY 1)"""


@check("merge_sections", sql("kp sec", MSEC + """ SELECT m.timeline_id, m.name, s AS start_time, e AS end_time, kp.id, (t - w.start_time) + (w.start_time - s) AS "start" FROM m JOIN w USING (timeline_id) JOIN kp ON kp.timeline_id = w.timeline_id AND CAST(floor(t / 259200e0) AS BIGINT) = w.ord"""))
def _(s, d):
    sec = sections(s, d)
    o = F.floor(F.col("t") / 259200.0).cast("bigint")
    kids = points(s, d).select("timeline_id", "id", o.alias("ord"), (F.col("t") - o * 259200.0).alias("start"), (F.col("t") - o * 259200.0 + 1).alias("end"))
    m, k = G.merge_sections(sec, sec.filter("ord in (2, 3, 4)"), kids)
    return m.join(k.select("timeline_id", "id", "start"), "timeline_id").drop("merged_ords")
