"""Checks of the composed pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.points import ALLOC, SCORED, WEIGHTS, fill_sql, interval_sql, spacing_sql
from checks.roles import SPAN, check, keypoints, points, sections, shots, sql
from checks.scenes import ABSORB, _with_vectors
from spanloom.operators import points as P
from spanloom.plans import edit, footage, song
from spanloom.session import materialize

GAP, FILL, SPACE = 15_000.0, 60_000.0, 25_000.0


def _bare(text: str) -> str:
    return text.replace("recursive:", "").strip()


FILTERED = (SCORED + ", " + ALLOC + ", " + _bare(interval_sql("SELECT timeline_id, t, id, composite_score AS v FROM best", GAP)) + """, h1 AS (SELECT timeline_id, t, id FROM held WHERE rn = 1), """
            + _bare(fill_sql("h1", "scored", FILL)) + """, f1 AS (SELECT timeline_id, t, id FROM h1 UNION ALL SELECT timeline_id, t, id FROM added),
f2 AS (SELECT timeline_id, t, id, composite_score AS v, row_number() OVER (PARTITION BY timeline_id ORDER BY t, id) AS a, row_number() OVER (PARTITION BY timeline_id ORDER BY t DESC, id DESC) AS z FROM f1 JOIN scored USING (timeline_id, t, id)), """
            + _bare(spacing_sql(f"SELECT timeline_id, t, id, v FROM f2 WHERE NOT (a = 1 AND t < {SPACE}) AND NOT (z = 1 AND {SPAN}::DOUBLE - t < {SPACE})", SPACE)))


def _filtered(s, d):
    return song.filter_by_sections(points(s, d), sections(s, d), min_interval=GAP, max_segment=FILL, min_segment=SPACE, total=20, duration="duration",
                                   weights=WEIGHTS)


@check("filter_by_sections", sql("kp sec", "recursive:" + FILTERED + " SELECT timeline_id, t, id FROM spaced"))
def _(s, d):
    return _filtered(s, d).select("timeline_id", "t", "id")


# by_start: segments over the whole timeline, given to the section their start lies in
@check("two_level_segments_by_start", sql("kp sec", f"""kept AS (SELECT timeline_id, t FROM kp WHERE type = 'click'),
mk AS (SELECT timeline_id, t FROM kept UNION SELECT timeline_id, 0e0 FROM sec UNION SELECT timeline_id, {SPAN}::DOUBLE FROM sec),
sg AS (SELECT timeline_id, t AS s, lead(t) OVER (PARTITION BY timeline_id ORDER BY t) AS e FROM mk),
sh AS (SELECT *, sum(CASE WHEN e - s >= 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY s) AS g FROM sg WHERE e - s >= 1),
mg AS (SELECT timeline_id, min(s) AS s, max(e) AS e FROM sh GROUP BY timeline_id, g)
SELECT mg.timeline_id, ord AS section_ord, row_number() OVER (PARTITION BY mg.timeline_id, ord ORDER BY s) - 1 AS sub_ord, s AS start_time, e AS end_time, e - s AS duration, s - start_time AS relative_start, e - start_time AS relative_end
FROM mg JOIN sec ON sec.timeline_id = mg.timeline_id AND s >= start_time AND s < end_time"""))
def _(s, d):
    k = keypoints(s, d)
    return song.two_level_segments(sections(s, d), k.filter("type = 'click'").select("timeline_id", "t"), k, mode="by_start", min_len=30_000.0)


# cut_at_sections: inside each section; every over-long piece is first cut at its strongest instants, what is still
# too long near even times, each as a recursion over lists
CUT = f"""recursive: {{norm}},
mk AS (SELECT sec.timeline_id, ord, t FROM sec JOIN kp ON kp.timeline_id = sec.timeline_id AND t >= start_time AND t < end_time AND type = 'click' UNION SELECT timeline_id, ord, start_time FROM sec UNION SELECT timeline_id, ord, end_time FROM sec),
sg AS (SELECT timeline_id, ord, t AS s, lead(t) OVER (PARTITION BY timeline_id, ord ORDER BY t) AS e FROM mk),
sh AS (SELECT *, sum(CASE WHEN e - s >= 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id, ord ORDER BY s) AS g FROM sg WHERE e - s >= 1),
mg AS (SELECT timeline_id, ord, min(s) AS s, max(e) AS e FROM sh GROUP BY timeline_id, ord, g),
lg AS (SELECT *, CAST(ceil((e - s) / 60000) AS INT) - 1 AS need FROM mg WHERE e - s > 60000),
cand AS (SELECT lg.timeline_id, lg.ord, s, e, need, list({{{{'v': -normalized_intensity, 't': t, 'id': id}}}} ORDER BY -normalized_intensity, t, id) AS open FROM lg JOIN norm ON norm.timeline_id = lg.timeline_id AND t > s AND t < e GROUP BY ALL),
pk AS (SELECT timeline_id, ord, s, e, need, list_filter(open, lambda x: x.t - s >= 20000 AND e - x.t >= 20000) AS open, CAST([] AS DOUBLE[]) AS got FROM cand
  UNION ALL SELECT timeline_id, ord, s, e, need, list_filter(open, lambda x: abs(x.t - open[1].t) >= 20000), list_append(got, open[1].t) FROM pk WHERE len(open) > 0 AND len(got) < need),
fin AS (SELECT timeline_id, ord, s, list_concat(list_concat([s], list_sort(got)), [e]) AS marks FROM pk QUALIFY row_number() OVER (PARTITION BY timeline_id, ord, s ORDER BY len(got) DESC) = 1),
s1 AS (SELECT timeline_id, ord, marks[i] AS s, marks[i + 1] AS e FROM fin, LATERAL (SELECT unnest(generate_series(1, len(marks) - 1)) AS i)
  UNION ALL SELECT timeline_id, ord, CASE WHEN i = 0 THEN s ELSE s + i * ((e - s) / (need + 1)) END, CASE WHEN i = need THEN e ELSE s + (i + 1) * ((e - s) / (need + 1)) END FROM lg ANTI JOIN cand USING (timeline_id, ord, s), LATERAL (SELECT unnest(generate_series(0, need)) AS i)),
st1 AS (SELECT * FROM s1 WHERE e - s >= 20000 UNION ALL SELECT timeline_id, ord, s, e FROM mg WHERE e - s <= 60000),
l2 AS (SELECT *, CAST(ceil((e - s) / 60000) AS INT) - 1 AS k FROM st1 WHERE e - s > 60000),
c2 AS (SELECT l2.timeline_id, l2.ord, s, e, l2.k, list({{{{'t': t, 'v': normalized_intensity, 'id': id}}}} ORDER BY t, id) FILTER (id IS NOT NULL) AS c FROM l2 LEFT JOIN norm ON norm.timeline_id = l2.timeline_id AND t > s AND t < e GROUP BY ALL),
w2 AS (SELECT timeline_id, ord, s, e, k, 0 AS i, c, CAST([] AS DOUBLE[]) AS got FROM c2
  UNION ALL SELECT timeline_id, ord, s, e, k, i + 1, CASE WHEN b IS NULL THEN c ELSE list_filter(c, lambda x: x.id <> b.id) END, list_append(got, coalesce(b.t, mid)) FROM (
    SELECT *, CASE WHEN len(n) > 0 THEN list_sort(list_transform(n, lambda x: {{{{'a': -x.v, 't': x.t, 'id': x.id}}}}))[1] ELSE list_sort(list_transform(c, lambda x: {{{{'a': abs(x.t - mid), 't': x.t, 'id': x.id}}}}))[1] END AS b FROM (
      SELECT *, list_filter(c, lambda x: x.t >= mid - 3 AND x.t <= mid + 3) AS n FROM (SELECT *, s + (i + 1) * ((e - s) / (k + 1)) AS mid FROM w2 WHERE i < k)))),
f2 AS (SELECT timeline_id, ord, list_concat(list_concat([s], list_sort(list_distinct(got))), [e]) AS marks FROM w2 WHERE i = k),
st2 AS (SELECT * FROM (SELECT timeline_id, ord, marks[i] AS s, marks[i + 1] AS e FROM f2, LATERAL (SELECT unnest(generate_series(1, len(marks) - 1)) AS i)) WHERE e - s >= 20000 UNION ALL SELECT * FROM st1 WHERE e - s <= 60000),
sh2 AS (SELECT *, sum(CASE WHEN e - s >= 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY timeline_id, ord ORDER BY s) AS g FROM st2),
m2 AS (SELECT timeline_id, ord, min(s) AS s, max(e) AS e FROM sh2 GROUP BY timeline_id, ord, g UNION ALL SELECT timeline_id, ord, start_time, end_time FROM sec ANTI JOIN st2 USING (timeline_id, ord))
SELECT m2.timeline_id, ord AS section_ord, row_number() OVER (PARTITION BY m2.timeline_id, ord ORDER BY s) - 1 AS sub_ord, s AS start_time, e AS end_time, e - s AS duration, s - start_time AS relative_start, e - start_time AS relative_end FROM m2 JOIN sec USING (timeline_id, ord)""".replace("{{", "{").replace("}}", "}")


def _cut_sql():
    from checks.points import NORM
    return CUT.replace("{norm}", NORM)


@check("two_level_segments", sql("kp sec", _cut_sql()))
def _(s, d):
    k = keypoints(s, d)
    return song.two_level_segments(sections(s, d), k.filter("type = 'click'").select("timeline_id", "t"), P.normalize_by_type(points(s, d)), min_len=20_000.0, max_len=60_000.0)


# ---------------------------------------------------------------- edit list

PICKS = """p0 AS (SELECT timeline_id, CAST(floor(t / 259200) AS BIGINT) AS section_idx, id AS shot_idx, k, CAST(floor(t % 80000) AS BIGINT) AS s FROM kp),
sel AS (SELECT *, 1280 AS vw, CASE WHEN k % 4 = 0 THEN 720 ELSE 1920 END AS vh FROM p0 WHERE k % 10 <> 0),
cl AS (SELECT sel.*, j AS pos, s + j * 7e0 AS a, s + j * 7e0 + 5.5e0 AS z FROM sel, (VALUES (0), (1)) v(j)),
cu AS (SELECT DISTINCT timeline_id, CAST(floor(t % 80000) AS BIGINT) + 2.5e0 AS cut FROM kp)"""


def _picks(s, d):
    k = keypoints(s, d).withColumn("s", F.floor(F.col("t") % 80000))
    p = k.select("timeline_id", F.floor(F.col("t") / 259200).alias("section_idx"), F.col("id").alias("shot_idx"), "k", "s")
    sel = p.select("timeline_id", "section_idx", "shot_idx", F.when(F.col("k") % 10 == 0, "error").otherwise("success").alias("status"),
                   F.lit(1280).alias("video_width"), F.when(F.col("k") % 4 == 0, 720).otherwise(1920).alias("video_height"))
    c = p.withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1))))

    def tc(x):
        w = F.floor(x)
        return F.concat(F.format_string("%02d:%02d:%02d", F.floor(w / 3600), F.floor(w / 60) % 60, w % 60), F.when(x == w, F.lit(".0")).otherwise(F.lit(".5")))

    clips = c.select("timeline_id", "section_idx", "shot_idx", "pos", tc(F.col("s") + F.col("pos") * 7.0).alias("start"), tc(F.col("s") + F.col("pos") * 7.0 + 5.5).alias("end"))
    det = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") % 3))).select(
        "timeline_id", "section_idx", "shot_idx", (F.col("s") + F.col("j")).cast("double").alias("time_sec"), (F.col("j") != 1).alias("protagonist_detected"),
        F.struct((F.col("k") + F.col("j")).alias("x"), F.col("k").alias("y"), (F.col("k") + 20).alias("width"), F.lit(40).alias("height")).alias("bounding_box"))
    cuts = k.select("timeline_id", (F.col("s") + 2.5).alias("cut")).distinct()
    return sel, clips, det, cuts


EDIT = PICKS + """, m AS (SELECT cl.shot_idx, cl.pos, min(cut) AS cut FROM cl JOIN cu ON cu.timeline_id = cl.timeline_id AND cut > a + 0.5 AND cut < z - 0.5 GROUP BY ALL),
dt AS (SELECT sel.*, j, k + j AS bx, k AS bby, k + 20 AS bw, 40 AS bh FROM sel, LATERAL (SELECT unnest(generate_series(0, k % 3)) AS j) WHERE j <> 1),
sz AS (SELECT *, CASE WHEN vw < vh THEN 360 ELSE CAST(trunc(vw * (360e0 / vh)) AS INT) END AS dw, CASE WHEN vw < vh THEN CAST(trunc(vh * (360e0 / vw)) AS INT) ELSE 360 END AS dh FROM dt),
ce AS (SELECT shot_idx, sum((bx + bw / 2) * bw * bh) / sum(bw * bh) * (any_value(vw) / any_value(dw)) AS cx, sum((bby + bh / 2) * bw * bh) / sum(bw * bh) * (any_value(vh) / any_value(dh)) AS cy FROM sz GROUP BY 1)"""


@check("edit_list", sql("kp", EDIT + """ SELECT cl.timeline_id, section_idx, cl.shot_idx, cl.pos, coalesce(cut, a) AS "start", CASE WHEN cut IS NULL THEN z ELSE cut + 5.5 END AS "end", cut IS NOT NULL AS adjusted, cx AS center_x, cy AS center_y,
 row_number() OVER (PARTITION BY cl.timeline_id ORDER BY section_idx, cl.shot_idx, cl.pos) AS place FROM cl LEFT JOIN m ON m.shot_idx = cl.shot_idx AND m.pos = cl.pos LEFT JOIN ce ON ce.shot_idx = cl.shot_idx"""))
def _(s, d):
    from spanloom.operators.ordered import scan
    out, _ = edit.edit_list(*_picks(s, d))
    n = scan(materialize(out), t="section_idx", tie=["shot_idx", "pos"], cell=1, run={"place": ("sum", F.lit(1))})
    return n.select("timeline_id", "section_idx", "shot_idx", "pos", "start", "end", "adjusted", "center_x", "center_y", "place")


@check("edit_list_boxes", sql("kp", EDIT + """ SELECT timeline_id, shot_idx, s + j::DOUBLE AS time_sec, CAST(trunc(bx * (vw / dw)) AS INT) AS x, CAST(trunc(bby * (vh / dh)) AS INT) AS y, CAST(trunc(bw * (vw / dw)) AS INT) AS width, CAST(trunc(bh * (vh / dh)) AS INT) AS height FROM sz"""))
def _(s, d):
    _, boxes = edit.edit_list(*_picks(s, d))
    return boxes.select("timeline_id", "shot_idx", "time_sec", "bounding_box.*")


# the whole chain on similar shots: similarity cuts, then absorption (300 s pieces are checked on their own)
def _scene_sql():
    from checks.scenes import CUTS
    return CUTS + ", g0 AS (SELECT * FROM sc0)" + ABSORB + " SELECT timeline_id, ord, scene_id FROM ab"


@check("segment_scenes", sql("shots", _scene_sql()))
def _(s, d):
    return footage.segment_scenes(_with_vectors(s, d), max_sec=0).select("timeline_id", "ord", "scene_id")


def _scene_split_sql():
    from checks.scenes import CUTS, SPLIT
    split = SPLIT.replace("recursive:", "").replace("b0 AS (SELECT *, ord // 150 AS scene FROM shots)", "b0 AS (SELECT *, scene_id AS scene FROM ab)")
    head, tail = split.rsplit("\nSELECT timeline_id, ord, scene AS scene_id,", 1)
    absorbed = ABSORB.replace("ab AS (", "ab AS MATERIALIZED (")
    return (f"recursive:{CUTS}, g0 AS (SELECT * FROM sc0){absorbed},\n{head},\np2 AS (SELECT timeline_id, ord, scene AS scene_id,{tail})\n"
            "SELECT timeline_id, ord, dense_rank() OVER (PARTITION BY timeline_id ORDER BY scene_id, piece) - 1 AS scene_id FROM p2")


@check("segment_scenes_split", sql("shots", _scene_split_sql()))
def _(s, d):
    return footage.segment_scenes(_with_vectors(s, d)).select("timeline_id", "ord", "scene_id")
